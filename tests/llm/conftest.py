"""Documents with every odd case, small."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def odd_documents():
    """(doc_id, text, lang, source): passages that repeat, near and exact copies, nulls, empties, repeated rows and ids."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.1:
            text = " ".join(["x"] * rng.randrange(60))
        elif kind < 0.2:
            text = " \n".join(["x", "y"] * rng.randrange(30))
        else:
            own = [rng.choice([*words, str(rng.random())]) for _ in range(rng.randrange(60))]
            if kind < 0.7:
                a = rng.randrange(50)
                part = passage[a : rng.randrange(a, 60)]
                if part and rng.random() < 0.5:
                    part[rng.randrange(len(part))] = f"q{rng.random()}"
                k = rng.randrange(len(own) + 1)
                own[k:k] = part
            text = " ".join(own)
        rows.append((i if i % 7 else None, text, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4]))
    rows += [(500, None, "en", "a"), (501, "", None, None), (502, " \n\t", "en", "zz"), *rows[3:12]]
    return rows


@pytest.fixture(scope="session")
def documents(spark, odd_documents):
    """As a table with further columns whose names clash with those that operators use."""
    schema = "doc_id long, text string, lang string, source string, key string, id int, n long, size int, spans string"
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "s") for r in odd_documents], schema).repartition(3)
