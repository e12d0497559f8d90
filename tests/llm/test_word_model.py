"""The word model against a plain one, whole texts, in rounds and shards."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import kneser_ney, word_model


def _plain(texts: list[list[str]], order: int):
    """Bits of a text under interpolated modified Kneser-Ney over words."""
    marked = lambda t: [None] * (order - 1) + t + [None]
    levels = {order: Counter()}
    for t in texts:
        x = marked(t)
        levels[order].update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount, after = {}, {n: defaultdict(list) for n in levels}
    for n, counts in levels.items():
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        discount[n] = [min(k * 0.95, max(0.05 * k, k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k)) for k in (1, 2, 3)]
        for g, c in counts.items():
            after[n][g[:-1]].append(c)

    def p(gram: tuple) -> float:
        n = len(gram)
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        seen = after[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        d, total, c = discount[n], sum(seen), levels[n][gram]
        return (c - d[min(c, 3) - 1] if c else 0) / total + sum(d[min(x, 3) - 1] for x in seen) / total * p(gram[1:])

    def bits(t: list[str]) -> float:
        x = marked(t)
        return -sum(math.log2(p(tuple(x[i : i + order]))) for i in range(len(x) - order + 1))

    return bits


def test_keys_are_those_of_spark(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**63), 2**63, (50, 3), dtype=np.int64)
    got = spark.createDataFrame(x.tolist(), "a long, b long, c long").select(F.xxhash64("a"), F.xxhash64("a", "b", "c")).collect()
    for n, k in ((1, 0), (3, 1)):
        assert word_model.gram_keys([x[:, i].view(np.uint64) for i in range(n)]).view(np.int64).tolist() == [r[k] for r in got]


@pytest.mark.parametrize(("order", "rounds", "shards"), [(2, 3, 2), (3, 2, 3), (1, 1, 1), (4, 1, 2)])
def test_scores_are_those_of_a_plain_model(spark, order, rounds, shards):
    rng = random.Random(order)
    words = [f"w{i}" for i in range(9)] + ["é", "Wort", "x.y"]
    make = lambda more: [rng.choice(words + more) for _ in range(rng.randrange(1, 30))]
    known = {lang: [make([]) for _ in range(25)] for lang in ("en", "de")}
    asked = [(lang, make(["new", "other"])) for lang in ("en", "de") for _ in range(20)] + [("en", t) for t in known["de"]]
    asked += asked[:5]  # copies
    salted = lambda rows: spark.createDataFrame([(a, "\n ".join(t)) for a, t in rows], "lang string, text string").repartition(3).withColumn("salt", F.xxhash64("lang"))
    model, unknown = word_model.train(salted([(a, t) for a, ts in known.items() for t in ts]), order, rounds)
    rows = salted([*asked, ("en", []), ("de", [" \t"])]).withColumn("key", F.xxhash64("text", "lang"))
    got = rows.select("key", "lang", "text").distinct().join(word_model.score(rows, model, order, rounds, shards), "key").join(unknown, "lang").collect()
    of = {(r.lang, r.text): (r.n * r.unknown - r.v / word_model.ONE, r.n) for r in got}
    plain = {lang: _plain(ts, order) for lang, ts in known.items()}
    assert len(of) == len({(a, tuple(t)) for a, t in asked})
    for lang, t in asked:
        bits, n = of[lang, "\n ".join(t)]
        assert n == len(t) + 1 and abs(bits - plain[lang](t)) < 1e-3


def test_words_of_one_class_of_bytes_are_told_apart(spark):
    """Cyrillic words whose bytes are of the same classes: soup of them was clean text for the byte classes."""
    rng = random.Random(1)
    letters = "абвгдежзийклмноп"
    words = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(40))
    soup = lambda: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, clean() if i < 600 else soup(), "ru") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, least=20).collect()}
    assert sum(got[i].kept for i in range(500, 600)) >= 95 and not any(got[i].kept for i in range(600, 700))
    assert got[0].n_symbols == 41


def test_many_languages(spark):
    """A hundred languages, each with a limit of its own; what no model knows uses the pooled one."""
    rng = random.Random(8)
    rows = [(40 * k + i, " ".join(f"l{k}w{rng.randrange(11)}" for _ in range(20)), f"l{k}") for k in range(100) for i in range(40)]
    n = len(rows)
    rows += [(n, rows[0][1], "l9"), (n + 1, rows[0][1], None), (n + 2, None, "l1"), (n + 3, " \t", None), (n + 4, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == len(rows) and np.mean([got[i].kept for i in range(n)]) > 0.95
    assert not got[n].kept and got[n].perplexity > 5 * got[0].perplexity and got[n + 1].perplexity is not None
    assert all(got[i].kept and got[i].perplexity is None and got[i].n_symbols == 0 for i in (n + 2, n + 3, n + 4))


def test_rounds_change_nothing(spark, documents, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    order = lambda rows: sorted(map(str, rows))
    want = order(kneser_ney.classify(documents, labels, least=5).collect())
    kept = kneser_ney.keep_good(documents, labels, least=5).count()
    assert kept == sum("kept=True" in r for r in want) and len(want) == documents.count()
    monkeypatch.setattr(kneser_ney, "ROUND_BYTES", 1 << 13)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 1 << 11)
    assert order(kneser_ney.classify(documents, labels, least=5).collect()) == want
