"""The classifier with more languages than a worker holds tables for."""

from __future__ import annotations

import random

import numpy as np

from reelgrid.llm import kneser_ney


def test_lookup_is_the_table(spark):
    names, model = kneser_ney.train(spark.createDataFrame([("en", "the tree and the water"), ("de", "der Baum und das Wasser")], "lang string, text string"), 3)
    table, sparse = kneser_ney.log_table(model, len(names), 3), kneser_ney.sorted_model(model)
    codes = np.arange(kneser_ney.SYMBOLS**3)
    for i in range(len(names)):
        assert np.allclose(-np.log2(np.maximum(kneser_ney.lookup(sparse[i], 3, codes), 1e-12)), table[i], atol=1e-4)


def test_rare_languages_have_limits_of_their_own(spark):
    rng, rows = random.Random(6), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(12):
        words = ["".join(rng.choice(letters[2 * k : 2 * k + 3]) for _ in range(4)) for _ in range(30)]
        for _ in range(150 if k < 11 else 60):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(30)), f"l{k:02}"))
    n = len(rows)
    labels = [(i, 1, 0) for i in range(n) if i % 2]
    rows.append((n, next(r[1] for r in rows if r[2] == "l00"), "l11"))  # clean for another language only
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in kneser_ney.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for k in range(12):
        held = [got[i] for i in range(n) if not i % 2 and rows[i][2] == f"l{k:02}"]
        assert np.mean([r.kept for r in held]) >= 0.8
    assert not got[n].kept and len({r.threshold for r in got.values() if r.lang in ("l00", "l10", "l11")}) == 3
