"""Leaks against Smith-Waterman of every document with every item, over heavy edits and over the driver's tables."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from reelgrid.llm import decontaminate

DIR = "/root/testdata/sf0.01"


def _edited(item: list[str], rng: random.Random, rate: float) -> list[str]:
    out = []
    for w in item:
        kind = rng.random()
        if kind < rate / 3:
            continue
        out.append(f"new{rng.random()}" if kind < rate * 2 / 3 else w)
        if rate * 2 / 3 <= kind < rate:
            out.append(f"put{rng.random()}")
    return out


def _scores(items: dict, docs: dict) -> dict:
    """The score of every pair, each document aligned whole."""
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in t], np.uint64)
    rows = sorted(((i, code(t)) for i, t in docs.items() if t), key=lambda r: len(r[1]))
    out = {}
    for j, item in items.items():
        own = code(item)
        for lo in range(0, len(rows), 50):
            part = rows[lo : lo + 50]
            best, _ = decontaminate.smith_waterman(own, [t for _, t in part])
            out |= {(i, j): b / len(own) for (i, _), b in zip(part, best, strict=True)}
    return out


def test_every_third_word_changed(spark):
    item = [f"w{i}" for i in range(16)]
    text = [w if i % 3 != 2 else f"x{i}" for i, w in enumerate(item)]
    d = spark.createDataFrame([(1, "some more words " + " ".join(text) + " and others")], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, round(r.score, 3)) for r in decontaminate.find_leaks(d, b).collect()] == [(1, 5, 0.531)]


def test_heavy_edits(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(12, 40))] for i in range(25)}
    docs = {}
    for i in range(400):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        own[5:5] = _edited(items[i % 25], rng, rng.choice((0.2, 0.4, 0.5, 0.6, 0.7)))
        docs[i] = own
    every = _scores(items, docs)
    d = spark.createDataFrame([(i, " ".join(t).replace(".", "")) for i, t in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(d, b).collect()}
    assert {k for k, v in every.items() if v > 0.5 + 1 / len(items[k[1]])} <= set(got)
    assert all(abs(v - every[k]) < 1e-9 for k, v in got.items())
    assert len(got) >= 0.99 * sum(v >= 0.5 for v in every.values()) and sum(0.5 <= v < 0.6 for v in got.values()) > 20


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_recall_over_whole_documents(spark):
    """Items whose id is divisible by 20, against all documents."""
    split = lambda t: "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").lower()).split()
    b = spark.read.parquet(f"{DIR}/benchmark.parquet").where("item_id % 20 = 0")
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    every = _scores({r.item_id: split(r.text) for r in b.collect()}, {r.doc_id: split(r.text) for r in d.collect()})
    want = {k for k, v in every.items() if v >= 0.5}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
