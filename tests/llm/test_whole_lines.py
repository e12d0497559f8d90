"""Line dedup against copies planted by text, without the operator's own boundaries."""

from __future__ import annotations

import random

from reelgrid.llm import line_chunks


def test_whole_copies_go_whole(spark):
    rng = random.Random(9)
    texts = ["\n".join(f"line {rng.random()}" for _ in range(rng.randrange(2, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(df).collect()}
    for i, text in enumerate(texts):
        assert got[i].kept_text == text and got[60 + i].n_removed == text.count("\n") + 1 and got[60 + i].kept_text == ""


def test_planted_passages_mostly_go(spark):
    rng = random.Random(10)
    lines = lambda n: [f"line {rng.random()}" for _ in range(n)]
    passage = [lines(40) for _ in range(30)]
    rows = [(i, "\n".join([*lines(5), *passage[i % 30], *lines(5)])) for i in range(60)]
    got = line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in got) >= 0.8 * 30 * 40 and all(r.n_removed <= 40 * (r.doc_id >= 30) for r in got)


def test_short_passages_go(spark):
    """Passages of six lines, each in two documents between other lines."""
    rng = random.Random(12)
    lines = lambda n: [f"line {rng.random()}" for _ in range(n)]
    passage = [lines(6) for _ in range(300)]
    rows = [(i, "\n".join([*lines(rng.randrange(9)), *passage[i % 300], *lines(rng.randrange(9))])) for i in range(600)]
    got = line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed <= 6 * (r.doc_id >= 300) for r in got)
    assert sum(r.n_removed > 0 for r in got) >= 0.9 * 300 and sum(r.n_removed for r in got) >= 0.65 * 300 * 6
    print(sum(r.n_removed > 0 for r in got), sum(r.n_removed for r in got))


def test_what_stays_stays_whole(spark):
    """Overlapping chunks of one text: what occurs first keeps all its lines."""
    df = spark.createDataFrame([(1, "a\na\na\na\na\na"), (2, "x\na\na\na"), (3, "only")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(df).collect()}
    assert got[1].kept_text.startswith("a\na") and got[3].kept_text == "only"
