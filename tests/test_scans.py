"""Two-level scans give what one window gives, and joins by levels what the range join gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import dating, films, intervals
from reelgrid.operators.scans import ranked


def _rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def spans(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        a = rng.choice((rng.uniform(-500, 2000), rng.randrange(-50, 50)))
        rows.append((rng.choice(("hot", "hot", "hot", "b", None)), float(a), a + 0.0 + rng.choice((0, 1, 3, 40, 900)), float(i)))
    return spark.createDataFrame([*rows, ("hot", None, 1.0, 1.0), ("b", 5.0, None, 1.0)], "k string, t0 double, t1 double, s double")


def test_islands_in_stretches(spans):
    one = intervals.islands(spans, ["k"], gap=2.0, score="s")
    for width in (7.0, 300.0):
        assert _rows(intervals.islands(spans, ["k"], gap=2.0, score="s", width=width)) == _rows(one)
    assert one.count() > 3


def test_offsets_and_neighbours_in_stretches(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), n, rng.random() < 0.3, rng.randrange(1000)) for n in range(300) for _ in range(rng.randrange(3))]
    df = spark.createDataFrame(rows, "k string, n long, known boolean, v long")
    assert _rows(dating.neighbours(df, ("k",), "n", "known", "v", 40)) == _rows(dating.neighbours(df, ("k",), "n", "known", "v", 40, width=9))
    once = df.dropDuplicates(["k", "n"])
    assert _rows(intervals.offsets(once, ["k"], "n", "v")) == _rows(intervals.offsets(once, ["k"], "n", "v", width=11))


def test_levels_give_the_range_join(spark, spans):
    left = spans.where("t0 <= t1").select("k", F.col("t0").alias("a0"), F.col("t1").alias("a1"), "s")
    right = left.where("s % 3 = 0").select("k", (F.col("a0") + 5).alias("b0"), (F.col("a1") + 7).alias("b1"), F.col("s").alias("r"))
    args = (left, right, ["k"], ("a0", "a1"), ("b0", "b1"))
    got = intervals.overlapping_levels(*args)
    assert _rows(got) == _rows(intervals.overlapping(*args)) and got.count() > 100
    assert intervals.overlapping_levels(left.where("false"), *args[1:]).count() == 0


def test_segments_are_linear(spark):
    df = spark.createDataFrame([([5, 1, 2, None, 9, 9, 4],), ([],), (None,), (list(range(0, 200_000)),), ([7],)], "t array<int>")
    assert [r[0] for r in df.select(intervals.segments(F.col("t"))).collect()] == [[[1, 5], [9, 9]], [], None, [[0, 199_999]], [[7, 7]]]


def test_ranked(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"))
    assert all(r["rank"] == r.x + 1 for r in ranked(df, ["x"]).collect())


@pytest.mark.parametrize(("period", "first"), [(0.5, 0.0), (0.43, 0.2), (0.61, 0.55)])
def test_beats(period, first):
    rate = 11025
    t = np.arange(rate * 60) / rate
    noise = np.random.default_rng(1).normal(size=len(t))
    music = noise * (((t - first) % period < 0.03) + 0.05)
    got, at = films.beat_grid(music.astype(np.float32), rate)
    off = (at - first) % period
    assert abs(got - period) < 0.001 and min(off, period - off) < 0.06
