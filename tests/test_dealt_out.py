"""All pairs are dealt out over tasks, and what needs no second look gets none."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import duplicates, frames, intervals, people, search, vector_blocks


def test_pairs_of_a_group_have_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "spread", lambda s, pairs, each: vector_blocks.spread(s, pairs, 2000))
    got = duplicates.dismiss_group(spark.range(100).coalesce(1).withColumnRenamed("id", "key"))
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(100) for b in range(a + 1, 100)]
    assert got.rdd.getNumPartitions() >= 5


def test_pairs_of_names_have_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(people, "spread", lambda s, pairs, each: vector_blocks.spread(s, pairs, 2000))
    rows = [(k, None if k % 10 == 3 else "Ann" if k % 3 else "aNN" if k % 2 else f"n{k % 4}", None if k == 50 else k * 7 % 101) for k in range(100)]
    got = people.differently_named(spark.createDataFrame(rows, "id int, name string, anchor long").coalesce(1))
    own = [(n.lower(), a) for _, n, a in rows if n and a is not None]
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for n, a in own for m, b in own if n != m and a < b)
    assert got.rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("rows", [2, 500_000])
def test_frames_are_not_compared_at_one_rate(spark, rows):
    s = spark.createDataFrame([("a", [1, 2, 2]), ("a", [2, 4]), ("b", [0]), ("c", None), ("d", [])], "k string, times array<int>")
    want = sorted({(k, f) for k, t in (("a", 1), ("a", 2), ("a", 4), ("b", 0)) for f in range(t * 5, t * 5 + 5) if f % 2 == 0})
    got = frames.frame_numbers(s, ["k"], 5.0, 2, rows)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.partition("Generate explode(sequence")[0]
    parts = spark.createDataFrame([("a", [1.0, 1.5])], "k string, times array<double>")  # they share frames
    assert sorted(r.frame for r in frames.frame_numbers(parts, ["k"], 4.0).collect()) == [4, 5, 6, 7, 8, 9]


def test_one_wanted_value_is_not_counted(spark):
    facts = spark.createDataFrame([(1, "R"), (1, "R"), (2, "N"), (3, None), (None, "R")], "k int, tag string")
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    one = search.having_all(rows, facts, ["k"], "tag", frozenset({"R"}))
    assert [r.k for r in one.collect()] == [1]
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert search.having_all(rows, facts.unionByName(facts.withColumn("tag", F.lit("N"))), ["k"], "tag", frozenset({"R", "N"})).collect()[0].k == 1


def test_baskets_go_on_across_batches(spark):
    """Scenes are filled one after the other, not in a pandas table each, and batches may end within one."""
    rows = [("" if k % 2 else "w", f"t{k % 3}", "s" if k % 5 else None, 997 * k % 400, float(k * 37 % 500), float(k * 37 % 500 + k % 9 - 4)) for k in range(400)]
    rows += [("w", "t0", "s", 900, None, 1.0), ("w", "t9", "s", 901, 5.0, 1.0)]
    want = {}
    for w, t, s, q, a, b in sorted(rows, key=lambda r: r[3]):
        if a is None:
            continue
        held, a, b = want.setdefault((w or "default", t, s), []), max(0.0, min(a, b)), max(a, b)
        for k in held:
            if a <= k[2] and b >= k[1]:
                k[1:] = [min(a, k[1]), max(b, k[2])]
                break
        else:
            held.append([q, a, b])
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "7")
    try:
        got = intervals.add_to_basket(spark.createDataFrame(rows, "workspace string, tape_id string, scene_id string, seq long, start double, end double"))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*k, *m)) for k, ms in want.items() for m in ms)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.set(name, before)


def test_nearest_tracks_by_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(160, 6))
    v[40:60] = v[20:40]  # equal tracks: the first stands
    d = [(k, "t", f"s{k % 2}", k % 4, v[k].tolist() if k != 9 else None) for k in range(160)]
    t = [(k, "t", f"s{k % 2}", [k % 4, k % 4, 7], v[k].tolist() if k != 30 else v[k].tolist()[:3] + [None] * 3) for k in range(0, 160, 2)]
    got = frames.nearest_track(spark.createDataFrame(d, "detection long, tape_id string, scene_id string, second int, embedding array<double>"), spark.createDataFrame(t, "track long, tape_id string, scene_id string, times array<int>, embedding array<double>"), 0.25, 8)
    want = []
    for k, _, scene, second, x in d:
        near = [(-float(np.cumsum(np.multiply(x, y))[-1]), n) for n, _, s, times, y in t if x and None not in y and s == scene and any(abs(second - w) <= 1 for w in times)]
        if near and -min(near)[0] >= 0.25:
            want.append((k, min(near)[1], -min(near)[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()
