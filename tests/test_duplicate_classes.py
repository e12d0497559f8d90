"""Duplicates by classes: the components of all pairs, without the pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from reelgrid.operators import duplicates
from reelgrid.operators.components import connected_components


def _components(df) -> set:
    found = {}
    for r in connected_components(df).collect():
        found.setdefault(r.component, set()).add(r.vertex)
    return {frozenset(g) for g in found.values()}


def _scenes(spark, n: int, seed: int):
    rng, rows = random.Random(seed), []
    hashes = [[f"{rng.getrandbits(64):016x}" for _ in range(3)] for _ in range(6)]
    for i in range(n):
        h = list(rng.choice(hashes)) if rng.random() < 0.6 else [""]
        if rng.random() < 0.3:
            h[0] = f"{int(h[0] or '0', 16) ^ 5:016x}"
        fp = (rng.choice(("2004-01-01T10:00:00", "2004-01-02T10:00:00", "bad", "", None)), rng.choice(("00:01", "00:02", "", None, f"t{i}")), rng.choice(("x", None)), rng.randrange(60), h)
        rows.append((i, "t", str(i), i, 5, 0, fp))
    schema = "key long, tape_id string, scene_id string, scene_index int, frame_count long, error_score int, fingerprint struct<datetime:string,tc_start:string,tc_end:string,frame_count:bigint,frame_hashes:array<string>>"
    return spark.createDataFrame(rows, schema)


def test_edges_have_the_components_of_all_pairs(spark):
    scenes = _scenes(spark, 150, 3)
    pairs = duplicates.same_recording(scenes)
    edges = duplicates.recording_edges(scenes)
    assert _components(edges) == _components(pairs) and edges.count() < pairs.count()


def test_dismissed_pairs_stay_apart(spark):
    scenes = _scenes(spark, 60, 5)
    pairs = duplicates.same_recording(scenes).cache()
    dismissed = pairs.where("(a * 7 + b) % 3 = 0 or a = 4 or b = 9").select(F.col("b").alias("scene_a"), F.col("a").alias("scene_b"))
    want = _components(duplicates.without_dismissed(pairs, dismissed))
    found = {}
    for r in duplicates.duplicate_groups(scenes, dismissed).collect():
        found.setdefault(r.group, set()).add(r.key)
    assert {frozenset(g) for g in found.values()} == want and dismissed.count() > 20


def test_a_blank_picture_in_very_many_scenes(spark):
    n = 100_000
    blank = spark.range(n).select(F.col("id").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), F.lit(0).cast("long").alias("bits"))
    near = spark.createDataFrame([(n, 0, 3), (n, 1, 1), (n + 1, 0, 255), (n + 1, 1, 0), (n + 2, 0, 0)], "key long, position int, bits long")
    edges = duplicates.hamming_edges(blank.unionByName(near))
    assert edges.count() == n
    assert connected_components(edges).agg(F.count("*"), F.max("component")).first() == (n + 1, 0)


def test_dismissed_pairs_are_worked_out_once(spark):
    """What says which pairs were dismissed may be a join of all scenes: it runs once, not at each use."""
    from pyspark.sql import functions as F

    asked = spark.sparkContext.accumulator(0)

    def counted(x: int) -> int:
        asked.add(1)
        return x

    fp = "fingerprint struct<datetime string, tc_start string, tc_end string, frame_count long, frame_hashes array<string>>"
    rows = [(i, "t", str(i), i, 5, 0, ("", str(i // 3), "9", 5, None)) for i in range(12)]
    scenes = spark.createDataFrame(rows, f"key long, tape_id string, scene_id string, scene_index int, frame_count long, error_score int, {fp}")
    once = F.udf(counted, "long").asNondeterministic()
    dismissed = spark.createDataFrame([(0, 1)], "scene_a long, scene_b long").select(once("scene_a").alias("scene_a"), "scene_b")
    got = {r.key: r.group for r in duplicates.duplicate_groups(scenes, dismissed).collect()}
    assert got == {i: i // 3 * 3 for i in range(12)} and asked.value == 1
