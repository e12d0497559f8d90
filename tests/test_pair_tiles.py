"""All pairs by tiles: the same pairs as by loops, and files that grow by far less than the pairs' own numbers."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import duplicates, pair_tiles, people, vector_blocks


@pytest.mark.parametrize("each", [1 << 28, 50_000])
def test_tiles_give_each_pair_once(spark, monkeypatch, each):
    """Anchors that several people have stand on the edges of tiles, and one name is that of a third of the people."""
    monkeypatch.setattr(people, "spread", lambda s, pairs, _: vector_blocks.spread(s, pairs, each))
    rng = random.Random(3)
    rows = [(k, rng.choice(["Ann", "aNN", None, *(f"n{rng.randrange(400)}" for _ in range(4))]), rng.choice([None, *rng.choices(range(-600, 600), k=9)])) for k in range(1400)]
    got = people.differently_named(spark.createDataFrame(rows, "id int, name string, anchor long").repartition(3))
    own = [(n.lower(), a) for _, n, a in rows if n and a is not None]
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for n, a in own for m, b in own if n != m and a < b)
    assert got.rdd.getNumPartitions() >= (1 if each > 50_000 else 20)


def test_keys_may_be_text_and_tables_empty(spark):
    keys = [f"tape{k % 7}/{chr(233 if k % 2 else 97)}{k}" for k in range(60)] + ["\U0001f600", "￿", "tape0/a0", None]
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    want = sorted((a, b) for a in keys for b in keys if a is not None and b is not None and a < b)
    assert sorted(map(tuple, pair_tiles.ordered_pairs(rows, "key", 5).collect())) == want
    none = spark.createDataFrame([], "id int, name string, anchor long")
    assert people.differently_named(none).collect() == [] and people.differently_named(none).dtypes == [("a", "bigint"), ("b", "bigint")]


def test_written_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    """4.5 million pairs with unlike names; one row of a pair after the other took over a byte."""
    people_ = spark.range(3000).select("id", F.concat(F.lit("n"), (F.col("id") * 7919 % 1500).cast("string")).alias("name"), (F.col("id") * 40).alias("anchor"))
    people.differently_named(people_).write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert rows == 3000 * 2999 // 2 - 1500
    assert sum(f.stat().st_size for f in Path(tmp_path / "pairs").glob("*.parquet")) < 0.3 * rows


def test_dismissed_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    keys = spark.range(3000).select(F.concat(F.lit("tape/"), (F.col("id") * 7919 % 100_003).cast("string")).alias("key"))
    duplicates.dismiss_group(keys.union(keys.limit(1))).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.where("scene_a < scene_b").count() == got.count() == 3000 * 2999 // 2 + 2999
    assert got.distinct().count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in Path(tmp_path / "pairs").glob("*.parquet")) < 0.3 * got.count()
