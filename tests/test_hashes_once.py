"""Hashes that are costly to make."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import duplicates


def test_hashes_are_made_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(x: int) -> int:
        asked.add(1)
        return x

    once = F.udf(counted, "long").asNondeterministic()
    rows = [(k, p, 7 if k < 4 else 1 << (8 * k)) for k in range(6) for p in (0, 1)]
    hashes = spark.createDataFrame(rows, "key long, position int, bits long").select("key", "position", once("bits").alias("bits"))
    got = {tuple(r) for r in duplicates.hamming_edges(hashes).collect()}
    assert {(0, 1), (0, 2), (0, 3)} <= got and asked.value == len(rows)
