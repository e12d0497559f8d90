"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.plans.scratch import materialise, release


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex that has an edge to another; component is its smallest vertex.

    edges: two columns of one type that can be ordered. Rows with a null end, loops and repeats are ignored; an empty
    table gives an empty result. Each round is two joins on a vertex against its smallest neighbour, whose aggregation
    combines on the map side, so a vertex with very many neighbours is split by the skew join. Only a count and a
    checksum of each round reach the driver.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialise(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _fingerprint(e)
    while seen[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "edges")
        now = _fingerprint(after)
        release(e)
        e = after
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    ).distinct()
