"""Running values over a key in two levels, so that a key with most of the rows runs in many tasks.

The order column is cut into buckets of a width. Windows run inside (key, bucket); one row a bucket is scanned by key,
and its result is joined back as what the buckets before hand on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.plans.scratch import materialise

BUCKET = "__bucket"


def bucketed(rows: DataFrame, at: str, width: float) -> DataFrame:
    """rows with their bucket; rows without a place have none."""
    return rows.withColumn(BUCKET, F.floor(F.col(at).cast("double") / width).cast("long"))


def inside(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def handed_on(rows: DataFrame, keys: Sequence[str], ends: dict[str, Column], scans: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with what other buckets of the key hand on.

    ends: aggregates of a bucket, by name; scans: column -> (how, end), with how one of "max", "sum", "last" over the
    buckets before and "first" over those after. A sum without buckets before is 0, others are null.
    """
    each = rows.groupBy(*keys, BUCKET).agg(*(v.alias(f"__{name}") for name, v in ends.items()))
    w = Window.partitionBy(*keys).orderBy(BUCKET)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    how = {
        "max": lambda c: F.max(c).over(before), "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
        "last": lambda c: F.last(c, ignorenulls=True).over(before), "first": lambda c: F.first(c, ignorenulls=True).over(after),
    }
    named = [f"__k{i}" for i in range(len(keys))]
    small = each.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(BUCKET).alias("__b"), *(how[kind](f"__{end}").alias(name) for name, (kind, end) in scans.items()))
    same = F.col(BUCKET) == F.col("__b")
    for k, n in zip(keys, named, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    return rows.join(small, same, "left").drop(*named, "__b")


def ranked(rows: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 over the whole table: ranges of the order in many tasks, then one count a range."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranks")
    parts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    return dealt.join(parts, "__part").withColumn(name, F.col("__from") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))).drop("__part", "__from")
