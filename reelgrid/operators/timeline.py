"""Years, months and the scenes of a month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline(items: DataFrame, date: str = "date", thumb: str = "thumb", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """year, month (null: the whole year), count, thumb (the first in order that is not null), newest first.

    Months are summed up to years: the items are read and grouped once, with partial aggregation on the map side.
    """
    place = F.struct(*order)
    dated = items.where(F.col(date).isNotNull())
    by_month = dated.groupBy(F.substring(date, 1, 4).cast("int").alias("year"), F.substring(date, 6, 2).cast("int").alias("month")).agg(
        F.count("*").alias("count"), F.min(F.when(F.col(thumb).isNotNull(), F.struct(place.alias("at"), F.col(thumb).alias("thumb")))).alias("first")
    )
    both = by_month.rollup("year", "month").agg(F.sum("count").alias("count"), F.min("first").alias("first")).where("year is not null")
    return both.select("year", "month", "count", F.col("first.thumb").alias("thumb")).orderBy(F.desc("year"), F.desc_nulls_first("month"))


def undated(items: DataFrame, date: str = "date") -> DataFrame:
    return items.agg(F.count_if(F.col(date).isNull()).alias("undated"))


def month_order() -> list[Column]:
    """Scenes of a month in time; those without a time last on their day."""
    return [F.col("date").asc(), F.coalesce("time", F.lit("99:99:99")).asc(), F.col("tape_id").asc(), F.coalesce("scene_index", F.lit(0)).asc(), F.col("scene_id").asc()]


def month_items(items: DataFrame, year: int, month: int) -> DataFrame:
    """The scenes and media of a month; the date's prefix is a filter that files and partitions can be skipped by."""
    prefix = f"{year:04d}-{month:02d}"
    return items.where(F.col("date").between(f"{prefix}-00", f"{prefix}-99")).orderBy(*month_order())


def with_rank(items: DataFrame, keys: tuple[str, ...], order: list[Column], name: str = "rank") -> DataFrame:
    return items.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
