"""The vector index of scenes: what is in it, what has gone, what is to be read next, and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tape_id", "scene_id"]
# Kinds in the order that they are read.
KIND_ORDER = ("dv", "dvd", "video", "photo")


def index_counts(scanned: DataFrame) -> DataFrame:
    """One row: scenes in the index and frames of all."""
    return scanned.agg(F.count("*").alias("scenes"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"))


def gone(scanned: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys of the index that the catalog has no more."""
    return scanned.select(*KEY).join(catalog.select(*KEY), KEY, "left_anti")


def index_work(catalog: DataFrame, scanned: DataFrame) -> DataFrame:
    """Catalog rows (with kind, date, sig) to be read: those not in the index and those whose file changed, with rank:
    tapes first, photos last, then by date (undated last) and key. Rows without a signature have no file and are left out.

    Ranks are taken within kind and year and moved by the sums of those before, so that no task sorts all rows.
    """
    known = scanned.select(*KEY, F.col("sig").alias("__known"))
    todo = catalog.where("sig is not null").join(known, KEY, "left").where(F.col("__known").isNull() | (F.col("__known") != F.col("sig"))).drop("__known")
    kind = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    date = F.coalesce("date", F.lit("9999"))
    part = todo.withColumn("__kind", kind).withColumn("__year", F.substring(date, 1, 4))
    sums = part.groupBy("__kind", "__year").agg(F.count("*").alias("__n"))  # a row a kind and year
    before = Window.orderBy("__kind", "__year").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__kind", "__year", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    own = F.row_number().over(Window.partitionBy("__kind", "__year").orderBy(date, *KEY))
    return part.join(sums, ["__kind", "__year"]).withColumn("rank", F.col("__from") + own).drop("__kind", "__year", "__from")


def replace_scenes(table: DataFrame, fresh: DataFrame, scenes: DataFrame) -> DataFrame:
    """table with the rows of scenes (their keys) replaced by those of fresh; a scene without fresh rows loses its own."""
    return table.join(scenes.select(*KEY).distinct(), KEY, "left_anti").unionByName(fresh.join(scenes.select(*KEY).distinct(), KEY, "left_semi"))


def distinct_texts(prompts: DataFrame, order: str = "n", text: str = "text") -> DataFrame:
    """(text, n): every text once, at the place where it comes first."""
    return prompts.groupBy(text).agg(F.min(order).alias(order))


def status(scanned: DataFrame, builds: DataFrame, key: str) -> DataFrame:
    """One row: the index's counts and how far the running build is; nulls where there is none."""
    run = builds.where(F.col("key") == key).select("status", "stage", "done", "total").limit(1)
    share = F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total"), 4)).otherwise(0.0)
    return index_counts(scanned).join(F.broadcast(run), F.lit(True), "left").withColumn("progress", F.when(F.col("status").isNotNull(), share))
