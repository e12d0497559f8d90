"""Writing results: documents, partition replacement, the basket's list, one-file exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.plans.scratch import materialise, release

# Columns of the basket's list.
LIST_COLUMNS = ("plik", "data", "godzina", "rodzaj", "źródło", "nazwa", "od [s]", "do [s]", "osoby", "tagi")
KINDS = {"dv": "MiniDV", "dvd": "VHS/DVD", "video": "film", "photo": "zdjęcie"}


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that df has rows for, whole; others stay. The writer commits as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_faces(tracks: DataFrame, persons: DataFrame, path: str, scenes: DataFrame | None = None) -> bool:
    """Replace the tracks of scenes (tape_id, scene_id; those that tracks has rows for); other scenes of their tapes stay.
    Refused (False) if a person that tracks refers to is not there.

    The table is partitioned by tape: what it has of the other scenes of the tapes at hand is read, joined with the new
    rows and written to the shared folder first, so a partition is never read and overwritten by one job. Tapes at
    hand: one task of an archive names few.
    """
    gone = tracks.where("person_id is not null").join(persons.select(F.col("id").alias("person_id")), "person_id", "left_anti")
    if not gone.isEmpty():
        return False
    spark, key = tracks.sparkSession, ["tape_id", "scene_id"]
    at = (tracks if scenes is None else scenes).select(*key).distinct()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        replace_partitions(tracks, path, ["tape_id"])
        return True
    stored = spark.read.schema(tracks.schema).parquet(path)
    tapes = [r["tape_id"] for r in at.select("tape_id").distinct().collect()]
    kept = stored.where(F.col("tape_id").isin(*tapes)).join(at, key, "left_anti")
    fresh = materialise(kept.unionByName(tracks), "faces")
    replace_partitions(fresh, path, ["tape_id"])
    empty = set(tapes) - {r["tape_id"] for r in fresh.select("tape_id").distinct().collect()}
    for tape in empty:  # no row is left that would replace the partition
        for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f"tape_id={tape}")) or []:
            files.delete(s.getPath(), True)
    release(fresh)
    return True


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def basket_list(basket: DataFrame, catalog: DataFrame, people: DataFrame, tags: DataFrame, pad: float = 1.0) -> DataFrame:
    """A row for each moment of the basket (workspace, tape_id, scene_id, id, start, end), widened by pad on either side
    within its video, with who and what is seen in it; moments whose scene has gone are marked missing.

    people: (tape_id, scene_id, name, times); tags: (tape_id, scene_id, tag, t0, t1). Both meet the moments by scene.
    """
    key = ["tape_id", "scene_id"]
    b = basket.join(catalog.select(*key, "kind", "date", "time", "label", "name", "duration"), key, "left")
    photo = F.coalesce(F.col("kind") == "photo", F.lit(False))
    end = F.col("end") + pad
    b = b.withColumn("a", F.when(photo, F.col("start")).otherwise(F.greatest(F.lit(0.0), F.col("start") - pad)))
    b = b.withColumn("b", F.when(photo, F.col("end")).when(F.col("duration") > 0, F.least(F.col("duration"), end)).otherwise(end))
    inside = F.exists("times", lambda t: t.between(F.col("a"), F.col("b")))
    own = ["workspace", "id"]
    who = b.join(people.select(*key, F.col("name").alias("__who"), "times"), key).where((F.col("kind") == "photo") | inside)
    who = who.groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set("__who")), ", ").alias("osoby"))
    what = b.join(tags.select(*key, "tag", "t0", "t1"), key).where((F.col("t0") <= F.col("b")) & (F.col("t1") >= F.col("a")))
    what = what.groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tagi"))
    out = b.join(who, own, "left").join(what, own, "left")
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in KINDS.items()))
    return out.select(
        *own, F.col("kind").isNull().alias("missing"), F.coalesce("date", F.lit("")).alias("data"), F.coalesce("time", F.lit("")).alias("godzina"), kind.alias("rodzaj"),
        F.col("label").alias("źródło"), F.coalesce("name", "scene_id").alias("nazwa"), F.format_string("%.1f", "a").alias("od [s]"), F.format_string("%.1f", "b").alias("do [s]"),
        F.coalesce("osoby", F.lit("")).alias("osoby"), F.coalesce("tagi", F.lit("")).alias("tagi"),
    )


def write_list(rows: DataFrame, path: str) -> None:
    """Semicolons, a header, and a byte order mark on it so that spreadsheets read the letters right; one file, since a
    basket is what a person picked."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(path)
