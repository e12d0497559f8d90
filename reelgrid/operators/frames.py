"""Frames and detections: which are looked at, and which track they belong to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from reelgrid.operators.vector_blocks import PAIRS, dots, rounding

BATCH_BYTES = 1 << 26
SECOND = ["tape_id", "scene_id", "second"]


def sharp_frames(frames: DataFrame, keys: list[str], threshold: float = 40.0) -> DataFrame:
    """The first frame of each second that is sharp enough. frames: keys, second, i, sharpness and whatever goes along."""
    rest = [c for c in frames.columns if c not in (*keys, "second")]
    good = frames.where(F.col("sharpness") >= threshold)
    return good.groupBy(*keys, "second").agg(F.min_by(F.struct(*rest), F.col("i")).alias("f")).select(*keys, "second", "f.*")


def frame_numbers(seconds: DataFrame, keys: list[str], fps: Column | float, every: int = 1, rows: int = 500_000) -> DataFrame:
    """(keys, frame): every so many frames of the seconds asked for; seconds: keys, times (array).

    Frames of different whole seconds at one rate are different, so repeats are dropped among seconds, which are fewer;
    only mixed rates and parts of seconds need it among frames. A task has about `rows` of the rows.
    """
    whole = not isinstance(fps, Column) and isinstance(seconds.schema["times"].dataType.elementType, IntegralType)
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    if (parts := -(-seconds.count() // rows)) > 1:
        seconds = seconds.repartition(parts, *keys)
    s = seconds.select(*keys, rate.alias("fps"), F.explode(F.array_distinct("times")).alias("s")).distinct()
    first, last = F.ceil(F.col("s") * F.col("fps")).cast("long"), (F.ceil((F.col("s") + 1) * F.col("fps")) - 1).cast("long")
    out = s.where(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("frame")).where(F.col("frame") % every == 0)
    return out if whole else out.distinct()


def nearest_track(detections: DataFrame, tracks: DataFrame, least: float = 0.25, block: int = 1024) -> DataFrame:
    """(detection, track, similarity): the most similar track seen within a second of each detection.

    detections: detection, tape_id, scene_id, second, embedding; tracks: track, tape_id, scene_id, times, embedding. Both
    meet by scene and second in blocks of about `block` vectors, whose products are taken by matrices; of a block only
    the best track of each detection goes on, by its exact product.
    """
    near = tracks.withColumn("second", F.explode(F.array_distinct(F.flatten(F.transform("times", lambda t: F.array(t - 1, t, t + 1))))))
    pairs = _blocks(detections, "detection", block).join(_blocks(near, "track", block), [*SECOND, "width"])
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"  # a row is two blocks of vectors
    if int(detections.sparkSession.conf.get(limit).removesuffix("b")) > BATCH_BYTES:
        detections.sparkSession.conf.set(limit, str(BATCH_BYTES))
    kinds = f"detection {detections.schema['detection'].dataType.simpleString()}, track {tracks.schema['track'].dataType.simpleString()}"
    best = pairs.select("width", "detection", "detection_v", "track", "track_v").mapInArrow(_best_tracks(least), f"{kinds}, similarity double")
    r = F.row_number().over(Window.partitionBy("detection").orderBy(F.desc("similarity"), "track"))
    return best.where(F.col("similarity") >= least).withColumn("r", r).where("r = 1").drop("r")


def _blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows in blocks of about so many of a scene's second and length of vector: key, an array in order, and key_v, their
    vectors one after the other. Vectors that are null or hold a null have no product and are left out."""
    by = [*SECOND, "width"]
    whole = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    whole = whole.select(key, *SECOND, F.size("embedding").alias("width"), F.col("embedding").cast("array<double>").alias("v"))
    parts = whole.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = whole.join(parts, by).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    each = dealt.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct(key, "v"))).alias("all"))
    return each.select(*by, F.col(f"all.{key}").alias(key), F.flatten("all.v").alias(f"{key}_v"))


def _best_tracks(least: float):
    def best(width: int, d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of detections and of their best tracks (the first of equals), and exact products."""
        d, t = d.reshape(-1, width), t.reshape(-1, width)
        s = d.astype(np.float32) @ t.astype(np.float32).T
        far = rounding(width) * np.linalg.norm(d, axis=1) * float(np.linalg.norm(t, axis=1).max())
        floor = np.maximum(least, np.fmax.reduce(s, axis=1) - far) - far
        i, j = np.nonzero(~(s < np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]))
        score = np.concatenate([dots(d[i[n : n + PAIRS]], t[j[n : n + PAIRS]]) for n in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
        order = np.lexsort((j, -score, ~np.isnan(score), i))
        i, j, score = i[order], j[order], score[order]
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        return i[first], j[first], score[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, d, dv, t, tv = batch.columns
            for n in range(len(batch)):
                i, j, score = best(width[n].as_py(), *(np.asarray(x[n].values.to_numpy(zero_copy_only=False), np.float64) for x in (dv, tv)))
                columns = [d[n].values.take(pa.array(i)), t[n].values.take(pa.array(j)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["detection", "track", "similarity"])

    return run


def prompt_key(prompts: Column) -> Column:
    """What encoded prompts are kept under."""
    return F.sha1(F.to_json(prompts).cast("binary"))


def second_zero(photos: DataFrame) -> DataFrame:
    """Faces of photos as tracks: each its own, seen at second 0."""
    return photos.withColumn("times", F.array(F.lit(0)))
