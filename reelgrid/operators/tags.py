"""Tags from frame vectors: scores over prompts, rivals, support around a frame, runs of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.config import DEFAULTS
from reelgrid.functions.numbers import dot
from reelgrid.operators.intervals import islands


def score_tags(frames: DataFrame, prompts: DataFrame, keep: list[str], block: int = 4096) -> DataFrame:
    """keep + (tag, role, score): each frame's best similarity over a tag's prompts of a role ("own" or "rival").

    prompts: (tag, role, vector), counted and broadcast in blocks of about `block` rows; the product is one row a frame
    and prompt and is reduced at once.
    """
    blocks, out = -(-prompts.count() // block) or 1, None
    for k in range(blocks):
        some = prompts.where(F.pmod(F.xxhash64("tag", "role", "vector"), F.lit(blocks)) == k)
        pairs = frames.join(F.broadcast(some), F.lit(True), "inner")
        scored = pairs.select(*keep, "tag", "role", dot(F.col("emb"), F.col("vector")).alias("score"))
        best = scored.groupBy(*keep, "tag", "role").agg(F.max("score").alias("score"))
        out = best if out is None else out.unionByName(best)
    return out if blocks == 1 else out.groupBy(*keep, "tag", "role").agg(F.max("score").alias("score"))


def score_tags_dense(frames: DataFrame, prompts: DataFrame, keep: list[str]) -> DataFrame:
    """keep + (tag, score, rival): the same by matrix products over Arrow batches, in single precision; for vocabularies
    of hundreds of prompts."""
    rows = prompts.select("tag", "role", "vector").collect()
    tags = sorted({r["tag"] for r in rows})
    shared = frames.sparkSession.sparkContext.broadcast((tags, [(r["tag"], r["role"]) for r in rows], np.array([r["vector"] for r in rows], np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, owner, vectors = shared.value
        own = [[i for i, o in enumerate(owner) if o == (t, "own")] for t in names]
        other = [[i for i, o in enumerate(owner) if o == (t, "rival")] for t in names]
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                x = part.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(part), -1)
                s = x @ vectors.T
                best = np.stack([s[:, c].max(1) if c else np.full(len(s), -1, np.float32) for c in own], 1)
                rival = np.stack([s[:, c].max(1) if c else np.full(len(s), -1, np.float32) for c in other], 1)
                row = pa.array(np.repeat(np.arange(len(part)), len(names)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(row) for k in keep), pa.array(names * len(part)), pa.array(best.ravel().astype(float)), pa.array(rival.ravel().astype(float))], names=[*keep, "tag", "score", "rival"]
                )

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keep)
    return frames.select(*keep, "emb").mapInArrow(run, f"{kinds}, tag string, score double, rival double")


def distill(
    scores: DataFrame, scene: str = "scene", event: str = "event", threshold: float = DEFAULTS.tag_threshold, strong: float = DEFAULTS.tag_strong, margin: float = DEFAULTS.tag_margin, support: int = DEFAULTS.event_support
) -> DataFrame:
    """scores (…, tag, score, rival) with keep: a hit beats its rivals by the margin, and is strong, or another frame of
    its scene has it too, or `support` others of its event.

    Hits of a scene and of an event are counted by aggregation (combined on the map side) and joined back.
    """
    ok = (F.col("score") >= threshold) & (F.col("score") - F.col("rival") >= margin)
    hits = scores.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    only = hits.where("__ok")
    in_scene = only.groupBy(scene, "tag").agg(F.count("*").alias("__s"))
    in_event = only.groupBy(event, "tag").agg(F.count("*").alias("__e"))
    both = hits.join(in_scene, [scene, "tag"], "left").join(in_event, [event, "tag"], "left")
    around = (F.col("score") >= strong) | (F.col("__s") >= 2) | (F.col("__e") - 1 >= support)
    return both.withColumn("keep", F.col("__ok") & F.coalesce(around, F.lit(False))).drop("__ok", "__s", "__e")


def tag_runs(hits: DataFrame, keys: list[str], gap: float = DEFAULTS.vision_step, threshold: float = DEFAULTS.tag_threshold) -> DataFrame:
    """Runs of frames (t, t_end, score) of a tag at or above the threshold: keys, tag, t, t_end, the best score."""
    return islands(hits.where(F.col("score") >= threshold), [*keys, "tag"], "t", "t_end", gap, "score")


def tag_counts(vocabulary: DataFrame, tags: DataFrame, catalog: DataFrame, workspace: str) -> DataFrame:
    """vocabulary with count: scenes of the workspace that have the tag, 0 for none."""
    own = catalog.where(F.col("workspace") == workspace).select("tape_id", "scene_id")
    n = tags.join(own, ["tape_id", "scene_id"], "left_semi").groupBy(F.col("tag").alias("id")).agg(F.countDistinct("tape_id", "scene_id").alias("count"))
    return vocabulary.join(n, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def tags_by_category(counted: DataFrame) -> DataFrame:
    """(cat, tags): tags that any scene has, the most frequent first."""
    order = Window.partitionBy("cat").orderBy(F.desc("count"), "id")
    return counted.where("count > 0").withColumn("rank", F.row_number().over(order)).select("cat", "id", "count", "rank")


def held_frames(frames: DataFrame, keys: list[str], step: float, most_gap: float = 10.0, change: float = 10.0) -> DataFrame:
    """(keys, t, t_end): pictures as they are followed: from a usable frame until it differs, is blank or lasts most_gap.

    frames: keys, i, usable, thumb (array of numbers). Each picture is compared with the one that is held, so the order
    of a scene decides; a scene is one group.
    """
    import pandas as pd

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for f in group.sort_values("i").itertuples():
            t, x = f.i * step, np.asarray(f.thumb, float)
            if held and f.usable and np.abs(x - held[2]).mean() <= change and t - held[0] < most_gap:
                held[1] = t + step
                continue
            if held:
                out.append(held[:2])
            held = [t, t + step, x] if f.usable else None
        if held:
            out.append(held[:2])
        return pd.DataFrame([(*group.iloc[0][keys], *o) for o in out], columns=[*keys, "t", "t_end"])

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.groupBy(*keys).applyInPandas(follow, f"{kinds}, t double, t_end double")
