"""Content search: vectors within a band of the best, people and tags that must or must not be there, moments."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.config import DEFAULTS
from reelgrid.functions.dates import within
from reelgrid.functions.numbers import dot
from reelgrid.operators import vector_blocks
from reelgrid.operators.intervals import islands
from reelgrid.plans.scratch import materialise

# Kinds of catalog rows.
KINDS = ("dv", "dvd", "video", "photo")
KEY = ["tape_id", "scene_id"]


@dataclass(frozen=True)
class Query:
    """What is searched for; vector: the encoded text, if any."""

    workspace: str = "default"
    vector: tuple[float, ...] | None = None
    tags: frozenset[str] = frozenset()
    not_tags: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()
    date_from: str = ""
    date_to: str = ""
    with_people: frozenset[int] = frozenset()
    without_people: frozenset[int] = frozenset()
    sort: str = "score"
    limit: int = 0
    config: object = field(default=DEFAULTS, compare=False)

    def asks(self) -> bool:
        """Without a text only a wanted tag or person, a choice of kinds or a date bound asks for anything."""
        kinds = self.kinds and self.kinds != frozenset(KINDS)
        return bool(self.vector or self.tags or self.with_people or kinds or self.date_from or self.date_to)


def having_all(rows: DataFrame, facts: DataFrame, keys: list[str], value: str, wanted: frozenset) -> DataFrame:
    """rows whose key has every wanted value in facts (division), by one aggregation of the wanted facts only."""
    if not wanted:
        return rows
    if len(wanted) == 1:  # no value needs to be counted
        return rows.join(facts.where(F.col(value).isin(*wanted)).select(*keys), keys, "left_semi")
    held = facts.where(F.col(value).isin(*wanted)).groupBy(*keys).agg(F.countDistinct(value).alias("__n")).where(F.col("__n") == len(wanted))
    return rows.join(held.select(*keys), keys, "left_semi")


def having_none(rows: DataFrame, facts: DataFrame, keys: list[str], value: str, avoided: frozenset) -> DataFrame:
    return rows.join(facts.where(F.col(value).isin(*avoided)).select(*keys), keys, "left_anti") if avoided else rows


def allowed(catalog: DataFrame, people: DataFrame, tags: DataFrame, q: Query) -> DataFrame:
    """Catalog rows that the search may return; people: (tape_id, scene_id, person_id), tags: (..., tag)."""
    rows = catalog.where((F.col("workspace") == q.workspace) & F.col("kind").isin(*(q.kinds or KINDS)) & within("date", q.date_from, q.date_to))
    rows = having_all(rows, people, KEY, "person_id", q.with_people)
    rows = having_none(rows, people, KEY, "person_id", q.without_people)
    rows = having_all(rows, tags, KEY, "tag", q.tags)
    return having_none(rows, tags, KEY, "tag", q.not_tags)


def in_band(scored: DataFrame, score: str = "score", floor: float = DEFAULTS.search_floor, band: float = DEFAULTS.search_band) -> DataFrame:
    """Rows at the floor or above and at most `band` below the best of all: scored once, written narrow, the best of all
    is one row that is joined back."""
    scored = materialise(scored, "scores")
    best = scored.agg(F.max(score).alias("__best"))
    kept = scored.join(F.broadcast(best), F.col(score) >= F.greatest(F.lit(floor), F.col("__best") - band))
    return kept.drop("__best")


def similar_frames(frames: DataFrame, rows: DataFrame, vector: tuple[float, ...], floor: float = DEFAULTS.search_floor, band: float = DEFAULTS.search_band) -> DataFrame:
    """Frames of the rows whose similarity with the vector lies in the band: frames are filtered before they are scored."""
    own = frames.join(rows.select(*KEY), KEY, "left_semi")
    q = F.array(*(F.lit(float(v)) for v in vector))
    return in_band(own.select(*KEY, "t", "t_end", dot(F.col("emb"), q).alias("score")), floor=floor, band=band)


def bands_of(asked: DataFrame, rows: DataFrame, asked_id: str, asked_vector: str, row_id: str, vector: str, block: int = vector_blocks.ASKED, floor: float = DEFAULTS.search_floor, band: float = DEFAULTS.search_band) -> DataFrame:
    """(asked_id, row_id, score) in the band of each asked vector's best. The asked come in blocks of about `block`; their
    products with all rows are taken by matrices twice: for the best of each, then for what can lie in its band."""
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(row_id, vector, F.size(vector).alias("__width"))
    kind, out = asked.schema[asked_id].dataType.simpleString(), None
    for width in sorted(r[0] for r in asked.select(F.size(asked_vector)).distinct().collect() if r[0] and r[0] > 0):  # one, as a rule
        own = whole.where(F.col("__width") == width).drop("__width")
        own = materialise(own.repartition(vector_blocks.spread(own.sparkSession, own.count() * asked.count())), "vectors")
        for ids, q in vector_blocks.asked_blocks(asked, asked_id, asked_vector, width, block):
            least = np.maximum(floor, vector_blocks.best_of_all(own, vector, q) - band)
            hits = materialise(vector_blocks.scored_above(own, [row_id], vector, asked_id, kind, ids, q, least), "scores")
            best = hits.groupBy(asked_id).agg(F.max("score").alias("__best"))
            hits = hits.join(best, asked_id).where(F.col("score") >= F.greatest(F.lit(floor), F.col("__best") - band)).drop("__best")
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        none = asked.select(asked_id).where(F.lit(False)).join(whole.select(row_id), F.lit(True))
        return none.withColumn("score", F.lit(0.0))
    return out


def moments_of(spans: DataFrame, gap: float, most: int = 12) -> DataFrame:
    """(tape_id, scene_id, score, moments): a scene's spans (t, t_end, score) merged, the first `most`, to a tenth."""
    merged = islands(spans, KEY, "t", "t_end", gap, "score")
    ranked = merged.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy("t", "t_end")))
    pair = F.when(F.col("__r") <= most, F.struct("__r", F.array(F.bround("t", 1), F.bround("t_end", 1)).alias("m")))
    out = ranked.groupBy(*KEY).agg(F.max("score").alias("score"), F.collect_list(pair).alias("m"))
    return out.select(*KEY, "score", F.transform(F.array_sort("m"), lambda x: x["m"]).alias("moments"))


def search(catalog: DataFrame, frames: DataFrame, tags: DataFrame, people: DataFrame, q: Query) -> DataFrame:
    """Scenes that answer the query, with score, moments, people and tags, total before the limit, in order of rank.

    people: (tape_id, scene_id, person_id, times); tags: (tape_id, scene_id, tag, t0, t1, score).
    """
    rows = allowed(catalog, people, tags, q)
    if not q.asks():
        rows = rows.where(F.lit(False))
    rows = materialise(rows, "rows")
    tags = materialise(tags.join(rows.select(*KEY), KEY, "left_semi"), "tags")  # no scene that can't be returned is looked at again
    people = people.join(rows.select(*KEY), KEY, "left_semi")
    step = q.config.vision_step
    if q.vector:
        hits = moments_of(similar_frames(frames, rows, q.vector, q.config.search_floor, q.config.search_band), step)
        found = rows.join(hits, KEY)
    else:
        if q.tags:
            spans, gap = tags.where(F.col("tag").isin(*q.tags)).select(*KEY, F.col("t0").alias("t"), F.col("t1").alias("t_end"), F.lit(0.0).alias("score")), step
        elif q.with_people:
            seen = people.where(F.col("person_id").isin(*q.with_people)).select(*KEY, F.explode(F.col("times").cast("array<double>")).alias("t"))
            spans, gap = seen.distinct().select(*KEY, "t", (F.col("t") + 1).alias("t_end"), F.lit(0.0).alias("score")), 3.0
        else:
            spans, gap = rows.select(*KEY, F.lit(0.0).alias("t"), F.least(F.coalesce("duration", F.lit(0.0)), F.lit(10.0)).alias("t_end"), F.lit(0.0).alias("score")), step
        found = rows.join(moments_of(spans.join(rows.select(*KEY), KEY, "left_semi"), gap), KEY, "left").withColumn("score", F.lit(0.0))
        found = found.withColumn("moments", F.coalesce("moments", F.array().cast("array<array<double>>")))
    found = found.join(top_people(people), KEY, "left").join(tags.groupBy(*KEY).agg(F.array_sort(F.collect_set("tag")).alias("tags")), KEY, "left")
    by_score = [F.col("score").desc(), F.col("tape_id"), F.col("scene_id")]
    order = by_score if q.vector and q.sort != "date" else date_order()
    out = found.withColumn("score", F.bround("score", 4)).withColumn("duration", F.bround(F.coalesce("duration", F.lit(0.0)), 2))
    out = materialise(out, "hits")  # worked out once, for the total and for the page
    return out.withColumn("total", F.lit(out.count()).cast("long")).orderBy(*order).limit(q.limit or q.config.search_limit)


def date_order() -> list[Column]:
    return [F.coalesce("date", F.lit("9999")), F.coalesce("time", F.lit("")), F.col("tape_id"), F.col("scene_id")]


def top_people(people: DataFrame, most: int = 8) -> DataFrame:
    """(tape_id, scene_id, people): the scene's people by seconds on screen."""
    n = people.groupBy(*KEY, "person_id").agg(F.sum(F.size("times")).alias("__n"))
    r = n.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("__n"), "person_id"))).where(F.col("__r") <= most)
    return r.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "person_id"))), lambda x: x["person_id"]).alias("people"))
