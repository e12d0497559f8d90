"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. Sizes are counted in one pass over the text and written as a narrow table. The level of the
water-filling is found by Newton steps on a concave, piecewise linear function: each is one aggregation over the
sources, of which three numbers reach the driver. Every document of a source is repeated floor(target / size of source)
times; what is left goes, in the order of a seeded hash, to one more pass of whole documents until the target is
reached. The order of a source is never sorted in one task: hashes fall into 4096 bins, bins are summed by partial
aggregation, the one bin in which the target is reached is parted in 4096 again, and only the one part of it in which
the target is reached is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.plans.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
BIN_DIGITS = 3  # hexadecimal


def word_count(text: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _order(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with __rank, from 0 in ascending order of __source, null last: ranges first, so no task sorts all."""
    dealt = sources.repartitionByRange(F.col("__source").asc_nulls_last())
    dealt = materialise(dealt.withColumn("__part", F.spark_partition_id()), "sources")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each partition at most
    parts = parts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("__source").asc_nulls_last()))
    return dealt.join(parts, "__part").select("__source", "__size", (F.col("__from") + inside - 1).alias("__rank"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(__source, __size, __target) of each source of sized (__source, __words).

    Sources in code point order, null last, weigh `weights`, repeating. They share `budget` times all words by weight;
    a target stops at max_epochs times its source's words and the excess is shared anew by weight.
    """
    if not weights or min(weights) <= 0 or max_epochs <= 0 or not 0 <= budget <= max_epochs:
        raise ValueError("weights and max_epochs must be positive and the budget within max_epochs")
    sums = _ranked(sized.groupBy("__source").agg(F.sum("__words").alias("__size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__rank"), F.lit(len(weights))) + 1).cast("int"))
    sums = materialise(sums.withColumn("__weight", weight).withColumn("__cap", F.lit(float(max_epochs)) * F.col("__size")), "sums")
    all_words, all_weight = sums.agg(F.sum("__size"), F.sum("__weight")).first()
    total = float(budget) * (all_words or 0)
    held, free, clamped = 0.0, all_weight or 0.0, 0
    while free:
        level = F.col("__weight") * F.lit(total - held) / F.lit(free)
        full = F.col("__cap") < level
        row = sums.agg(F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("__weight"))), F.count_if(full)).first()
        if row[2] == clamped:
            break
        held, free, clamped = row[0] or 0.0, row[1] or 0.0, row[2]
    share = F.col("__weight") * F.lit(total - held) / F.lit(free) if free else F.lit(float("inf"))
    return sums.select("__source", "__size", F.least(share, "__cap").alias("__target"))


def _narrowed(plan: DataFrame, sized: DataFrame, seed: str, digits: int) -> DataFrame:
    """plan with __last, the first `digits` of the hashes with which a source's target is reached, within those known so
    far, and __before, the words of all hashes below."""
    held = plan.select(F.col("__source").alias("__s"), "__rest", "__last", "__before")
    rows = sized.select("__source", "__words", F.substring(_order("__id", seed), 1, digits).alias("__bin"))
    inside = rows.join(held, F.col("__source").eqNullSafe(F.col("__s"))).where(F.col("__bin").startswith(F.col("__last")))
    bins = inside.groupBy("__s", "__rest", "__before", "__bin").agg(F.sum("__words").alias("__n"))
    upto = Window.partitionBy("__s").orderBy("__bin")  # at most 16 ** BIN_DIGITS rows a source
    bins = bins.withColumn("__upto", F.col("__before") + F.sum("__n").over(upto)).where("__upto >= __rest")
    found = bins.groupBy("__s").agg(F.min(F.struct("__bin", "__upto", "__n")).alias("b")).select("__s", F.col("b.__bin").alias("__at"), (F.col("b.__upto") - F.col("b.__n")).alias("__below"))
    out = plan.drop("__last", "__before").join(found, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return out.withColumnsRenamed({"__at": "__last", "__below": "__before"})


def taken(documents: DataFrame, size: Column, plan: DataFrame, sized: DataFrame, seed: str, whole: bool) -> DataFrame:
    """documents (__id, __source, any more) with __taken, __size and __target.

    sized: (__id, __source, __words), the same documents without their text. whole: the document in which the target is
    reached is taken once more or not, whichever comes nearer; else just the words that are missing.
    """
    base = F.when(F.col("__size") > 0, F.floor(F.col("__target") / F.col("__size"))).otherwise(0).cast("long")
    plan = plan.withColumn("__base", base).withColumn("__rest", F.round("__target").cast("long") - F.col("__base") * F.col("__size"))
    plan = plan.withColumn("__last", F.lit("")).withColumn("__before", F.lit(0).cast("long"))
    for level in (1, 2):
        plan = materialise(_narrowed(plan, sized, seed, level * BIN_DIGITS), "plan")
    plan = plan.withColumnRenamed("__source", "__s")
    marked = documents.withColumn("__order", _order("__id", seed)).withColumn("__bin", F.substring("__order", 1, 2 * BIN_DIGITS))
    joined = marked.join(plan, marked["__source"].eqNullSafe(plan["__s"]))
    sure = joined.where(F.coalesce(F.col("__bin") != F.col("__last"), F.lit(True))).withColumn("__words", size)
    extra = F.when(F.col("__bin") < F.col("__last"), F.col("__words")).otherwise(0)
    sure = sure.withColumn("__taken", F.col("__base") * F.col("__words") + extra)
    both = F.col("__order").startswith(F.col("__last")) & F.col("__bin").eqNullSafe(F.col("__last"))
    near = joined.where(both).withColumn("__words", size)
    run = Window.partitionBy("__s").orderBy("__order", "__words").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__words").over(run), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("__words"), F.col("__missing")))
    if whole:
        part = F.when(F.col("__missing") * 2 >= F.col("__words"), F.col("__words")).otherwise(0)
    near = near.withColumn("__missing", missing).withColumn("__taken", F.col("__base") * F.col("__words") + part).drop("__missing")
    return sure.unionByName(near)


def _sized(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(documents.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(text_col).alias("__words")), "sizes")


def mix(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5, max_epochs: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target (its source's), taken (words, repeats counted).

    The taken words of a source sum to its target, rounded. No document exceeds max_epochs times its size, rounded up
    to a whole pass. null and empty texts have no words and nothing is taken of them. A null source is a source, the
    last in order. Repeated rows are documents of their own; rows equal in id and size share their order and may swap.
    The same rows and seed give the same mix. Other columns are left aside. An empty table gives an empty result.
    """
    sized = _sized(documents, id_col, text_col, source_col)
    plan = targets(sized, weights, budget, max_epochs)
    out = taken(sized, F.col("__words"), plan, sized, seed, whole=False)
    return out.select(F.col("__id").alias("doc_id"), F.col("__words").alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5, max_epochs: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """The mix itself: documents' columns, a row for each whole pass over a document.

    As mix(), but a document is taken whole or not, so that texts stay whole: a source misses its target by half of
    one document at most. Documents without words are kept as often as whole passes over their source demand.
    """
    sized = _sized(documents, id_col, text_col, source_col)
    plan = targets(sized, weights, budget, max_epochs)
    # the row is one column, so that no name in it clashes
    rows = documents.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__row"))
    out = taken(rows, word_count(f"__row.`{text_col}`"), plan, sized, seed, whole=True)
    times = F.when(F.col("__words") > 0, F.round(F.col("__taken") / F.col("__words"))).otherwise(F.col("__base")).cast("int")
    return out.withColumn("__times", times).where("__times > 0").withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
  FROM sums WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT held, free, total FROM ordered WHERE cap >= w * (total - held) / free ORDER BY cap / w, source NULLS LAST LIMIT 1),
plan AS (
  SELECT s.source, s.source_size, least(s.w * (l.total - l.held) / l.free, 2.0::DOUBLE * s.source_size) AS target
  FROM sums s CROSS JOIN level l),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM plan)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (p.base * d.size + greatest(0, least(d.size, round(p.target)::BIGINT - p.base * p.source_size
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
"""
