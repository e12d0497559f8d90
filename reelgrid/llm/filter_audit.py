"""Filter interaction audit: what five filters remove together, in each of their 120 orders, from counts of 32 sets of failures."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_COUNTED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS part, coalesce(text, '') AS text, doc_id FROM documents),
first AS (SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
marked AS (
  SELECT d.part, d.doc_id, d.text, f.first_id, list_filter(string_split_regex(d.text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM docs d JOIN first f ON d.text = f.text),
sets AS (
  SELECT m.part,
    (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
    + 4 * (100 * length(regexp_replace(m.text, '[^A-Z]', '', 'g')) > 10 * length(m.text))::int
    + 8 * regexp_matches(m.text, '[#$%&*|]')::int + 16 * coalesce(first_id < doc_id, false)::int AS failed,
    coalesce((SELECT bool_or(l.quality = 1) FROM labels l WHERE l.doc_id = m.doc_id), false) AS good,
    coalesce((SELECT bool_or(l.toxic = 1) FROM labels l WHERE l.doc_id = m.doc_id), false) AS toxic
  FROM marked m),
counts AS (SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM sets GROUP BY ALL),
letters AS (SELECT chr(65 + i::int) AS letter, 1 << i::int AS bit FROM range(5) t(i)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s::int AS step, bits[s] AS bit, list_sum(bits[1:s - 1])::bigint AS before FROM orders, range(1, 6) t(s))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (failed & (coalesce(before, 0) | bit) = 0), 0)::bigint AS kept,
  coalesce(sum(n) FILTER (failed & bit > 0 AND failed & coalesce(before, 0) = 0), 0)::bigint AS removed,
  coalesce(sum(n) FILTER (failed & bit > 0 AND failed & coalesce(before, 0) > 0), 0)::bigint AS redundant,
  coalesce(sum(n) FILTER (failed = bit), 0)::bigint AS unique_fails,
  coalesce(sum(good) FILTER (failed & bit > 0 AND failed & coalesce(before, 0) = 0), 0)::bigint AS good_lost,
  coalesce(sum(toxic) FILTER (failed & bit > 0 AND failed & coalesce(before, 0) = 0), 0)::bigint AS toxic_lost,
  coalesce(sum(n * (120 // greatest(1, bit_count(failed::int)))) FILTER (failed & bit > 0), 0)::bigint AS shapley
FROM counts, steps GROUP BY ALL
"""


def _masks(order: tuple[int, ...], step: int) -> dict:
    """Which of the 32 sets of failures count where, when the filters in `order` run and `step` of them ran before."""
    bit, before = 1 << order[step], sum(1 << f for f in order[:step])
    every = range(1 << len(order))
    return {
        "filter_order": "".join(FILTERS[f] for f in order), "step": step + 1,
        "kept": [m for m in every if not m & (before | bit)], "removed": [m for m in every if m & bit and not m & before],
        "redundant": [m for m in every if m & bit and m & before], "unique": [bit], "failing": [m for m in every if m & bit],
    }


def _steps() -> Column:
    """All steps of all orders as one literal array."""
    lists = ", ".join(f"{k} array<int>" for k in ("kept", "removed", "redundant", "unique", "failing"))
    rows = [_masks(order, step) for order in permutations(range(len(FILTERS))) for step in range(len(FILTERS))]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<filter_order string, step int, {lists}>>")


def word_totals(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words, n_distinct) of texts with words, from a row per word; documents: doc_id, digest, text.

    Texts are dealt out by (doc_id, digest), which is less than their words would be, and both aggregations keep to that:
    no word moves, and a frequent one gathers nowhere. Rows alike in both keys are one group.
    """
    spaced = F.col("text")
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    dealt = documents.repartition("doc_id", "digest")
    words = dealt.select("doc_id", "digest", F.explode(F.split(spaced, " ")).alias("word")).where("word <> ''")
    each = words.groupBy("doc_id", "digest", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id", "digest").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failures(documents: DataFrame) -> DataFrame:
    """A row per document, in no order: part, doc_id, failed (a bit for each filter: A 1, B 2, C 4, D 8, E 16).

    Only hashes, flags and counts meet in joins. Of texts that occur once the hash goes no further than its group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = docs.select(
        "doc_id", "part", F.xxhash64("text").alias("digest"), F.md5("text").alias("same"),
        (F.length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.length("text") * 10).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"),
    )
    copies = flags.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_same")).where("n_same > 1")
    totals = word_totals(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")).withColumnsRenamed({"doc_id": "id", "digest": "text_digest"})
    times = flags.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    words = times.join(totals, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text_digest")), "left").select(
        F.col("doc_id").alias("id"), F.col("digest").alias("text_digest"), F.expr("coalesce(n_words, 0L) div times AS n_words"), F.expr("coalesce(n_distinct, 0L) AS n_distinct")
    )
    joined = flags.join(words, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text_digest")), "left")
    fails = (
        F.col("n_words") < 100, F.col("n_distinct") * 100 < F.col("n_words") * 80, F.col("c"), F.col("d"),
        F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)),
    )
    failed = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return joined.join(copies, "same", "left").select("part", "doc_id", failed.alias("failed"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each place of each order: part, filter_order, step and the counts of that step.

    documents: doc_id, text, lang; labels: doc_id, quality, toxic. Failures: A under 100 words, B 100*distinct < 80*words,
    C 100*[A-Z] > 10*code points, D any of #$%&*|, E identical to the text of a smaller doc_id anywhere. Words lie between
    spaces and 0x09-0x0D and are case-sensitive. null text is empty, null lang the part ''. kept: after the step; removed:
    at it; redundant: fail its filter but went before; unique_fails: fail that filter only; good_lost, toxic_lost: removed
    at the step with a label quality=1, toxic=1; shapley: removed by the filter, summed over all orders.

    A null doc_id is never smaller than another nor larger. Repeated rows count each. A document with several labels has
    what any of them says. Empty documents: no rows. Other columns are left aside.
    """
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = failures(documents).join(marks, "doc_id", "left")
    counted = [F.count_if((F.col("failed") == m) & x).alias(f"{name}{m}") for name, x in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in range(32)]
    table = rows.groupBy("part").agg(*counted).select("part", *(F.array(*(f"{name}{m}" for m in range(32))).alias(name) for name in ("n", "good", "toxic")), F.explode(_steps()).alias("s"))

    def total(masks: str, of: str = "n", share: bool = False) -> Column:
        def one(m: Column) -> Column:
            return F.get(F.col(of), m) * (F.floor(120 / F.bit_count(m)) if share else 1)

        return F.aggregate(F.col(masks), F.lit(0).cast("long"), lambda acc, m: acc + one(m))

    values = (
        total("s.kept"), total("s.removed"), total("s.redundant"), total("s.unique"), total("s.removed", "good"), total("s.removed", "toxic"), total("s.failing", share=True),
    )
    return table.select("part", "s.filter_order", "s.step", *(v.cast("long").alias(name) for name, v in zip(_COUNTED, values, strict=True)))
