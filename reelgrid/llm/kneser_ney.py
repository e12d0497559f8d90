"""Quality classifier: interpolated modified Kneser-Ney model of word n-grams, trained on trusted text (word_model).

Every language of the trusted documents has a model and limits of its own; null languages and those without trusted text
use a pooled one, which is only trained where a document needs it. N-grams, contexts, probabilities and scores meet in
joins; nothing that grows with the input is gathered or broadcast.

A document is rejected when its perplexity is above the quantile of the trusted documents of its language and length
class (short texts scatter more). Four fifths of the trusted documents train the model, the others, which it has not
seen, set the limits. Both come from sums, which combine on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm import word_model
from reelgrid.llm.mixing import word_count
from reelgrid.llm.symbol_model import ALPHABET, SYMBOLS, log_table, lookup, sorted_model, train  # noqa: F401  the small form
from reelgrid.llm.words import small_batches
from reelgrid.plans.scratch import in_rounds, materialise, release

POOLED = "*"
_BINS = 10_000
#: bytes of text from which work is cut into rounds, and the most rounds; bytes of text for each shard of the scores
ROUND_BYTES, ROUNDS, SHARD_BYTES = 24 << 20, 4, 8 << 20


def _held() -> Column:
    """True for a fifth of all texts, by their bytes: equal texts are on one side."""
    return F.coalesce(F.crc32("text") % 5 == 0, F.lit(False))


def _has_words() -> Column:
    return F.coalesce(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0, F.lit(False))


def _length_class() -> Column:
    """Texts of one class differ in length by less than a factor of two."""
    return F.least(F.lit(21), F.length(F.bin("n_symbols"))).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ids that labels call good (quality 1) and not toxic, in all of their rows."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("trusted"))
    good = known.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 and t = 0").select("trusted")


def _keyed(documents: DataFrame, carry: list[str], known: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(row, text, model, key): the carried columns travel as one, so that no name of theirs clashes; equal keys score alike."""
    src = documents.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    src = src.join(known, F.col("lang") == F.col("known"), "left").select("row", "text", F.coalesce("known", F.lit(POOLED)).alias("model"))
    return src.withColumn("key", F.xxhash64("text", "model"))


@dataclass
class Fitted:
    """known: languages with a model of their own; scores: row, key, model, n_symbols, bits, limit of each document."""

    known: DataFrame
    scores: DataFrame

    def rejected(self) -> Column:
        return F.coalesce((F.col("n_symbols") > 0) & (F.floor(F.col("bits") * _BINS) > F.col("limit")), F.lit(False))


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 2, quantile: float = 0.998,
    least: int = 200,
) -> Fitted | None:
    """A model trained on four fifths of all documents that labels trust, and the scores of all documents; None without any.

    A limit is the quantile of the trusted documents held out of a model and length class, where there are `least` of
    them, else of the model's, if any, else of all. Where no trusted text happens to be held out, the limits come from
    those that trained it.
    """
    spark = small_batches(documents).sparkSession
    texts = documents.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(_has_words())
    languages = materialise(texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")), "languages")
    size = languages.agg(F.sum("bytes")).first()[0] or 0
    rounds = min(ROUNDS, 1 + size // ROUND_BYTES)
    ids = materialise(trusted_ids(labels, id_col), "ids")

    def taught(k: int) -> DataFrame:
        # dealt out by id at every size: the ids grow with the labels
        mine = ids.where(F.pmod(F.xxhash64("trusted"), F.lit(rounds)) == k).hint("merge")
        some = texts.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k).where(~_held())
        return some.join(mine, F.col("id") == F.col("trusted"), "left_semi").select("lang", "text")

    trusted = in_rounds(spark, taught, rounds, "taught")
    if trusted.isEmpty():
        return None
    own = trusted.where(F.col("lang") != POOLED)
    known = materialise(own.select(F.col("lang").alias("known")).distinct(), "known")
    if not languages.join(known, F.col("lang") == F.col("known"), "left_anti").isEmpty():
        own = own.unionByName(trusted.withColumn("lang", F.lit(POOLED)))
    model, unknown = word_model.train(own.select("lang", F.xxhash64("lang").alias("salt"), "text"), order, rounds)
    release(trusted)

    keyed = _keyed(documents, [id_col, lang_col], known, text_col, lang_col)
    asked = keyed.where(F.length("text") > 0).select("key", F.xxhash64("model").alias("salt"), "text")
    found = word_model.score(asked, model, order, rounds, max(1, size * order // (2 * SHARD_BYTES * rounds)))
    scores = keyed.select("row", "key", "model", _held().alias("held")).join(found, "key", "left")
    scores = scores.join(unknown.withColumnRenamed("lang", "model"), "model", "left")
    bits = F.col("unknown") - F.col("v") / word_model.ONE / F.col("n")
    scores = materialise(scores.select("row", "key", "model", "held", F.coalesce("n", F.lit(0)).cast("long").alias("n_symbols"), bits.alias("bits")), "scores")

    trusted = scores.where("n_symbols > 0").select(F.col(f"row.`{id_col}`").alias("id"), "held", "model", "n_symbols", "bits")
    trusted = materialise(trusted.join(ids.hint("merge"), F.col("id") == F.col("trusted"), "left_semi"), "trusted")
    bins = trusted.where("held") if not trusted.where("held").isEmpty() else trusted
    bins = materialise(bins.groupBy("model", _length_class().alias("size"), F.floor(F.col("bits") * _BINS).alias("bin")).agg(F.count("*").alias("n")), "bins")

    def limit(name: str, *by: str) -> DataFrame:
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        h = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        h = h.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("all", F.sum("n").over(part))
        return materialise(h.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*by).agg(F.min("bin").alias(name), F.first("all").alias("all")), name)

    fine, coarse, one = limit("fine", "model", "size").where(F.col("all") >= least).drop("all"), limit("coarse", "model").drop("all"), limit("one").drop("all")
    scores = scores.withColumn("size", _length_class()).join(fine, ["model", "size"], "left").join(coarse, "model", "left").crossJoin(F.broadcast(one))
    return Fitted(known, scores.select("row", "key", "model", "n_symbols", "bits", F.coalesce("fine", "coarse", "one").alias("limit")))


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, lang, n_symbols (words and the end), perplexity (a symbol), threshold, kept of each document.

    null texts and those without words have no perplexity and are kept; so is everything if labels trust no document
    with words. null languages use the pooled model. labels: doc_id, quality, toxic; ids that it lacks, nulls and repeats
    are allowed; a document is trusted if all rows of its id call it good and none toxic. Repeated rows of documents are
    documents of their own. Other columns are left aside.
    """
    fitted = fit(documents, labels, id_col, text_col, lang_col, **options)
    if fitted is None:
        n = word_count(text_col).cast("long")
        none = F.lit(None).cast("double")
        return documents.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.when(n > 0, n + 1).otherwise(0).alias("n_symbols"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    some = F.col("n_symbols") > 0
    return fitted.scores.select(
        F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{lang_col}`").alias("lang"), "n_symbols", F.when(some, F.pow(F.lit(2.0), "bits")).alias("perplexity"),
        F.when(some, F.pow(F.lit(2.0), (F.col("limit") + 1) / F.lit(float(_BINS)))).alias("threshold"), (~fitted.rejected()).alias("kept"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """documents without those that classify() rejects; columns as they are."""
    fitted = fit(documents, labels, id_col, text_col, lang_col, **options)
    if fitted is None:
        return documents
    bad = materialise(fitted.scores.where(fitted.rejected()).select("key").distinct(), "rejected").hint("merge")
    return _keyed(documents, documents.columns, fitted.known, text_col, lang_col).join(bad, "key", "left_anti").select("row.*")
