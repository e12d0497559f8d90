"""Interpolated modified Kneser-Ney model of word n-grams, in joins by n-gram: nothing of it is gathered or broadcast.

A word is a maximal run of bytes other than white space; a text is its words between marks, and its end is predicted
too. Words are known by 64-bit hashes salted with the language, so no n-gram of one language meets another's.

Training: n-grams are counted; lower orders count the words that precede. Counts meet the totals of their contexts in a
join by context, and the probability of their suffix in a join by suffix.

Scoring: written as logarithms, the back-off form is a sum over the n-grams of a text that the model knows:

    log p(w | u) = log p(w | shorter u) + log weight(u) + extra(u w)

where the weight is 1 for unknown contexts and extra is 0 for unknown n-grams. So one table of (key of an n-gram, value)
is all that a text needs, in one join: texts ask for the keys of their n-grams, dealt out by key with the table, and
the answers are summed by text. Values are whole multiples of 2 ** -20, so sums don't depend on their order.

Large inputs go in rounds over parts of the keys, each written and its shuffle files dropped before the next, so that
the disk in use stays a share of the whole work; every key belongs to one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.words import as_long, blocks, mix
from reelgrid.plans.scratch import in_rounds, materialise, release

MARK = np.uint64(0x5BD1E9955BD1E995)
ONE = 1 << 20  # a bit
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    h = np.full(len(words[0]), 42, np.uint64)
    for w in words:
        h = h + _P[4] + np.uint64(8)
        h = _rotated(h ^ (_rotated(w * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        h ^= h >> np.uint64(32)
    return h


def _sequences(batch: pa.RecordBatch, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row in the batch, place, word) of all words of blocks of texts: order - 1 marks, the words, a mark; none without words."""
    salt = batch.column("salt").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for b in blocks(batch.column("text")):
        size = np.where(b.counts > 0, b.counts + order, 0)
        edge = np.concatenate(([0], np.cumsum(size)))
        row, own = np.repeat(np.arange(b.rows), size), b.row_of_word()
        x = np.full(int(edge[-1]), MARK)
        x[edge[own] + order - 1 + np.arange(len(own)) - b.first[own]] = b.hashes()
        yield b.lo + row, np.arange(len(x)) - edge[row], mix(x ^ salt[b.lo + row])


def _count(order: int, k: int, rounds: int):
    """mapInArrow: the n-grams of a round, counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, x in _sequences(batch, order):
                end = np.flatnonzero(place >= order - 1)
                key = gram_keys([x[end - i] for i in range(order - 1, -1, -1)])
                here = np.flatnonzero(key % np.uint64(rounds) == k)
                _, first, c = np.unique(key[here], return_index=True, return_counts=True)
                end = end[here[first]]
                words = [pa.array(as_long(x[end - i])) for i in range(order - 1, -1, -1)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row[end])), *words, pa.array(c)], names=["lang", *_words(order), "c"])

    return run


def _words(n: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, n + 1)]


def _part(words: list[str], k: int, rounds: int) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(rounds)) == k


def discounts(g: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of the n-grams counted in g (lang, c)."""
    y = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    share = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [
        F.least(F.lit(k * 0.95), F.greatest(F.lit(0.05 * k), F.when(F.col(f"n{k}") > 0, k - (k + 1) * share * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5 * k))).alias(f"d{k}")
        for k in (1, 2, 3)
    ]
    return g.groupBy("lang").agg(*y).select("lang", *d)


def _contexts(g: DataFrame, n: int) -> DataFrame:
    """(lang, words of the context, total, w, d1, d2, d3): w is what the context leaves to the order below."""
    discount = materialise(discounts(g), "discounts")  # a row a language, so that Spark sees its size
    totals = g.groupBy("lang", *_words(n - 1)).agg(
        F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("k1"), F.count_if(F.col("c") == 2).alias("k2"), F.count_if(F.col("c") > 2).alias("k3")
    )
    weight = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
    out = totals.join(discount, "lang").withColumn("w", weight)
    if n == 1:
        out = out.withColumn("low", 1 / (F.col("k1") + F.col("k2") + F.col("k3") + 1))
    return materialise(out.drop("k1", "k2", "k3"), "contexts")


def train(trusted: DataFrame, order: int, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, v): the values of n-grams; and (lang, unknown): bits of a word that its language's texts lack.

    trusted: lang, salt (of the language), text.
    """
    columns = ", ".join(f"{w} long" for w in _words(order))
    levels, narrow = {}, 2 * rounds if rounds > 1 else 1  # rounds that read no text are cheap
    for n in range(order, 0, -1):

        def counts(k: int, n: int = n) -> DataFrame:
            if n == order:
                g = trusted.mapInArrow(_count(order, k, rounds), f"lang string, {columns}, c long").groupBy("lang", *_words(n)).agg(F.sum("c").alias("c"))
            else:
                above = levels[n + 1].where(_part(_words(n + 1, 2), k, rounds))
                g = above.groupBy("lang", *(F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, n + 1))).agg(F.count("*").alias("c"))
            return g.sortWithinPartitions(*_words(n))

        levels[n] = in_rounds(trusted.sparkSession, counts, rounds, "counts")
    values, lower, unknown = [], None, None
    for n in range(1, order + 1):
        contexts = _contexts(levels[n], n)

        def probabilities(k: int, n: int = n, contexts: DataFrame = contexts, lower: DataFrame | None = lower) -> DataFrame:
            if n == 1:
                own = levels[n].where(_part(["w1"], k, narrow)).join(contexts, "lang")
            else:
                own = levels[n].where(_part(_words(n, 2), k, narrow)).join(contexts, ["lang", *_words(n - 1)])
                low = lower.where(_part(_words(n - 1), k, narrow)).select("lang", *(F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, n)), F.col("p").alias("low"))
                own = own.join(low, ["lang", *_words(n, 2)])
            less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
            own = own.withColumn("rest", F.col("w") * F.col("low")).withColumn("p", (F.col("c") - less) / F.col("total") + F.col("rest"))
            key, value = F.xxhash64(*_words(n)).alias("key"), F.round(F.log2(F.col("p") / F.col("rest")) * ONE).cast("long").alias("v")
            return own.select("lang", *_words(n), "p", key, value) if n < order else own.select(key, value)

        done = in_rounds(trusted.sparkSession, probabilities, narrow, "probabilities")
        values.append(done.select("key", "v"))
        if n == 1:
            unknown = contexts.select("lang", (-F.log2(F.col("w") * F.col("low"))).alias("unknown"))
        else:
            values.append(contexts.select(F.xxhash64(*_words(n - 1)).alias("key"), F.round(F.log2("w") * ONE).cast("long").alias("v")))
        release(levels[n])
        lower = done
    return reduce(DataFrame.unionByName, values), unknown


def _short(x: np.ndarray) -> np.ndarray:
    """Small numbers in 16 bits, which numpy sorts in linear time."""
    return x.astype(np.uint16) if x.max() < 1 << 16 else x


ASKED = "shard int, texts binary, row binary, gram binary, c binary, n binary"


def _ask(order: int, k: int, rounds: int, shards: int):
    """mapInArrow: the n-grams of a round by shard: for each batch the keys of its texts, and rows of (text, n-gram, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("key").to_numpy(zero_copy_only=False)
            for row, place, x in _sequences(batch, order):
                keys, rows, one = [], [], []
                for m in range(1, order + 1):
                    # shorter n-grams are contexts too, the first of which ends with the mark before the text
                    end = np.flatnonzero(place >= order - (2 if 1 < m < order else 1))
                    key = gram_keys([x[end - i] for i in range(m - 1, -1, -1)])
                    here = key.view(np.int64) % (rounds * shards) % rounds == k
                    keys.append(key[here]), rows.append(row[end[here]]), one.append(np.full(int(here.sum()), m == 1))
                key, row, one = np.concatenate(keys).view(np.int64), np.concatenate(rows), np.concatenate(one)
                if not len(key):
                    continue
                shard = key % (rounds * shards) // rounds
                by = np.argsort(key)
                for of in (row, shard):
                    by = by[np.argsort(_short(of)[by], kind="stable")]
                key, row, shard, one = key[by], row[by], shard[by], one[by]
                new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
                c = np.diff(np.append(new, len(key)))
                key, row, shard, one = key[new], row[new], shard[new], one[new]
                edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
                out = []
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    own, at = np.unique(row[a:b], return_inverse=True)
                    n = np.bincount(at, c[a:b] * one[a:b], len(own)).astype(np.int32)
                    out.append((int(shard[a]), texts[own].tobytes(), at.astype(np.int32).tobytes(), key[a:b].tobytes(), c[a:b].astype(np.int32).tobytes(), n.tobytes()))
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "texts", "row", "gram", "c", "n"])

    return run


def _meet(asked: pa.Table, known: pa.Table) -> pa.Table:
    """applyInArrow: what the known n-grams of a shard give each text (key, v), and its words that belong here (n); equal texts once."""
    grams, at = np.unique(known.column("key").to_numpy(), return_inverse=True)
    value = np.bincount(at, known.column("v").to_numpy(), len(grams))
    value = np.append(value, 0.0)  # exact: whole numbers far below 2 ** 53
    grams = np.append(grams, 0) if len(grams) == 0 else grams
    keys, sums, counts = [], [], []
    for texts, row, gram, c, n in zip(*(asked.column(x).to_pylist() for x in ("texts", "row", "gram", "c", "n")), strict=True):
        texts, row, gram, c, n = (np.frombuffer(b, t) for b, t in ((texts, np.int64), (row, np.int32), (gram, np.int64), (c, np.int32), (n, np.int32)))
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        v = np.where(grams[at] == gram, value[at], 0.0)
        keys.append(texts), sums.append(np.bincount(row, v * c, len(texts)).astype(np.int64)), counts.append(n.astype(np.int64))
    if not keys:
        return pa.table({x: pa.array([], pa.int64()) for x in ("key", "v", "n")})
    key, first = np.unique(np.concatenate(keys), return_index=True)
    return pa.table({"key": key, "v": np.concatenate(sums)[first], "n": np.concatenate(counts)[first]})


def score(texts: DataFrame, model: DataFrame, order: int, rounds: int = 1, shards: int = 1) -> DataFrame:
    """(key, v, n) of each key with words: what the model's n-grams give, and the words, the end counted.

    texts: key (equal only for equal texts of a language), salt, text. Each round has `shards` shards.
    """

    def summed(k: int) -> DataFrame:
        asked = texts.select("key", "salt", "text").mapInArrow(_ask(order, k, rounds, shards), ASKED)
        slot = F.pmod("key", F.lit(rounds * shards))
        known = model.where(slot % rounds == k).select(F.floor(slot / rounds).cast("int").alias("shard"), "key", "v")
        got = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_meet, "key long, v long, n long")
        return got.groupBy("key").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))

    parts = in_rounds(texts.sparkSession, summed, rounds, "summed")
    return parts.groupBy("key").agg(F.sum("v").alias("v"), F.sum("n").alias("n")) if rounds > 1 else parts
