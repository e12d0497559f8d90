"""Interpolated modified Kneser-Ney over a small alphabet, whose whole table fits in an array.

The classifier doesn't use it: kneser_ney scores words by joins. It holds the same discounts as word_model against a dense
table: a text is a row of symbols, one a byte, of an alphabet of 44: letters, and classes of other bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.word_model import discounts
from reelgrid.llm.words import string_buffers
from reelgrid.plans.scratch import materialise

# The symbol of each byte.
SYMBOLS = 44
ALPHABET = np.full(256, 37, np.int32)
ALPHABET[0x20], ALPHABET[[9, 10, 11, 12, 13]] = 0, 1
ALPHABET[97:123], ALPHABET[65:91], ALPHABET[48:58] = np.arange(2, 28), 28, 29
for _symbol, _bytes in ((30, b"."), (31, b","), (32, b";:!?"), (33, b"\"'`"), (34, b"-_/\\"), (35, b"()[]{}"), (36, b"#$%&*+<=>@^|~")):
    ALPHABET[list(_bytes)] = _symbol
ALPHABET[0x80:0xA0], ALPHABET[0xA0:0xC0] = 42, 43
ALPHABET[0xC0:0xC4], ALPHABET[0xC4:0xE0], ALPHABET[0xE0:0xF0], ALPHABET[0xF0:] = 38, 39, 40, 41
POOLED = "*"


def _codes(column: pa.Array, order: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, n-gram codes, symbols of each text) for rows lo..hi; texts begin after line feeds."""
    data, edge = string_buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + limit, "right")) - 1)
        size = np.diff(edge[lo : hi + 1])
        pad = order - 1
        x = np.ones(int(size.sum()) + pad * (hi - lo), np.int32)
        place = np.arange(int(size.sum())) + np.repeat(np.arange(1, hi - lo + 1) * pad, size)
        x[place] = ALPHABET[data[edge[lo] : edge[hi]]]
        code = x[place].copy()
        for k in range(1, order):
            code += x[place - k] * np.int32(SYMBOLS**k)
        yield lo, hi, code, size
        lo = hi


def _count(order: int):
    """mapInArrow: n-gram counts by language of all texts of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                code = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(counts[code])], names=["lang", "code", "c"]
                )
            total.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, code, size in _codes(batch.column("text"), order):
                edge = np.concatenate(([0], np.cumsum(size)))
                for i in range(lo, hi):
                    if langs[i] not in total:
                        if len(total) == 8:
                            yield from drain()
                        total[langs[i]] = np.zeros(SYMBOLS**order, np.int64)
                    np.add.at(total[langs[i]], code[edge[i - lo] : edge[i - lo + 1]], 1)
        yield from drain()

    return run


def train(trusted: DataFrame, order: int = 4) -> tuple[list[str], list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Languages, and for each and each order: seen codes, their probabilities, contexts, their weights of lower orders.

    trusted: (lang, text). Each language gets a model of its own, those with most text first; a pooled one of all text
    serves null languages and those without trusted text.
    """
    spark = trusted.sparkSession
    grams = trusted.mapInArrow(_count(order), "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
    grams = materialise(grams, "grams")
    top = grams.where("lang is not null").groupBy("lang").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "lang").collect()
    names = [r["lang"] for r in top if r["lang"] != POOLED]
    pooled = grams.groupBy("code").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "code", "c")
    g = grams.where(F.col("lang").isNotNull() & (F.col("lang") != POOLED)).unionByName(pooled) if names else pooled
    levels = {order: materialise(g, "counts")}
    for n in range(order - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy("lang", (F.col("code") % SYMBOLS**n).alias("code")).agg(F.count("*").alias("c"))
    names = [*names, POOLED]
    model, lower = [], None
    for n in range(1, order + 1):
        lower = materialise(_probabilities(levels[n], lower, n), "probabilities")
        got = lower.toArrow()  # 44 ** n rows a language at most
        lang, code, p, ctx, w = (got.column(k).to_numpy() for k in ("lang", "code", "p", "ctx", "w"))
        for i, name in enumerate(names):
            here = lang == name
            model.append((i, n, code[here], p[here], ctx[here], w[here]))
    return names, sorted(model, key=lambda m: m[:2])


def _probabilities(g: DataFrame, lower: DataFrame | None, n: int) -> DataFrame:
    """(lang, code, p, ctx, w) of the n-grams counted in g (lang, code, c): w is what their context leaves to `lower`."""
    discount = discounts(g)
    ctx = F.floor(F.col("code") / SYMBOLS).cast("long")
    totals = g.groupBy("lang", ctx.alias("ctx")).agg(
        F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("k1"), F.count_if(F.col("c") == 2).alias("k2"), F.count_if(F.col("c") > 2).alias("k3")
    )
    weight = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
    own = g.withColumn("ctx", ctx).join(totals.join(discount, "lang").withColumn("w", weight), ["lang", "ctx"])
    less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    if lower is None:
        own = own.withColumn("low", F.lit(1.0 / SYMBOLS))
    else:
        low = lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("low"))
        own = own.withColumn("suffix", F.col("code") % SYMBOLS ** (n - 1)).join(low, ["lang", "suffix"])
    return own.select("lang", "code", ((F.col("c") - less) / F.col("total") + F.col("w") * F.col("low")).alias("p"), "ctx", "w")


def lookup(model: dict[int, tuple], order: int, code: np.ndarray) -> np.ndarray:
    """The probabilities of n-grams under one language's model: those not seen from their context's weight and suffix."""
    if order == 0:
        return np.full(len(code), 1.0 / SYMBOLS)
    seen, v, back, w = model[order]

    def of(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, out: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        out[hit] = values[at[hit]]
        return hit

    p = np.empty(len(code))
    rest = np.flatnonzero(~of(seen, v, code, p))
    if len(rest):
        weight = np.ones(len(rest))
        of(back, w, code[rest] // SYMBOLS, weight)
        p[rest] = weight * lookup(model, order - 1, code[rest] % SYMBOLS ** (order - 1))
    return p


def sorted_model(model: list) -> dict[int, dict[int, tuple]]:
    """For each language and order: seen codes with probabilities, contexts with weights, both in order."""
    out: dict[int, dict[int, tuple]] = {}
    for i, n, seen, v, ctx, w in model:
        by, (back, first) = np.argsort(seen), np.unique(ctx, return_index=True)
        out.setdefault(i, {})[n] = seen[by], v[by], back, w[first]
    return out


def log_table(model: list, languages: int, order: int) -> np.ndarray:
    """-log2 of the probability of each n-gram, by language; a row of 44 ** order for each."""
    out = np.empty((languages, SYMBOLS**order), np.float32)
    p = np.zeros(0)
    for i, k, seen, v, back, w in model:
        size = SYMBOLS ** (k - 1)
        weight = np.ones(size)
        weight[back] = w
        low = np.full((1, SYMBOLS), 1.0 / SYMBOLS) if k == 1 else np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if k > 2 else 1, 1)) if k > 2 else np.broadcast_to(p, (SYMBOLS, SYMBOLS))
        p = (weight[:, None] * low).ravel()
        p[seen] = v
        if k == order:
            out[i] = -np.log2(np.maximum(p, 1e-12))
    return out
