"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide.

Plan: one pass over the text gives each document its set size, a 128-bit sum of its set and its band hashes. Documents
of one set form a class, which counts once from there on. Band hashes meet in an aggregation (the least class of each
bucket, combined on the map side), so a bucket costs one edge a member, never its pairs; the edges' components bound
where links can be. A component of at most `block` classes is a task; a larger one, such as a long chain of near copies,
falls apart into its buckets again, and a pair counts in the least bucket that both share. Buckets beyond `block` classes
are dealt out in blocks, each pair of blocks a task. Sets are compared there by matrix products over the shingles that
two of them share, and only counts and a spanning forest leave it: no task has all rows of a group.

Bands and rows come from the target recall: with b bands of r rows a pair of similarity s meets in some bucket with
probability 1 - (1 - s**r)**b, and a link is also found when its ends meet through others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from reelgrid.llm.words import Block, as_long, blocks, mix, run_hashes, small_batches, span_hashes
from reelgrid.operators.components import connected_components
from reelgrid.plans.scratch import materialise


def band_plan(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest chance meetings, that reach the recall at the threshold."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must lie in (0, 1] and recall in (0, 1)")
    if threshold == 1:
        return 1, 4
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            return max(1, bands), rows
    raise ValueError("no plan of that many hashes reaches the recall")


def shingles(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a block's texts, and where each text's begin; a shorter text is one gram as a whole."""
    x, count = b.hashes(), b.counts
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(grams)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], grams) + np.repeat(b.first[:-1], grams)
    if (count >= n).all():
        return run_hashes(x, n)[at], first
    return span_hashes(x, at, np.repeat(np.minimum(count, n), grams)), first


def _signatures(n: int, bands: int, rows: int):
    odd = np.random.default_rng(71).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                grams, first = shingles(b, n)
                size, one, two = np.zeros(b.rows, np.int64), np.zeros(b.rows, np.uint64), np.zeros(b.rows, np.uint64)
                for r in range(b.rows):
                    own = np.unique(grams[first[r] : first[r + 1]])
                    size[r], one[r], two[r] = len(own), own.sum(), mix(own).sum()
                full = np.flatnonzero(size)
                low = np.zeros((len(full), bands * rows), np.uint64)
                if len(full):
                    for j, a in enumerate(odd):
                        low[:, j] = np.minimum.reduceat(grams * a, first[full])
                keys = []
                for k in range(bands):
                    h = np.full(len(full), k + 1, np.uint64)
                    for j in range(k * rows, (k + 1) * rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
                    keys.append(h)
                flat = as_long(np.stack(keys, 1).ravel()) if len(full) else np.zeros(0, np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                part = batch.slice(b.lo, b.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array(size), pa.array(as_long(one)), pa.array(as_long(two)), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["id", "key", "n", "one", "two", "bands"],
                )

    return run


def _sets(n: int):
    """mapInArrow: the sorted set of each class's document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                grams, first = shingles(b, n)
                sets = [np.unique(grams[first[r] : first[r + 1]]).tobytes() for r in range(b.rows)]
                part = batch.slice(b.lo, b.rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in ("cid", "m", "where")), pa.array(sets, pa.binary())], names=["cid", "m", "where", "grams"]
                )

    return run


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of 0/1 matrices of 4096 columns."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(number[-1]) + 1, 4096):
        i, j = np.searchsorted(column, (at, at + 4096))
        wide = min(4096, int(number[-1]) + 1 - at)
        m = []
        for side, rows in ((0, left), (1, right)):
            x = np.zeros((len(rows), wide), np.float32)
            row = place[side, owner[i:j]]
            x[row[row >= 0], column[i:j][row >= 0] - at] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _verify(threshold: float):
    """mapInArrow over rows sorted by (comp, i, j): the links between two blocks, as counts and a spanning forest."""
    names = ("comp", "i", "j", "cid", "m", "blk", "grams", "bands")

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in names), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (comp, i, j), group in groupby(rows(batches), key=lambda r: r[:3]):
            unique = sorted({r[3]: r for r in group}.values(), key=lambda r: r[3])
            cid, m, blk = [r[3] for r in unique], np.array([r[4] for r in unique]), np.array([r[5] for r in unique])
            sets = [np.frombuffer(r[6], np.uint64) for r in unique]
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            inter = common(sets, left, right).astype(np.float64)
            link = inter / (size[left][:, None] + size[right][None, :] - inter) >= threshold
            if i == j:
                np.fill_diagonal(link, False)
            if unique[0][7] is not None:  # a bucket of a large component
                a, b = np.nonzero(link)
                bands = np.array([r[7] for r in unique])
                one, two = bands[left[a]], bands[right[b]]
                link[a, b] = np.where(one == two, one, np.iinfo(np.int64).max).min(1) == comp
            forest, links = _Forest(len(cid)), np.zeros(len(cid), np.int64)
            links[left] += link @ m[right]
            if i != j:
                links[right] += link.T @ m[left]
            for a, b in zip(*np.nonzero(link), strict=True):
                forest.join(left[a], right[b])
            out += [(cid[x], int(links[x]), cid[forest.find(x)]) for x in range(len(cid)) if links[x]]
            if len(out) > 20_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["cid", "links", "lead"])


def jaccard_join(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 256
) -> DataFrame:
    """Links between documents whose sets of word n-grams have a Jaccard similarity of `threshold` or more.

    Returns a row per document: doc_id, key (a hash of id and text), class_id (the smallest doc_id with the same set),
    n_links (other documents linked directly, copies included), group_id (the smallest doc_id reachable by links) and
    kept (true in one class of each group; rows equal in id and text agree). Words are runs of characters other than
    0x20 and 0x09-0x0D, unchanged. A text of 1 to n - 1 words is one gram as a whole; null, empty and blank texts link
    with nothing and stay. Repeated rows are documents of their own and link with each other. Null ids are passed over
    by the smallest id. Other columns are left aside. An empty table gives an empty result.
    """
    bands, rows = band_plan(threshold, recall)
    docs = small_batches(documents).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sig = materialise(docs.mapInArrow(_signatures(n, bands, rows), f"id {kind}, key long, n long, one long, two long, bands array<long>"), "signatures")
    cls = sig.where("n > 0").groupBy("n", "one", "two").agg(
        F.count("*").alias("m"), F.min("id").alias("class_id"), F.min(F.struct("id", "key", "bands")).alias("doc")
    )
    cls = materialise(cls.select("n", "one", "two", "m", "class_id", F.col("doc.key").alias("cid"), F.col("doc.id").alias("rep"), "doc.bands"), "classes")

    met = cls.select("cid", F.explode("bands").alias("h"))
    least = met.groupBy("h").agg(F.min("cid").alias("lead"), F.count("*").alias("c")).where("c > 1").select("h", "lead")
    comp = materialise(connected_components(met.join(least, "h").where("cid != lead").select(F.col("cid").alias("a"), F.col("lead").alias("b"))), "candidates")
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    placed = comp.join(sizes, "component").withColumnRenamed("vertex", "cid")
    small = placed.where(F.col("size") <= block).select("cid", F.array(F.struct(F.col("component").alias("comp"), F.lit(1).alias("blocks"))).alias("where"), F.lit(None).cast("array<long>").alias("bands"))
    large = met.join(placed.where(F.col("size") > block).select("cid"), "cid", "left_semi")
    full = large.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("c")).where("c > 1").select("h", "blocks")
    large = large.join(full, "h").groupBy("cid").agg(F.collect_list(F.struct(F.col("h").alias("comp"), "blocks")).alias("where"))
    large = large.join(cls.select("cid", "bands"), "cid").select("cid", "where", "bands")
    asked = materialise(cls.select("cid", "rep", "m").join(small.unionByName(large), "cid"), "asked")
    # texts are dealt out by their hash at every size; a broadcast of the classes would only do while they are few
    texts = docs.join(asked.hint("merge"), (F.col("key") == F.col("cid")) & F.col("id").eqNullSafe(F.col("rep")))
    texts = texts.select("cid", "m", F.struct("where", "bands").alias("where"), "text")
    sets = texts.mapInArrow(_sets(n), StructType([StructField("cid", LongType()), StructField("m", LongType()), texts.schema["where"], StructField("grams", BinaryType())]))
    sets = sets.select("cid", "m", "grams", "where.bands", F.inline("where.where"))
    sets = sets.withColumn("blk", F.pmod(F.xxhash64(F.col("cid") + 1), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    sets = sets.select("comp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "cid", "m", "blk", "grams", "bands")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = materialise(sets.mapInArrow(_verify(threshold), "cid long, links long, lead long"), "links")

    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("lead").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    out = cls.drop("bands").join(links, "cid", "left").join(groups.select(F.col("vertex").alias("cid"), "component"), "cid", "left")
    out = out.withColumn("component", F.coalesce("component", "cid"))
    heads = out.groupBy("component").agg(F.min("class_id").alias("group_id"), F.min(F.struct("class_id", "rep", "cid")).alias("head"))
    out = out.join(heads, "component").select(
        "n", "one", "two", "class_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "group_id", (F.col("head.cid") == F.col("cid")).alias("first"), "cid", "rep"
    )
    full = sig.where("n > 0").drop("bands").join(out, ["n", "one", "two"]).select(
        F.col("id").alias("doc_id"), "key", "class_id", "n_links", "group_id", (F.col("first") & (F.col("key") == F.col("cid")) & F.col("id").eqNullSafe(F.col("rep"))).alias("kept")
    )
    bare = sig.where("n = 0").select(
        F.col("id").alias("doc_id"), "key", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"), F.lit(True).alias("kept")
    )
    return full.unionByName(bare)


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents without all but one row of each group of near duplicates; columns as they are.

    The row that stays has the smallest id of its group. Rows equal in id and text are one row afterwards, but for
    texts without a word, which all stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    own, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    kept = jaccard_join(documents, id_col, text_col, **options).where("kept").groupBy(F.col("doc_id").alias("i"), F.col("key").alias("k")).agg(F.count("*").alias("n"))
    keyed = documents.select(row).withColumn("key", F.xxhash64(own, text))
    both = keyed.join(kept, (F.col("key") == F.col("k")) & own.eqNullSafe(F.col("i")))
    blank = F.coalesce(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit("")) == ""
    once = both.where((F.col("n") == 1) | blank).select("row")
    same = both.where((F.col("n") > 1) & ~blank)
    return once.unionByName(same.groupBy("key", "i").agg(F.first("row").alias("row")).select("row")).select("row.*")
