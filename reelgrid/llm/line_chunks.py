"""Line dedup by content-defined chunks of lines.

1. a rolling hash over the hashes of two neighbouring lines puts a boundary between them unless it is 0 modulo
   `divisor`. A boundary depends on these two lines alone, so it moves with the text whatever stands before. A
   document's start and end are boundaries too;
2. from each boundary a chunk runs to the first boundary at least `least` lines on. Chunks overlap, so none depends on
   where an earlier one ended; the last one that fits is also taken up to the end, so that every line of a text of
   that many lines lies in a chunk that is compared;
3. chunks with anything but blank lines in them are counted by hash, combined on the map side;
4. the bytes of those that occur more than once are fetched and compared: they are grouped by the bytes themselves;
5. the first of each group stays, in order of id, then place; lines of the others are removed, unless they also lie in a
   chunk that stays.

The text is shuffled once, for 4 and 5 together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.words import LINE_FEED, as_long, mix, run_hashes, small_batches, span_hashes, string_buffers
from reelgrid.llm.words import blocks as word_blocks
from reelgrid.plans.scratch import materialise, release

_BLANK = np.uint64(0)


def line_hashes(text: bytes) -> np.ndarray:
    """A hash of each line of a text, lines as split by line feeds; 0 for blank ones."""
    lines = text.split(b"\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out = np.zeros(len(lines), np.uint64)
    if filled:
        column = pa.array([lines[i] for i in filled], pa.binary())
        for b in word_blocks(column, apart=LINE_FEED):
            out[np.array(filled)[b.lo : b.hi]] = b.hashes()
    return out


def boundaries(x: np.ndarray, divisor: int) -> np.ndarray:
    """Lines, of those with the hashes x, before which a chunk may begin or end; the first, and the number of lines too."""
    between = 1 + np.flatnonzero(mix(run_hashes(x, 2)) % np.uint64(divisor) != 0)
    return np.concatenate(([0], between, [len(x)]))


def chunk_spans(x: np.ndarray, divisor: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """First lines and sizes of the chunks, of `least` lines or more, of lines with the hashes x."""
    edge = boundaries(x, divisor)
    first = edge[edge <= len(x) - least]
    end = edge[np.searchsorted(edge, first + least)]
    if len(first) and end[-1] < len(x):
        first, end = np.append(first, first[-1]), np.append(end, len(x))
    return first, end - first


def _chunks(divisor: int, least: int):
    """mapInArrow: the multi-line chunks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("key")
            data, edge = string_buffers(batch.column("__text"))
            hashes, rows, at, size = [], [], [], []
            for i in range(len(batch)):
                text = data[edge[i] : edge[i + 1]].tobytes()
                if text.count(b"\n") + 1 < least:
                    continue
                x = line_hashes(text)
                first, n = chunk_spans(x, divisor, least)
                filled = np.concatenate(([0], np.cumsum(x != _BLANK)))
                good = np.flatnonzero(filled[first + n] > filled[first])
                if len(good):
                    hashes.append(span_hashes(x, first[good], n[good]))
                    rows.append(np.full(len(good), i))
                    at.append(first[good])
                    size.append(n[good])
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(hashes))), ids.take(row), keys.take(row), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32))],
                    names=["h", "id", "key", "at", "size"],
                )

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the bytes of the chunks asked for."""
    for batch in batches:
        texts, wanted = batch.column("__text"), batch.column("wanted")
        rows, h, at, size, body, held = [], [], [], [], [], 0
        for i in range(len(batch)):
            lines = texts[i].as_py().encode().split(b"\n")
            for w in wanted[i].as_py():
                rows.append(i)
                h.append(w["h"])
                at.append(w["at"])
                size.append(w["size"])
                body.append(b"\n".join(lines[w["at"] : w["at"] + w["size"]]))
                held += len(body[-1])
            if held > 4 << 20 or i == len(batch) - 1:
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), batch.column("id").take(row), batch.column("key").take(row), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(body, pa.binary())],
                    names=["h", "id", "key", "at", "size", "body"],
                )
                rows, h, at, size, body, held = [], [], [], [], [], 0


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, stay = batch.column("__text"), batch.column("gone"), batch.column("stay")
            n, removed, digest, kept = [], [], [], []
            for i in range(len(batch)):
                text = (texts[i].as_py() or "").encode()
                cuts = gone[i].as_py()
                n.append(text.count(b"\n") + 1 if text else 0)
                if cuts:
                    lines = text.split(b"\n")
                    keep = np.ones(len(lines), bool)
                    for chunks, value in ((cuts, False), (stay[i].as_py() or [], True)):
                        for c in chunks:
                            keep[c["at"] : c["at"] + c["size"]] = value
                    left = [x for x, k in zip(lines, keep, strict=True) if k]
                    removed.append(len(lines) - len(left))
                    text = b"\n".join(left)
                else:
                    removed.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeated_chunks(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, least: int = 2, with_text: bool = True
) -> DataFrame:
    """Remove chunks of `least` lines or more that occur before, in another document or the same.

    Returns doc_id, n_lines, n_removed (lines), kept_sha256 and, with_text, kept_text: the lines left, joined by line
    feeds. Lines are what line feeds part, compared byte by byte; null and empty texts have none. The first occurrence
    in order of id (null first), then a hash of the text, then place, stays whole. Of rows equal in id and text one is the
    first, the others lose what it keeps. Other columns are left aside. An empty table gives an empty result.
    """
    # a name that the table doesn't have: Spark drops aliases to the same name in some branches of a plan only, and then
    # takes their exchanges of the text for different ones
    docs = small_batches(documents).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("__text"))
    kind = docs.schema["id"].dataType.simpleString()
    chunks = materialise(docs.mapInArrow(_chunks(divisor, least), f"h long, id {kind}, key long, at int, size int"), "chunks")
    again = chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    live = materialise(chunks.join(again, "h"), "again")
    release(chunks)

    # equal rows share a line here; c is how many they are
    live = live.groupBy("h", "id", "key", "at", "size").agg(F.count("*").alias("c"))

    def of_docs(lists: DataFrame, how: str) -> DataFrame:
        lists = lists.withColumnsRenamed({"key": "k", "id": "i"})
        # dealt out by hash at every size: the lists grow with the documents
        return docs.join(lists.hint("merge"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), how).drop("k", "i")

    wanted = live.groupBy("key", "id").agg(F.collect_list(F.struct("h", "at", "size")).alias("wanted"))
    body = of_docs(wanted, "inner").mapInArrow(_bytes, f"h long, id {kind}, key long, at int, size int, body binary")
    stays = body.groupBy("h", "body").agg(F.min(F.struct("id", "key", "at", "size")).alias("one")).select(
        F.col("one.id").alias("i"), F.col("one.key").alias("k"), F.col("one.at").alias("a"), F.col("one.size").alias("s"), F.lit(True).alias("stays")
    )
    marked = live.join(stays, (F.col("key") == F.col("k")) & (F.col("at") == F.col("a")) & (F.col("size") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")), "left")
    place = F.struct("at", "size")
    cuts = marked.groupBy("key", "id").agg(
        F.collect_list(F.when(F.col("stays").isNull(), place)).alias("gone"), F.collect_list(F.when(F.col("stays"), place)).alias("stay"),
        F.collect_list(place).alias("all"), F.max(F.col("stays") & (F.col("c") > 1)).alias("several")
    )
    cuts = cuts.select("key", "id", "gone", "stay", F.when(F.coalesce("several", F.lit(False)), F.col("all")).alias("rest"))
    found = of_docs(cuts, "left")
    alone = found.where("rest is null").select("id", "__text", "gone", "stay")
    # of equal rows one keeps what stays; they are alike, so their number says which
    alike = found.where("rest is not null").groupBy("key", "id").agg(F.first("__text").alias("__text"), F.first("gone").alias("gone"), F.first("stay").alias("stay"), F.first("rest").alias("rest"), F.count("*").alias("n"))
    each = F.concat(F.array(F.struct("gone", "stay")), F.array_repeat(F.struct(F.col("rest").alias("gone"), F.lit(None).cast(alone.schema["stay"].dataType).alias("stay")), (F.col("n") - 1).cast("int")))
    rows = alone.unionByName(alike.select("id", "__text", F.explode(each).alias("each")).select("id", "__text", "each.*"))
    out = f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(_remove(with_text), out)
