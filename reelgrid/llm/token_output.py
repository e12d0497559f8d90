"""Token ids in a binary format: fixed-size blocks in bit or byte planes, each plane compressed, with a chunk index.

A table of segments (Parquet, so any store that Spark reads; commits are atomic and lost tasks are written anew). A
segment is a run of whole documents of one part of the id order: about `segment` ids, more if one document has more.

  part, seq       place in the order: part of the range partitioning, segment within it
  first, n_ids    ids of the part before this segment, ids in it
  doc_ids, counts its documents in order and the ids of each
  data            header, chunk index, planes

data, little-endian: "RGT1", u8 kind (1 bit planes, 2 byte planes), u8 zero, u16 planes, u32 ids a block, u32 blocks,
u64 ids; then for each block and plane a u32, the compressed length (0: all zero); then the planes, lowest first, each
a zstandard frame. Bit plane p holds bit p of the block's ids, eight ids a byte, first id in the highest bit; byte
plane p holds byte p of each id. A block can be read alone: its place is the sum of the lengths before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reelgrid.llm.pieces import ByteLevelPieces, default_path, loaded
from reelgrid.llm.words import small_batches, string_buffers
from reelgrid.plans.scratch import new_folder

_HEAD = struct.Struct("<4sBBHIIQ")


def encode_planes(ids: np.ndarray, block: int = 1 << 16, bits: bool = True, level: int = 1) -> bytes:
    """The ids (unsigned 32-bit) in the format above."""
    import zstandard

    if block <= 0 or block % 8:
        raise ValueError("block must be a positive multiple of 8")
    pack = zstandard.ZstdCompressor(level=level).compress
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, top.bit_length()) if bits else max(1, -(-top.bit_length() // 8))
    size, body = [], []
    for lo in range(0, len(ids), block):
        x = ids[lo : lo + block]
        if bits:
            wide = np.unpackbits(x.view(np.uint8).reshape(-1, 4)[:, : -(-planes // 8)], axis=1, bitorder="little")
            rows = np.packbits(np.ascontiguousarray(wide[:, :planes].T), axis=1)
        else:
            rows = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4)[:, :planes].T)
        for row in rows:
            body.append(pack(row.tobytes()) if row.any() else b"")
            size.append(len(body[-1]))
    head = _HEAD.pack(b"RGT1", 1 if bits else 2, 0, planes, block, -(-len(ids) // block), len(ids))
    return b"".join((head, np.array(size, "<u4").tobytes(), *body))


def decode_planes(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of data, or those of one block."""
    import zstandard

    magic, kind, _, planes, block, blocks, n = _HEAD.unpack_from(data)
    if magic != b"RGT1" or kind not in (1, 2):
        raise ValueError("not a segment of token planes")
    size = np.frombuffer(data, "<u4", blocks * planes, _HEAD.size).reshape(blocks, planes).astype(np.int64)
    at = _HEAD.size + 4 * blocks * planes + np.concatenate(([0], np.cumsum(size.ravel())))[:-1].reshape(blocks, planes)
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for b in range(blocks) if only is None else [only]:
        count = min(block, n - b * block)
        width = -(-count // 8) if kind == 1 else count
        rows = np.zeros((planes, width), np.uint8)
        for p in range(planes):
            if size[b, p]:
                rows[p] = np.frombuffer(unpack(data[at[b, p] : at[b, p] + size[b, p]]), np.uint8)
        if kind == 1:
            low = np.packbits(np.unpackbits(rows, axis=1, count=count).T, axis=1, bitorder="little")
        else:
            low = rows.T
        full = np.zeros((count, 4), np.uint8)
        full[:, : low.shape[1]] = low
        out.append(full.view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 3 << 19) -> Iterator[tuple[pa.Array, pa.Array]]:
    """ids and texts of about `most` bytes at a time, or one text if that is longer."""
    ids, texts, size = [], [], 0
    for batch in batches:
        _, edge = string_buffers(batch.column("text"))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + most - size, "right")) - 1)
            if texts and size + edge[hi] - edge[lo] > most:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
                continue
            ids.append(batch.column("id").slice(lo, hi - lo))
            texts.append(batch.column("text").slice(lo, hi - lo))
            size += int(edge[hi] - edge[lo])
            lo = hi
    if texts:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _write(path: str, end: int, segment: int, block: int, bits: bool, id_type: pa.DataType):
    names = ["part", "seq", "first", "n_ids", "doc_ids", "counts", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(ByteLevelPieces, path), TaskContext.get().partitionId()
        seq = first = held = 0
        docs, counts, flat = [], [], []

        def segment_row() -> pa.RecordBatch:
            ids = np.concatenate(flat)
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64())]
            lists = [pa.array([docs], pa.list_(id_type)), pa.array([np.concatenate(counts)], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, *lists, pa.array([encode_planes(ids, block, bits)], pa.binary())], names=names)

        for ids, texts in _gathered(batches):
            x, n = encoder.ids(texts, end)
            pa.default_memory_pool().release_unused()
            edge = np.concatenate(([0], np.cumsum(n)))
            lo = 0
            while lo < len(n):
                # whole documents until the segment is full
                hi = min(len(n), max(lo + 1, int(np.searchsorted(edge, edge[lo] + segment - held, "left"))))
                docs += ids.slice(lo, hi - lo).to_pylist()
                flat.append(x[edge[lo] : edge[hi]])
                counts.append(n[lo:hi])
                held += int(edge[hi] - edge[lo])
                lo = hi
                if held >= segment:
                    yield segment_row()
                    seq, first, held, docs, counts, flat = seq + 1, first + held, 0, [], [], []
        if docs:
            yield segment_row()

    return run


def write_tokens(
    documents: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 2, segment: int = 1 << 18, block: int = 1 << 16, bits: bool = True
) -> None:
    """Encode every whole text, append `end` to each and write segments to the folder out, in ascending order of the id.

    Equal ids are ordered by a hash of the text; null ids come first. null text is empty: just the end id. Rows equal
    in both are documents of their own. An empty table writes no segments.
    """
    docs = small_batches(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    docs = docs.repartitionByRange(parts, F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)
    id_type = to_arrow_type(docs.schema["id"].dataType)
    schema = f"part int, seq int, first long, n_ids long, doc_ids array<{kind}>, counts array<long>, data binary"
    docs.mapInArrow(_write(path or default_path("byte_bpe_50k.json"), end, segment, block, bits, id_type), schema).write.mode("overwrite").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids = decode_planes(batch.column("data")[i].as_py())
            counts = batch.column("counts")[i].values.to_numpy()
            edge = np.concatenate(([0], np.cumsum(counts)))
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            start = batch.column("start")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids")[i].values, pa.array(start + edge[:-1]), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The index of a written folder, computed from its files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Only the sums of the parts, a row for each part of the range partitioning, meet in one task.
    """
    table = spark.read.parquet(out)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    placed = table.join(parts, "part").select("doc_ids", "counts", "data", (F.col("from") + F.col("first")).alias("start"))
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encoded(documents: DataFrame, **options) -> DataFrame:
    """write_tokens() to a new folder in the shared one, which goes when the session ends, and read_tokens() of it."""
    spark = documents.sparkSession
    out = new_folder(spark, "tokens")
    write_tokens(documents, out, **options)
    return read_tokens(spark, out)
