"""Whole Arrow columns of text as numpy arrays: words, word hashes, hashes of runs of words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, the same as bytes.split() without arguments.
Texts are taken in blocks of bounded bytes; a text longer than that is a block of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
_STEP = 1 << 17  # bytes hashed at once, whatever the block
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LINE_FEED = np.zeros(256, bool)
LINE_FEED[10] = True
#: what is no ASCII letter or digit; bytes of other characters count as letters
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_ODD = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, after its session was told to send no more rows at once to Python: they are whole texts here."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def powers(n: int, base: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if size <= 1 << 22:
            _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Some texts: rows lo..hi of the column; data: their bytes; edge: where each text begins, and the end."""

    lo: int
    hi: int
    data: np.ndarray
    edge: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of all words

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def text(self, row: int) -> bytes:
        return self.data[self.edge[row] : self.edge[row + 1]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + _STEP, "right")))
            size = int(self.ends[j - 1] - at)
            up, down = powers(size + 1)
            total = np.empty(size + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[self.data[at : at + size]] * up[:size], out=total[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), edge


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, apart: np.ndarray = SPACE) -> Iterator[Block]:
    """The column's texts in blocks of limit bytes, with their words: runs of bytes that aren't marked in apart."""
    if not len(column):
        return
    data, edge = string_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + limit, "right")) - 1)
        part, at = data[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo]
        inside = np.zeros(len(part) + 1, bool)
        np.logical_not(apart[part], out=inside[:-1])
        starts_at = inside.copy()
        cut = at[:-1][at[:-1] < len(part)]
        starts_at[1:] &= ~inside[:-1]
        starts_at[cut] = inside[cut]
        ends_at = np.zeros(len(part) + 1, bool)
        ends_at[1:] = inside[:-1] & ~inside[1:]
        last = at[1:][at[1:] > 0]
        ends_at[last] = inside[last - 1]
        starts = np.flatnonzero(starts_at)
        yield Block(lo, hi, part, at, starts, np.flatnonzero(ends_at), np.searchsorted(starts, at))
        lo = hi


def run_hashes(x: np.ndarray, k: int, base: int = _ODD) -> np.ndarray:
    """The hash of each k neighbours in x, at the position of the first."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    return span_hashes(x, np.arange(len(x) - k + 1), np.full(len(x) - k + 1, k), base)


def span_hashes(x: np.ndarray, at: np.ndarray, size: np.ndarray, base: int = _ODD) -> np.ndarray:
    """The hash of x[at : at + size]; equal sequences have equal hashes wherever they lie."""
    up, down = powers(len(x) + 1, base)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    return mix((total[at + size] - total[at]) * down[at] + size.astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    if len(x) < w:
        return x[:0]
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1])


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
