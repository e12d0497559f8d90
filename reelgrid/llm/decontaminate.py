"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

1. the items' n-grams, whole or with one word left out between any two of their words, are a table; documents are
   scanned for them and their counts in all documents joined to it. An n-gram has the same hash with a gap and without,
   so that it is found over a word that was changed, put in or taken out. A bitmap of fixed size tells the scan which
   n-grams can't be an item's: others never leave it;
2. an item's seeds are its n-grams that are rare: counted at most `floor` times, `rate` a position, or as often as half
   of the item's n-grams. So an item copied a million times keeps its seeds, and every item has some;
3. a second scan finds the seeds' places, which a join by n-gram hash brings together with the items. Hits of a document
   and item on neighbouring diagonals make a passage; only diagonals by steps of half an item leave a task;
4. documents with passages (joined by key; Spark broadcasts the passages where their table is small and shuffles beyond)
   are aligned with the items: match 1, mismatch and gap -0.5, best local score by the item's length.

With n = 3 no passage that scores more than 0.5 + 1 / words of the item is without a shared n-gram: where no two
neighbouring steps between matched words are in one, each step costs 0.5, save a last one. What can be lost is a passage
whose shared n-grams are all among the more frequent half of its item's and frequent beyond the limits of 2.

No table but the bitmap reaches the driver. Words are runs of letters, digits and non-ASCII characters, in lower case.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reelgrid.llm.words import PUNCTUATION, as_long, blocks, mix, small_batches
from reelgrid.plans.scratch import materialise

MISS, GAP = 0.5, 0.5
_BITS, _PART = 24, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shapes(k: int, n: int) -> list[list[int]]:
    """Where the k words of an n-gram may lie: in a row and, if it isn't a short item's, with one word between two."""
    return [list(range(k))] + [[j + (j >= gap) for j in range(k)] for gap in range(1, k) if k == n]


def shaped_hashes(x: np.ndarray, shape: list[int]) -> np.ndarray:
    """The hash of the neighbours of each place in x that the shape names, whatever lies between them."""
    out = np.zeros(max(0, len(x) - shape[-1]), np.uint64)
    for j in shape:
        out = (out + x[j : j + len(out)]) * _BASE
    return mix(out + np.uint64(len(shape)))


def _items(n: int):
    """mapInArrow: the words of each item, and how many its n-grams have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for b in blocks(batch.column("text"), apart=PUNCTUATION):
                x = b.hashes()
                words += [x[b.first[r] : b.first[r + 1]] for r in range(b.rows)]
            size = np.array([len(w) for w in words], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("no"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(size), pa.array(np.minimum(size, n))], names=["item", "no", "words", "size", "k"]
            )

    return run


def _grams(n: int):
    """mapInArrow: the n-grams of each item, with gaps and without, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("no", "words", "k")), strict=True)
            for no, words, k in rows:
                each = [shaped_hashes(np.frombuffer(words, np.uint64), s) for s in shapes(k, n)]
                h, place = np.concatenate(each), np.concatenate([np.arange(len(e)) for e in each])
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(np.full(len(h), no)), pa.array(place)], names=["h", "no", "place"])

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the marked parts of a bitmap of hashes by their low bits."""
    out = np.zeros(1 << _BITS, bool)
    for batch in batches:
        out[(batch.column("h").to_numpy().view(np.uint64) & np.uint64(len(out) - 1)).astype(np.int64)] = True
    parts = out.reshape(-1, 1 << _PART)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary())], names=["part", "bits"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: each part once."""
    held: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(1 << (_PART - 3), np.uint8))
    for batch in batches:
        for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            held[part] |= np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])


def hash_filter(hashes: DataFrame):
    """A broadcast table that tells by the low bits which hashes can't be among those of hashes (h): 2 MB at any size."""
    schema = "part long, bits binary"
    parts = hashes.mapInArrow(_bitmap, schema).repartition(4, "part").mapInArrow(_merged, schema).collect()  # 256 parts at most
    out = np.zeros((1 << (_BITS - _PART), 1 << (_PART - 3)), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(np.unpackbits(out.ravel()).astype(bool))


def _found(column: pa.Array, of: list[list[int]], mask: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, word, hash) of n-grams that the mask lets pass, by block of texts; every shape in turn."""
    for b in blocks(column, apart=PUNCTUATION):
        x, row = b.hashes(), b.row_of_word()
        for shape in of:
            h = shaped_hashes(x, shape)
            at = np.flatnonzero(mask[(h & np.uint64(len(mask) - 1)).astype(np.int64)])
            at = at[at + shape[-1] < b.first[row[at] + 1]]
            yield b.lo, row[at], at - b.first[row[at]], h[at]


def _count(shared, of: list[list[int]]):
    """mapInArrow: how often n-grams that may be an item's occur, and (h null) the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [np.zeros(0, np.uint64)], 0

        def drained() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([*as_long(h).tolist(), None], pa.int64()), pa.array(np.append(c, total))], names=["h", "c"])

        for batch in batches:
            for _, _, _, h in _found(batch.column("text"), of, shared.value):
                held.append(h)
            total += sum(len(b.starts) for b in blocks(batch.column("text"), apart=PUNCTUATION))
            if sum(map(len, held)) > 1 << 21:
                yield drained()
                held, total = [], 0
                held.append(np.zeros(0, np.uint64))
        yield drained()

    return run


def _places(shared, of: list[list[int]]):
    """mapInArrow: where n-grams that may be seeds occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, row, at, h in _found(batch.column("text"), of, shared.value):
                which = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), batch.column("id").take(which), batch.column("key").take(which), pa.array(at)], names=["h", "id", "key", "at"])

    return run


def smith_waterman(item: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of item with each of the texts, and where it ends in the text (exclusive)."""
    wide = max(len(t) for t in texts)
    grid, inside = np.zeros((len(texts), wide), np.uint64), np.zeros((len(texts), wide), bool)
    for i, t in enumerate(texts):
        grid[i, : len(t)], inside[i, : len(t)] = t, True
    ramp = GAP * np.arange(wide + 1)
    above = np.zeros((len(texts), wide + 1))
    best, end = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for w in item:
        match = np.where((grid == w) & inside, 1.0, -MISS)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(above[:, :-1] + match, above[:, 1:] - GAP), 0)
        here = np.maximum.accumulate(here + ramp, 1) - ramp
        at = here.argmax(1)
        score = here[np.arange(len(texts)), at]
        better = score > best + 1e-9
        best[better], end[better] = score[better], at[better]
        above = here
    return best, end


def windows(starts: list[int], size: int, words: int, threshold: float, wide: int) -> list[tuple[int, int]]:
    """Runs of the text (from, to) that hold every alignment of the threshold near the diagonals of starts, which are in
    steps of half an item; none is much longer than `wide` or four items: longer ones are cut, and overlap by what an
    alignment can span (its score leaves room for 2 (1 - threshold) gaps a word)."""
    step, span = max(1, size // 2), int(np.ceil(size * (1 + (1 - threshold) / GAP))) + 1
    out: list[list[int]] = []
    for d in sorted(starts):
        lo, hi = max(0, d * step - span), min(words, (d + 1) * step + span)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        elif lo < hi:
            out.append([lo, hi])
    most = max(wide, 4 * span)
    return [(at, min(hi, at + most)) for lo, hi in out for at in range(lo, max(lo + 1, hi - span), most - span)]


def can_score(item: np.ndarray, text: np.ndarray, threshold: float) -> bool:
    """Whether text shares so many words with item, within what an alignment can span, that it could score the threshold."""
    words, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    hit, need = words[at] == text, threshold * len(item) - 1e-9
    if np.minimum(np.bincount(at[hit], minlength=len(words)), times).sum() < need:
        return False
    span = int(np.ceil(len(item) * (1 + (1 - threshold) / GAP)))
    sums = np.concatenate(([0], np.cumsum(hit)))
    return len(text) <= span or (sums[span:] - sums[:-span]).max() >= need


def _batched(texts: list[tuple[int, np.ndarray]], cells: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """texts by rising length, in batches whose padded area is at most `cells`, or one text."""
    out: list[tuple[int, np.ndarray]] = []
    for t in sorted(texts, key=lambda t: len(t[1])):
        if out and (len(out) + 1) * len(t[1]) > cells:
            yield out
            out = []
        out.append(t)
    if out:
        yield out


def _align(threshold: float, kind: pa.DataType, cells: int = 1 << 20, wide: int = 1 << 12):
    """mapInArrow: the best alignment of each document with each item that it has passages of."""
    names = ["doc_id", "item_id", "score", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for b in blocks(batch.column("text"), apart=PUNCTUATION):
                x, by_item, of = b.hashes(), defaultdict(list), {}
                for r in range(b.rows):
                    own = x[b.first[r] : b.first[r + 1]]
                    for a in asked[b.lo + r].as_py():
                        of[a["no"]] = a
                        by_item[a["no"]] += [((r, lo), own[lo:hi]) for lo, hi in windows(a["starts"], a["size"], len(own), threshold, wide)]
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for no, texts in by_item.items():
                    item = np.frombuffer(of[no]["words"], np.uint64)
                    for part in _batched([t for t in texts if can_score(item, t[1], threshold)], cells):
                        score, end = smith_waterman(item, [t for _, t in part])
                        for k in np.flatnonzero(score >= threshold * len(item) - 1e-9):
                            (r, lo), text = part[k]
                            value = float(score[k]) / len(item)
                            if value > best.get((r, no), (0.0,))[0]:
                                back = smith_waterman(item[::-1], [text[: end[k]][::-1]])[1][0]
                                best[r, no] = value, lo + int(end[k] - back), lo + int(end[k])
                if best:
                    keys = sorted(best)
                    cols = [pa.array([best[k][j] for k in keys], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                    ids = batch.column("id").take(pa.array([r + b.lo for r, _ in keys]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([of[no]["item"] for _, no in keys], kind), *cols], names=names)

    return run


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.lower(F.col(text_col)).alias("text"))


def _same_row() -> Column:
    return (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = 3, rate: float = 1e-7, floor: int = 1000, threshold: float = 0.5,
) -> DataFrame:
    """doc_id, item_id, score, start, end: documents that hold an exact, edited or paraphrased copy of a test item.

    A row for each pair of document row and item with a passage of score `threshold` or more that shares a rare n-gram,
    with a gap or without (see above for what that leaves out); score 1 is an exact copy; start and end are the
    passage's words in the document. Items of fewer than `n` words are found by all their words in a row. Null and wordless texts and items match nothing. Repeated
    rows of documents each give their rows; repeated items, their own. Ids may be of any type. Other columns are left
    aside. Empty tables give an empty result.
    """
    docs = _keyed(small_batches(documents), id_col, text_col)
    kind, item_kind = documents.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = materialise(benchmark.select(F.col(item_col).alias("item"), F.lower(F.col(item_text_col)).alias("text"), F.monotonically_increasing_id().alias("no")).where("text is not null"), "items")
    items = materialise(items.mapInArrow(_items(n), f"item {item_kind}, no long, words binary, size long, k long").where("size > 0"), "words")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # n at most
    of = [s for k in sizes for s in shapes(k, n)]
    grams = materialise(items.mapInArrow(_grams(n), "h long, no long, place long"), "grams")

    counts = docs.mapInArrow(_count(hash_filter(grams), of), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "counts")
    total = counts.where("h is null").agg(F.sum("c")).first()[0] or 0
    counted = grams.join(counts.where("h is not null"), "h")
    half = counted.groupBy("no").agg(F.percentile("c", 0.5).alias("half"))
    rare = F.col("c") <= F.greatest(F.lit(max(float(floor), rate * total)), F.ceil("half"))
    seeds = materialise(counted.join(half, "no").where(rare).select("h", "no", "place"), "seeds")

    places = docs.mapInArrow(_places(hash_filter(seeds), of), f"h long, id {kind}, key long, at long")
    hits = places.join(seeds, "h").join(items.select("no", "size"), "no")
    start = F.floor((F.col("at") - F.col("place")) / F.greatest(F.lit(1), F.floor(F.col("size") / 2))).cast("long")
    asked = hits.groupBy("id", "key", "no").agg(F.collect_set(start).alias("starts"))
    asked = asked.join(items.drop("k"), "no").groupBy(F.col("key").alias("k"), F.col("id").alias("i")).agg(F.collect_list(F.struct("no", "item", "words", "size", "starts")).alias("asked"))
    found = docs.join(materialise(asked, "passages"), _same_row())
    align = _align(threshold, to_arrow_type(benchmark.schema[item_col].dataType))
    return found.select("id", "text", "asked").mapInArrow(align, f"doc_id {kind}, item_id {item_kind}, score double, start long, end long")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents without those that hold a test item; columns as they are, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    named = documents.select(row).select("row", F.to_json(F.struct(F.col(f"row.`{id_col}`").alias("i"), F.xxhash64(F.col(f"row.`{text_col}`")).alias("h")), {"ignoreNullFields": "false"}).alias("name"))
    leaks = find_leaks(named.select("name", F.col(f"row.`{text_col}`").alias("text")), benchmark, "name", "text", **options)
    # dealt out by hash at every size: leaks grow with the documents
    leaks = leaks.select("doc_id").distinct().hint("merge")
    return named.join(leaks, F.col("name") == F.col("doc_id"), "left_anti").select("row.*")
