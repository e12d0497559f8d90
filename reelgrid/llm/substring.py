"""Substring dedup: words covered by a window of words that occurs more than once are removed.

Matching statistics come from suffix automata over shards of reference text. The reference is the corpus itself, so its
shards can't be broadcast: they would grow with the data. They are dealt instead. The windows of a document are cut
into contexts, runs of neighbouring windows with the same least k-gram hash (the seed); equal windows have equal seeds,
so all that can match lies in one shard:

1. seeds: every document gives (seed, context hash, place). Seeds that occur once can't repeat anything and go.
2. reference: equal contexts count once, with their number. A seed with one such context needs no automaton: all of it
   repeats. The rest fetch their words, one copy of each context.
3. automaton: each seed's contexts form a generalised suffix automaton whose states count occurrences; each context is
   streamed through it and its maximal spans of at least `window` words that occur twice are kept.
4. hot seeds, with very many different contexts, are dealt out in blocks of contexts with an automaton each. What does
   not repeat in its block is counted by whole windows across blocks: no group is gathered in one task.

Cost: one pass over the text for 1, one shuffle of the text shared by 2 and the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.words import as_long, blocks, run_hashes, sliding_min, small_batches, span_hashes
from reelgrid.plans.scratch import materialise, release

_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class SuffixAutomaton:
    """Generalised suffix automaton over token lists; count[s]: occurrences of the strings of state s, by weight."""

    def __init__(self) -> None:
        self.link, self.size, self.next, self.count = [-1], [0], [{}], [0]

    def _state(self, size: int, link: int, moves: dict) -> int:
        self.link.append(link)
        self.size.append(size)
        self.next.append(moves)
        self.count.append(0)
        return len(self.link) - 1

    def _branch(self, p: int, token, q: int) -> int:
        """The state of p's strings with token after them, split from q if q also has longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: Iterable, weight: int = 1) -> None:
        last = 0
        for token in tokens:
            if (q := self.next[last].get(token)) is not None:
                last = self._branch(last, token, q)
            else:
                p, new = last, self._state(self.size[last] + 1, 0, {})
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._branch(p, token, self.next[p][token])
                last = new
            self.count[last] += weight

    def close(self) -> SuffixAutomaton:
        """Add each state's occurrences to those of its suffixes; call once, after all add()."""
        for s in sorted(range(1, len(self.link)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def spans(self, tokens: Iterable, least: int, times: int) -> list[tuple[int, int]]:
        """Merged maximal spans [from, to) of at least `least` tokens that occur `times` times or more."""
        out: list[tuple[int, int]] = []
        v = length = 0
        for i, token in enumerate(tokens):
            while True:
                to = self.next[v].get(token)
                if to is not None and self.count[to] >= times:
                    v, length = to, length + 1
                    break
                if not v:
                    length = 0
                    break
                v = self.link[v]
                length = self.size[v]
            if length >= least:
                a = i + 1 - length
                if out and a <= out[-1][1]:
                    a = min(a, out.pop()[0])
                    while out and out[-1][1] >= a:
                        a = min(a, out.pop()[0])
                out.append((a, i + 1))
        return out


def _contexts(window: int, gram: int, most: int = 2048):
    """mapInArrow: seeds and contexts of each text. A context of more than `most` windows (periodic text) is cut in runs
    of so many: each window lies in one run as a whole, so a task never holds a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("key").to_numpy()
            for b in blocks(batch.column("__text")):
                x = b.hashes()
                if len(x) < window:
                    continue
                grams = run_hashes(x, gram)
                low = sliding_min(grams, window - gram + 1)
                row = b.row_of_word()[: len(low)]
                whole = np.arange(len(low)) + window <= b.first[row + 1]
                fresh = whole.copy()
                fresh[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
                at = np.flatnonzero(fresh)
                if not len(at):
                    continue
                stop = whole.copy()
                stop[:-1] &= ~whole[1:] | (low[1:] != low[:-1])
                end = np.flatnonzero(stop)
                runs = (end - at) // most + 1
                if runs.max() > 1:
                    last = np.repeat(end, runs)
                    at = np.repeat(at, runs) + most * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
                    end = np.minimum(at + most - 1, last)
                # a seed occurs again inside its own context each time that the window moves past it
                past = np.concatenate(([0], np.cumsum(grams[: len(low)] == low)))
                size = end - at + window
                r = row[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(as_long(low[at])),
                        pa.array(as_long(span_hashes(x, at, size))),
                        ids.take(pa.array(r + b.lo)),
                        pa.array(keys[r + b.lo]),
                        pa.array((at - b.first[r]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array((1 + past[end] - past[at]).astype(np.int32)),
                    ],
                    names=["seed", "ctx", "id", "key", "at", "size", "own"],
                )

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the words of each context that is asked for."""
    for batch in batches:
        texts, wanted = batch.column("__text"), batch.column("wanted")
        out: dict[str, list] = {k: [] for k in ("seed", "blk", "ctx", "size", "n", "words")}
        held = 0
        for i in range(len(batch)):
            words = texts[i].as_py().encode().split()
            for w in wanted[i].as_py():
                out["seed"].append(w["seed"])
                out["blk"].append(w["blk"])
                out["ctx"].append(w["ctx"])
                out["size"].append(w["size"])
                out["n"].append(w["n"])
                out["words"].append(b" ".join(words[w["at"] : w["at"] + w["size"]]))
                held += len(out["words"][-1])
            if held > 4 << 20:
                yield _batch(out)
                out, held = {k: [] for k in out}, 0
        yield _batch(out)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"seed": pa.int64(), "blk": pa.int32(), "ctx": pa.int64(), "size": pa.int32(), "n": pa.int64(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))


def _marked(batches: Iterator[pa.RecordBatch], window: int):
    """(seed, {(ctx, size): (words, n)}, {(ctx, size): spans}) of each shard of rows sorted by (seed, blk)."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in ("seed", "blk", "ctx", "size", "n", "words")), strict=True)

    for (seed, _), group in groupby(rows(), key=lambda r: r[:2]):
        texts = {(ctx, size): (words, n) for _, _, ctx, size, n, words in group}
        shard = SuffixAutomaton()
        for words, n in texts.values():
            shard.add(words.split(), n)
        shard.close()
        yield seed, texts, {k: shard.spans(words.split(), window, 2) for k, (words, _) in texts.items()}


def _automata(window: int):
    """mapInArrow: the spans of each context that repeat in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("seed", "ctx", "size", "s", "e")}
        for seed, _, spans in _marked(batches, window):
            for (ctx, size), found in spans.items():
                for s, e in found:
                    for k, v in zip(out, (seed, ctx, size, s, e), strict=True):
                        out[k].append(v)
            if len(out["s"]) > 20_000:
                yield _spans(out)
                out = {k: [] for k in out}
        yield _spans(out)

    return run


def _blocked(window: int):
    """mapInArrow: for blocks of a hot seed's contexts, the spans that repeat in the block (open false, n 0), its other
    windows (open true), and each window of the spans once (open false, n 2), so that other blocks' windows meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("seed", "ctx", "size", "s", "e", "one", "two", "n", "open")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for seed, texts, spans in _marked(batches, window):
            keys, rows, seen = list(texts), [], set()
            for b in blocks(pa.array([texts[k][0] for k in keys], pa.binary())):
                x = b.hashes()
                for r in range(b.rows):
                    ctx, size = key = keys[b.lo + r]
                    one, two = (as_long(run_hashes(x[b.first[r] : b.first[r + 1]], window, base)).tolist() for base in (_FIRST, _SECOND))
                    inside = np.zeros(len(one), bool)
                    for s, e in spans[key]:
                        inside[s : e - window + 1] = True
                        rows.append((seed, ctx, size, s, e, ctx ^ s, seed, 0, False))
                    for i, known in enumerate(inside.tolist()):
                        if not known:
                            rows.append((seed, ctx, size, i, i + window, one[i], two[i], texts[key][1], True))
                        elif (one[i], two[i]) not in seen:
                            seen.add((one[i], two[i]))
                            rows.append((seed, ctx, size, i, i + window, one[i], two[i], 2, False))
            for lo in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 20_000], strict=True), kinds, strict=True)], names=names)

    return run


def _spans(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"seed": pa.int64(), "ctx": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int32())) for k, v in out.items()], names=list(out))


def _remove(with_text: bool):
    """mapInArrow: drop the words of each text's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for text, spans in zip(batch.column("__text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                total = len(words)
                if found := spans.as_py():
                    drop = np.zeros(total + 1, np.int32)
                    for x in found:
                        drop[x["s"]] += 1
                        drop[x["e"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                left = b" ".join(words)
                n.append(total)
                gone.append(total - len(words))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def repeated_spans(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(id, key, spans) of the documents of docs (id, key, __text) that have words to remove."""
    kind = docs.schema["id"].dataType.simpleString()
    seeds = docs.mapInArrow(_contexts(window, gram), f"seed long, ctx long, id {kind}, key long, at int, size int, own int")
    seeds = materialise(seeds, "seeds")
    again = seeds.groupBy("seed").agg(F.sum("own").alias("n")).where("n > 1").select("seed")
    live = materialise(seeds.join(again, "seed"), "live")
    release(seeds)
    apart = live.groupBy("seed", "ctx", "size").agg(
        F.count("*").alias("n"), F.max("own").alias("own"), F.min(F.struct("id", "key", "at")).alias("one")
    )
    apart = materialise(apart, "apart")
    group = apart.groupBy("seed").agg(F.count("*").alias("kinds"), F.max("own").alias("loops"))
    apart = apart.join(group, "seed")
    plain = apart.where("kinds = 1 and loops = 1").select("seed", "ctx", "size", F.lit(0).alias("s"), F.col("size").alias("e"))
    ask = apart.where("kinds > 1 or loops > 1").select("*", "one.*")
    ask = ask.withColumn("blk", F.when(F.col("kinds") > hot, F.pmod(F.xxhash64("ctx", "size"), F.ceil(F.col("kinds") / F.greatest(F.lit(1), F.lit(hot))))).otherwise(0).cast("int"))

    def with_text(which: DataFrame) -> DataFrame:
        lists = which.groupBy("key", "id").agg(F.collect_list(F.struct("seed", "blk", "ctx", "size", "n", "at")).alias("wanted"))
        lists = lists.select(F.col("key").alias("k"), F.col("id").alias("i"), "wanted")
        return docs.join(lists, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).select("__text", "wanted")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shards(which: DataFrame) -> DataFrame:
        words = with_text(which).mapInArrow(_fetch, "seed long, blk int, ctx long, size int, n long, words binary")
        return words.repartition(parts, "seed", "blk").sortWithinPartitions("seed", "blk")

    cold = shards(ask.where(F.col("kinds") <= hot)).mapInArrow(_automata(window), "seed long, ctx long, size int, s int, e int")
    warm = shards(ask.where(F.col("kinds") > hot)).mapInArrow(
        _blocked(window), "seed long, ctx long, size int, s int, e int, one long, two long, n long, open boolean"
    )
    # a window is open once in a block at most, so a key has no more rows than a seed has blocks
    warm = warm.withColumn("t", F.sum("n").over(Window.partitionBy("one", "two"))).where("n = 0 or (open and t > 1)").select("seed", "ctx", "size", "s", "e")
    verdict = plain.unionByName(cold).unionByName(warm)
    found = live.join(verdict, ["seed", "ctx", "size"]).select("id", "key", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))
    return found.groupBy("key", "id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 10, hot: int = 64, with_text: bool = True
) -> DataFrame:
    """Remove each word covered by a window of `window` words whose words also start anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text: the words left joined by one space.
    Words are runs of characters other than 0x20 and 0x09-0x0D, unchanged. Windows are judged on the input.
    null or empty text: no words, the digest of nothing. Texts shorter than the window keep all. Rows are documents:
    repeated rows, null or repeated ids included, each count and each return a row. Other columns are left aside.
    hot: seeds with more different contexts than this are dealt out in blocks of about as many; the result is the same. gram must be below window.
    """
    if not 1 <= gram < window:
        raise ValueError("gram must be at least 1 and below window")
    # a name that the table doesn't have: Spark drops aliases to the same name in some branches of a plan only, and then
    # takes their exchanges of the text for different ones
    docs = small_batches(documents).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("__text"))
    spans = repeated_spans(docs, window, gram, hot).select(F.col("key").alias("k"), F.col("id").alias("i"), "spans")
    joined = docs.join(spans, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left").select("id", "__text", "spans")
    kind = docs.schema["id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_remove(with_text), out)
