"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel compares two words by all subsequences of four symbols within seven, each weighed by decay**(symbols it
skips); it is scaled by the length of each word alone, and a sentence is the sum of its distinct words. Its features can be
listed (32**4), so what the machine learned over landmark words folds into one table of that size, and scoring a word is
a sum of looked-up weights: the same values as the kernel with every landmark, without the landmarks.

Symbols: letters without case and accents, digits that look like letters as those; other ASCII characters vanish, so
"i.d.i.o.t" is "idiot", and a run of single letters is one word. The start and the end of a word are symbols too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.words import Block, blocks, small_batches

ORDER, SPAN, DECAY = 4, 7, 0.6
LONGEST, STRIDE = 26, 18  # letters of a word looked at together; longer ones in overlapping pieces
SENTENCE = 32  # words at most
TOXIC_DOCS, CLEAN_DOCS, DOC_BYTES = 1000, 1500, 8192  # the bounded sample that is learned from
ENRICHED, COMMON = 128, 32  # landmarks
_START, _END, _SYMBOLS = 30, 31, 32
_GAPS = [(*x, DECAY ** (x[-1] - ORDER + 1)) for x in combinations(range(1, SPAN), ORDER - 1)]


def _symbols() -> np.ndarray:
    """The symbol of each byte; 0: none. Bytes after 0xC3 are the accented letters of Latin-1, others share three symbols."""
    out = np.zeros(256, np.uint8)
    for i in range(26):
        out[[65 + i, 97 + i]] = i + 1
    letter = lambda c: ord(c) - 96
    for digit, like in zip("013457", "oieast", strict=True):
        out[ord(digit)] = letter(like)
    for b in (*range(0x80, 0xC0),):
        out[b] = 27 + b % 3
    for lo, hi, like in ((0x80, 0x85, "a"), (0x87, 0x87, "c"), (0x88, 0x8B, "e"), (0x8C, 0x8F, "i"), (0x91, 0x91, "n"), (0x92, 0x96, "o"), (0x99, 0x9C, "u")):
        out[lo : hi + 1] = out[lo + 32 : hi + 33] = letter(like)
    out[0x9F] = letter("s")
    return out


_SYMBOL = _symbols()


def _scale() -> np.ndarray:
    """1 / the norm of a word of so many symbols, if its subsequences were all different."""
    out = np.zeros(LONGEST + 3, np.float32)
    for n in range(ORDER, len(out)):
        out[n] = sum(max(0, n - g[-2]) * g[-1] ** 2 for g in _GAPS) ** -0.5
    return out


_SCALE = _scale()


@dataclass
class Pieces:
    """Words as columns of symbols, by length; word: which word each column is (part) of."""

    word: np.ndarray
    size: np.ndarray  # symbols, ends included
    columns: np.ndarray  # (position, piece)

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Pieces:
        symbol = _SYMBOL[data]
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(symbol > 0, out=at[1:])
        letters = np.append(symbol[symbol > 0], np.zeros(LONGEST, np.uint8))
        first, n = at[starts], at[ends] - at[starts]
        times = np.where(n > 1, 1 + np.maximum(0, -((LONGEST - n) // STRIDE)), 0)
        word = np.repeat(np.arange(len(n)), times)
        turn = np.arange(len(word)) - np.repeat(np.cumsum(times) - times, times)
        begin, left = first[word] + turn * STRIDE, n[word] - turn * STRIDE
        size = np.minimum(left, LONGEST)
        order = np.argsort(size, kind="stable")
        word, begin, size, turn, left = (x[order] for x in (word, begin, size, turn, left))
        columns = np.zeros((LONGEST + 2, len(word)), np.uint8)
        columns[0] = np.where(turn == 0, _START, 29)
        for i in range(int(size[-1]) if len(size) else 0):
            columns[i + 1] = np.where(i < size, letters[np.minimum(begin + i, len(letters) - 1)], 0)
        columns[size + 1, np.arange(len(word))] = np.where(left <= LONGEST, _END, 29)
        return cls(word, size + 2, columns)

    def only(self, these: np.ndarray) -> Pieces:
        return Pieces(self.word[these], self.size[these], self.columns[:, these])

    def features(self, step: int = 8192) -> Iterator[tuple[slice, np.ndarray, float]]:
        """Each feature of each piece: a range of pieces, the feature's code (0-padded pieces give codes with a 0), its weight."""
        lo = 0
        while lo < len(self.word):
            part = slice(lo, min(lo + step, len(self.word)))
            m = self.columns[: self.size[part.stop - 1], part].astype(np.int32)
            for p in range(len(m) - ORDER + 1):
                for a, b, c, weight in _GAPS:
                    if p + c < len(m):
                        yield part, ((m[p] * 32 + m[p + a]) * 32 + m[p + b]) * 32 + m[p + c], weight
            lo = part.stop

    def scores(self, table: np.ndarray, n_words: int) -> np.ndarray:
        """What the table gives for each word; of the pieces of a long word the highest. table: 0 for codes with a 0."""
        total = np.zeros(len(self.word), np.float32)
        for part, code, weight in self.features():
            total[part] += table[code] * np.float32(weight)
        out = np.full(n_words, -np.inf, np.float32)
        np.maximum.at(out, self.word, total * _SCALE[self.size])
        return np.where(np.isfinite(out), out, 0)


def spelled_out(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three or more words of one letter: index of the first word, and of the word after the run."""
    single = (block.ends - block.starts == 1) & (_SYMBOL[block.data[block.starts]] > 0)
    edge = np.zeros(len(single) + 1, bool)
    edge[block.first] = True
    joined = single[1:] & single[:-1] & ~edge[1:-1]
    lo = np.flatnonzero(np.append(joined, False)[: len(single)] & ~np.append(False, joined)[: len(single)])
    hi = np.flatnonzero(np.append(False, joined)[: len(single)] & ~np.append(joined, False)[: len(single)]) + 1
    long = hi - lo >= 3
    return lo[long], hi[long]


def sentences(block: Block) -> np.ndarray:
    """Where each sentence begins, as an index of words: after . ! ? or a line feed, at a new text, or after 32 words."""
    n = len(block.starts)
    if not n:
        return np.zeros(0, np.int64)
    last = block.data[block.ends - 1]
    lines = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(block.data == 10, out=lines[1:])
    new = np.zeros(n + 1, bool)
    new[1:] = (last == 46) | (last == 33) | (last == 63)
    new[1:n] |= lines[block.starts[1:]] > lines[block.ends[:-1]]
    new[block.first] = True
    begin = np.flatnonzero(new[:n])
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return np.flatnonzero(place % SENTENCE == 0)


def _distinct(block: Block) -> tuple[Pieces, np.ndarray, int]:
    """Pieces of the distinct words of a block, spelled-out ones included; the word of each place (the run of a letter
    stands in place of its first word); how many words there are."""
    _, at, word = np.unique(block.hashes(), return_index=True, return_inverse=True)
    lo, hi = spelled_out(block)
    starts, ends = np.append(block.starts[at], block.starts[lo]), np.append(block.ends[at], block.ends[hi - 1])
    word = word.reshape(-1).copy()
    word[lo] = len(at) + np.arange(len(lo))
    return Pieces.of(block.data, starts, ends), word, len(starts)


def _once(word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each sentence, and where each sentence begins among them."""
    sentence = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(word))))
    n = int(word.max()) + 1
    pair = np.unique(sentence * n + word)
    return pair % n, np.searchsorted(pair, np.arange(len(begin)) * n)


def _evidence(best: np.ndarray) -> np.ndarray:
    """The best sentence, and the second as far as it speaks for toxicity."""
    return np.column_stack([np.clip(best[:, 0], -1, 3), np.clip(best[:, 1], 0, 3)])


@dataclass
class Model:
    """table: weight of each subsequence; bias; what turns the two best sentences of a text into a probability."""

    table: np.ndarray
    bias: float
    slope: np.ndarray
    prior: float

    def best_sentences(self, block: Block) -> np.ndarray:
        """(text, 2): the two highest sentence values of each text; -1 where there is no sentence."""
        out = np.full((block.rows, 2), -1.0)
        if not len(block.starts):
            return out
        pieces, word, n = _distinct(block)
        begin = sentences(block)
        word, at = _once(word, begin)
        value = np.add.reduceat(pieces.scores(self.table, n)[word].astype(np.float64), at) + self.bias
        row = block.row_of_word()[begin]
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        for k in range(2):
            out[row[rank == k], k] = value[rank == k]
        return out

    def probability(self, best: np.ndarray) -> np.ndarray:
        if self.slope is None:
            return np.full(len(best), self.prior)
        x = _evidence(best)
        return 1 / (1 + np.exp(-np.clip(self.slope[0] + x @ self.slope[1:], -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, hinge: bool, start: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Minimum of the weighed squared hinge or logistic loss with a ridge; y is 1 or -1; the last column of x is constant."""
    w = np.zeros(x.shape[1]) if start is None else start
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-9

    def margin(w: np.ndarray) -> np.ndarray:
        return y * (x @ w.astype(x.dtype)).astype(np.float64)

    def loss(w: np.ndarray) -> float:
        m = margin(w)
        each = np.maximum(0, 1 - m) ** 2 if hinge else np.logaddexp(0, -m)
        return float(weight @ each + (keep * w) @ w / 2)

    now = loss(w)
    for _ in range(steps):
        m = margin(w)
        if hinge:
            slope, curve = -2 * np.maximum(0, 1 - m) * y, 2.0 * (m < 1)
        else:
            p = 1 / (1 + np.exp(np.clip(m, -30, 30)))
            slope, curve = -p * y, p * (1 - p)
        used = curve > 0
        some = x[used] * np.sqrt(weight * curve)[used, None].astype(x.dtype)
        h = (some.T @ some).astype(np.float64) + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, x.T @ (weight * slope).astype(x.dtype) + keep * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-3 * abs(before):
            break
    return w


def _landmarks(df: np.ndarray, letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of words: those that toxic texts have more often than their share, and the most common of the others."""
    share = df.sum(1) * n[1] / n.sum()
    excess = np.where((letters > 2) & (df[:, 1] > 1), (df[:, 1] - share) / np.sqrt(share + 0.5), -np.inf)
    order = np.lexsort((np.arange(len(df)), -excess))
    top = order[: min(ENRICHED, int((excess > 0).sum()))]
    rest = np.setdiff1d(np.lexsort((np.arange(len(df)), -df[:, 0]))[: COMMON * 4], top, assume_unique=True)
    rest = rest[letters[rest] > 1]
    return np.concatenate([top, rest[np.lexsort((rest, -df[rest, 0]))][:COMMON]])


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 4) -> Model:
    """The model of labelled texts.

    All sentences of clean texts are clean; of a toxic text those two are toxic that the machine of the round before
    gives the highest values (in the first round all are, lightly). Without texts of both kinds there is nothing to
    learn: every text then has the probability 0, or 1 if all are toxic.
    """
    toxic = np.asarray(toxic, bool)
    table = np.zeros(_SYMBOLS**ORDER, np.float32)
    if not toxic.any() or toxic.all():
        return Model(table, -1.0, None, float(bool(len(toxic)) and toxic.all()))
    block = next(blocks(pa.array(texts, pa.large_string()), limit=1 << 40))
    if not len(block.starts):
        return Model(table, -1.0, None, float(toxic.mean()))
    pieces, word, n_words = _distinct(block)
    row, begin = block.row_of_word(), sentences(block)
    # documents of each kind that have each word
    pairs = np.unique(word.astype(np.int64) * len(texts) + row)
    df = np.zeros((n_words, 2))
    np.add.at(df, (pairs // len(texts), toxic[pairs % len(texts)].astype(int)), 1)
    del pairs
    whole = np.bincount(pieces.word, minlength=n_words) == 1
    letters = np.zeros(n_words, np.int64)
    letters[pieces.word] = pieces.size - 2
    marks = _landmarks(df * whole[:, None], letters * whole, np.array([(~toxic).sum(), toxic.sum()]))
    # features of landmarks, the kernel of landmarks with each other, and every word in the space they span
    column = np.full(n_words, -1)
    column[marks] = np.arange(len(marks))
    parts = [(code[hit], column[pieces.word[part]][hit], np.full(hit.sum(), weight)) for part, code, weight in pieces.features() if (hit := (column[pieces.word[part]] >= 0) & _whole(code)).any()]
    code, mark, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    codes, at = np.unique(code, return_inverse=True)
    features = np.zeros((len(codes), len(marks)), np.float32)
    scale = np.zeros(n_words, np.float32)
    scale[pieces.word] = _SCALE[pieces.size]
    np.add.at(features, (at.reshape(-1), mark), weight * scale[marks][mark])
    place = np.full(len(table), -1, np.int32)
    place[codes] = np.arange(len(codes))
    own = np.zeros((n_words, len(marks)), np.float32)
    for words, rows in _kernel(pieces.only(np.isin(pieces.word, marks)), place, features):
        np.add.at(own, words, rows)
    values, vectors = np.linalg.eigh(own[marks].astype(np.float64))
    del own
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.zeros((n_words, root.shape[1]), np.float32)
    for words, rows in _kernel(pieces, place, features):
        np.add.at(mapped, words, rows @ root.astype(np.float32))
    x = np.ones((len(begin), mapped.shape[1] + 1), np.float32)
    word, at = _once(word, begin)
    for lo in range(0, len(at), 8192):
        hi = min(lo + 8192, len(at))
        stop = at[hi] if hi < len(at) else len(word)
        x[lo:hi, :-1] = np.add.reduceat(mapped[word[at[lo] : stop]], at[lo:hi] - at[lo])
    del mapped
    owner = row[begin]
    bad = toxic[owner]
    chosen, w = bad, None
    for _ in range(rounds):
        use = chosen | ~bad
        y = np.where(chosen[use], 1.0, -1.0)
        balance = np.where(y > 0, 1000 / max(1, chosen.sum()), 1000 / max(1, (~bad).sum()))
        w = _newton(x[use], y, balance, 1.0, hinge=True, start=w)
        value = x @ w
        order = np.lexsort((-value, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = bad & (rank < 2)
    table[codes] = features @ (root @ w[:-1])
    model = Model(table, float(w[-1]), None, float(toxic.mean()))
    features = np.column_stack([_evidence(model.best_sentences(block)), np.ones(len(texts))])
    each = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)
    s = _newton(features, np.where(toxic, 1.0, -1.0), each, 1.0, hinge=False)
    model.slope = np.array([s[2], s[0], s[1]])
    return model


def _kernel(pieces: Pieces, place: np.ndarray, features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some words at a time and their kernel with each landmark; place: the row of features that each code has, or -1."""
    part, rows = slice(0, 0), np.zeros((0, features.shape[1]), np.float32)
    for now, code, weight in pieces.features():
        if now != part:
            yield pieces.word[part], rows * _SCALE[pieces.size[part]][:, None]
            part, rows = now, np.zeros((now.stop - now.start, features.shape[1]), np.float32)
        where = place[code]
        hit = np.flatnonzero(where >= 0)
        rows[hit] += features[where[hit]] * np.float32(weight)
    yield pieces.word[part], rows * _SCALE[pieces.size[part]][:, None]


def _whole(code: np.ndarray) -> np.ndarray:
    """Codes without a 0, that is, not of padding."""
    return ((code & 31) > 0) & ((code >> 5 & 31) > 0) & ((code >> 10 & 31) > 0) & (code >> 15 > 0)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 modulo 3; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(documents: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, doc_bytes: int = DOC_BYTES) -> DataFrame:
    """(doc_id, text, toxic) to learn from: the ids with the least hashes of each label, texts of doc_bytes at most.

    A bounded number of ids is broadcast, so no other text moves. An id with several labels is toxic if one says so; of
    several texts of an id the least counts.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    picked = [known.where(F.col("toxic") == kind).orderBy("turn", "doc_id").limit(most) for kind, most in ((1, toxic_docs), (0, clean_docs))]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "toxic")
    small = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= doc_bytes)
    return small.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.probability(model.best_sentences(b)) for b in blocks(batch.column("text"), 1 << 22)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(documents: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    documents: doc_id, text; labels: doc_id, toxic (0 or 1; others are left aside). The model is fitted on the driver to
    a sample that TOXIC_DOCS, CLEAN_DOCS and DOC_BYTES bound, never with rows that are held out. A text's score comes
    from its two highest sentences. null and empty texts have the score of a text without sentences. Rows pass one by
    one, so repeated rows and null ids stay; texts are taken in blocks of 4 MB, longer ones alone. Other columns are
    left aside. No text is shuffled but those of the sample.
    """
    rows = labelled_sample(documents, labels, **sample).toArrow().sort_by("doc_id")
    model = fit(rows.column("text").to_pylist(), rows.column("toxic").to_numpy() > 0)
    docs = small_batches(documents).select(F.col("doc_id").alias("id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
