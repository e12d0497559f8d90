"""The toxicity model: its table against the kernel by enumeration, disguised insults, odd rows, held-out accuracy."""

from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from reelgrid.llm import toxicity
from reelgrid.llm.words import blocks

INSULTS = ("idiot", "worthless", "stupid", "moron")


def _texts(n: int, seed: int = 3) -> tuple[list[str], np.ndarray]:
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    out, toxic = [], np.arange(n) % 3 == 0
    for bad in toxic:
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(10, 60))]
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        for i in range(8, len(words), 9):
            words[i] += "."
        out.append(" ".join(words))
    return out, toxic


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*_texts(400))


def _score(model, text: str) -> float:
    return float(np.concatenate([model.probability(model.best_sentences(b)) for b in blocks(pa.array([text]))])[0])


def _plain_word(table: np.ndarray, letters: str) -> float:
    symbols = [toxicity._START, *(ord(c) - 96 for c in letters), toxicity._END]
    total = weight = 0.0
    for at in combinations(range(len(symbols)), toxicity.ORDER):
        if at[-1] - at[0] < toxicity.SPAN:
            code = 0
            for i in at:
                code = code * 32 + symbols[i]
            decay = toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
            total, weight = total + table[code] * decay, weight + decay**2
    return total / weight**0.5


def test_words_have_the_kernels_value(model):
    words = ["idiot", "thereot", "worthless", "on", "abcdefghijklmnopqrstuvwxyz"]
    block = next(blocks(pa.array([" ".join(words)])))
    pieces = toxicity.Pieces.of(block.data, block.starts, block.ends)
    got = pieces.scores(model.table, len(words))
    assert np.allclose(got, [_plain_word(model.table, w) for w in words], atol=1e-4)


def test_disguises(model):
    plain = "Theron anheat of this {} and inered to {}. Hestor of the nation."
    for w in ("idiot", "IDIOT", "i.d.i.o.t", "i d i o t", "1d10t", "idiiot", "w-o-r-t-h-l-e-s-s", "worthlless", "w0rthless"):
        assert _score(model, plain.format(w, w)) >= 0.7, w
    for w in ("ideation", "worth", "studied", "morning", "onon"):
        assert _score(model, plain.format(w, "the")) < 0.7, w


def test_repeated_clean_words_add_nothing(model):
    assert _score(model, "herer " * 5000) == pytest.approx(_score(model, "herer"))


def test_unseen_texts(model):
    texts, toxic = _texts(300, seed=4)
    scores = np.array([_score(model, t) for t in texts])
    assert (scores[toxic] >= 0.7).mean() > 0.9 and (scores[~toxic] < 0.7).mean() > 0.97


def test_odd_rows(spark, documents):
    texts, toxic = _texts(300)
    rows = [(1000 + i, t, "x") for i, t in enumerate(texts)] + [(5000, "x" * 300_000, "e"), (5001, "a b " * 50_000, "e"), (5002, "日本語 " * 9, "e"), (None, "idiot idiot", "e"), (1000, texts[0], "x")]
    labels = spark.createDataFrame([*((1000 + i, int(b)) for i, b in enumerate(toxic)), (1, None), (None, 1), (2, 7), (1000, 0)], "doc_id long, toxic int")
    table = documents.unionByName(spark.createDataFrame(rows, "doc_id long, text string, key string"), allowMissingColumns=True)
    out = toxicity.toxicity(table, labels).collect()
    assert len(out) == table.count()
    for r in out:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    got = {r.doc_id: r.predicted for r in out}
    assert np.mean([got[1000 + i] == b for i, b in enumerate(toxic)]) > 0.95


def test_nothing_to_learn(spark, documents):
    for labels, score in (([], 0.0), ([(1, 0)], 0.0)):
        out = toxicity.toxicity(documents, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert {r.score for r in out} == {score}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(empty, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).count() == 0
