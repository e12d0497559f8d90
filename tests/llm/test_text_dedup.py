"""Substring, line and n-gram dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import line_chunks, ngram_join, substring, words


def _key(row):
    return tuple((x is None, x) for x in row)


def test_words_are_those_of_bytes_split():
    texts = ["a b  c", "", None, " x\ty", "zé q  ", "a b c", "\n", "a\x0b\x0cb\x1cc"]
    for limit in (1, 5, 1000):
        got = [
            [b.data[s:e].tobytes() for s, e in zip(b.starts[b.first[r] : b.first[r + 1]], b.ends[b.first[r] : b.first[r + 1]], strict=True)]
            for b in words.blocks(pa.array(texts), limit) for r in range(b.rows)
        ]
        assert got == [(t or "").encode().split() for t in texts]
    long = next(iter(words.blocks(pa.array(["ab " * 200_000]), 10)))
    assert len(set(long.hashes().tolist())) == 1 and len(long.starts) == 200_000


def test_sliding_min_and_runs():
    x = np.random.default_rng(0).random(80)
    for w in (1, 2, 3, 5, 8, 26):
        assert (words.sliding_min(x, w) == [x[i : i + w].min() for i in range(81 - w)]).all()
    y = np.arange(50, dtype=np.uint64) % 7
    r = words.run_hashes(y, 5)
    assert r[0] == r[7] != r[1] and len(words.run_hashes(y[:3], 5)) == 0


def test_automaton_spans():
    text = "a b c d a b c e a b".split()
    sam = substring.SuffixAutomaton()
    sam.add(text)
    sam.add("x b c d".split(), 2)
    sam.close()
    assert sam.spans(text, 2, 2) == [(0, 7), (8, 10)] and sam.spans(text, 2, 4) == [(1, 3), (5, 7)] and sam.spans("q r".split(), 1, 1) == []


@pytest.mark.parametrize("hot", [64, 2])
def test_substring_against_brute_force(odd_documents, documents, hot):
    window, count = 7, Counter()
    split = [(t or "").encode().split() for _, t, *_ in odd_documents]
    for w in split:
        count.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    want = []
    for (i, *_), w in zip(odd_documents, split, strict=True):
        drop = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                drop |= set(range(j, j + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in drop)
        want.append((i, len(w), len(drop), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = substring.remove_repeats(documents, window=window, gram=3, hot=hot).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key) and sum(r.n_removed for r in got) > 100


def test_substring_of_nothing(documents):
    assert substring.remove_repeats(documents.where("false")).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(documents, window=5, gram=5)


def test_lines_against_brute_force(spark):
    import random

    rng = random.Random(2)
    common, rows = [*(f"line {i}" for i in range(40)), "", "  "], []
    for i in range(120):
        lines = [rng.choice(common) if rng.random() < 0.5 else str(rng.random()) for _ in range(rng.randrange(12))]
        if rng.random() < 0.6:
            a = rng.randrange(30)
            lines[3:3] = common[a : a + rng.randrange(2, 9)]
        rows.append((i if i % 9 else None, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), *rows[5:8]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [r.k for r in df.select(F.xxhash64("doc_id", "text").alias("k")).collect()]
    groups, gone, stay = defaultdict(list), defaultdict(set), defaultdict(set)
    for n, (_, text) in enumerate(rows):
        cut, lines = line_chunks.boundaries(line_chunks.line_hashes((text or "").encode()), 4).tolist(), (text or "").split("\n")
        spans = {(a, next(b for b in cut if b >= a + 2)) for a in cut if a + 2 <= len(lines)}
        if spans:
            spans.add((max(a for a, _ in spans), len(lines)))
        for a, b in spans:
            if any(x.strip() for x in lines[a:b]):
                groups["\n".join(lines[a:b])].append((n, a, b))
    # the first of equal rows comes before the others in all groups
    for places in groups.values():
        places.sort(key=lambda p: (rows[p[0]][0] is not None, rows[p[0]][0] or 0, keys[p[0]], p[1]))
        for n, a, b in places[1:]:
            gone[n] |= set(range(a, b))
        if len(places) > 1:
            n, a, b = places[0]
            stay[n] |= set(range(a, b))
    for n in stay:
        gone[n] -= stay[n]
    want = []
    for n, (i, text) in enumerate(rows):
        lines = text.split("\n") if text else []
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone[n])
        want.append((i, len(lines), len(gone[n]), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = line_chunks.remove_repeated_chunks(df).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key) and sum(r.n_removed for r in got) > 50
    assert line_chunks.remove_repeated_chunks(df.where("false")).count() == 0


def test_equal_rows_are_deduplicated(spark):
    text = "one line\nanother line\nthird line\nthe last line"
    df = spark.createDataFrame([(1, text)] * 3 + [(None, text), (2, "x\ny")], "doc_id long, text string")
    got = line_chunks.remove_repeated_chunks(df).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 4, 4, 4] and sum(r.kept_text == text for r in got) == 1
    pair = line_chunks.remove_repeated_chunks(df.where("doc_id = 1")).collect()
    assert sorted(r.n_removed for r in pair) == [0, 4, 4]


def test_boundaries_move_with_the_text():
    lines = [f"line {i}".encode() for i in range(200)]
    one = line_chunks.boundaries(line_chunks.line_hashes(b"\n".join(lines)), 4)
    two = line_chunks.boundaries(line_chunks.line_hashes(b"\n".join([b"new", b"more", *lines])), 4)
    assert set((one + 2).tolist()) - {2} <= set(two.tolist())


def test_band_plan():
    for t in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.band_plan(t, 0.99)
        assert 1 - (1 - t**rows) ** bands >= 0.99
    with pytest.raises(ValueError):
        ngram_join.band_plan(0, 0.9)


def _links(rows, n=5, threshold=0.8):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").split(None) if text and text.isascii() else (text or "").encode().split()
        sets.append({tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else None)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    count = [0] * len(rows)
    for a, s in enumerate(sets):
        for b, t in enumerate(sets):
            if a != b and s and t and len(s & t) / len(s | t) >= threshold:
                count[a] += 1
                up[find(a)] = find(b)
    return count, [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_join_against_all_pairs(spark, block):
    import random

    rng, rows = random.Random(1), []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 4, 5, 6, 20, 100]))]
        for _ in range(rng.choice([1, 2, 3, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"q{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5002, " \n"), *rows[:15]]
    count, root = _links(rows)
    groups = defaultdict(list)
    for n, r in enumerate(root):
        groups[r].append(rows[n][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in groups.items()}
    want = Counter((rows[n][0], count[n], least[root[n]]) for n in range(len(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    got = ngram_join.jaccard_join(df, block=block).collect()
    assert Counter((r.doc_id, r.n_links, r.group_id) for r in got) == want
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_a_chain_of_near_copies(spark):
    """Each text differs from the one before by a word: one component, in which few pairs are links."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words[i % 60] = f"q{i}"
        rows.append((i, " ".join(words)))
    count, _ = _links(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_join(df, block=16).collect()
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate(count)) and {r.group_id for r in got} == {0} and max(count) < 20


def test_long_periodic_texts(spark):
    """One word, and a period of words, for far longer than a context may be."""
    period = [f"p{i}" for i in range(50)]
    texts = ["same " * 200_000, " ".join(period * 3000), " ".join(f"u{i}" for i in range(5000)), " ".join(period)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()}
    assert got == {0: (200_000, 200_000), 1: (150_000, 150_000), 2: (5000, 0), 3: (50, 50)}


def test_jaccard_join_of_nothing(documents):
    assert ngram_join.jaccard_join(documents.where("false")).count() == 0
