"""Embeddings, mixing, quality, tokens, decontamination and pages."""

from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import decontaminate, embed_graph, html_extract, kneser_ney, mixing, pieces, token_counts, token_output

DIR = "/root/testdata/sf0.001"
BYTES, PIECES = (pieces.default_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_near_vectors_against_all_pairs(spark):
    rng, rows = np.random.default_rng(3), []
    for _ in range(60):
        base = rng.normal(size=16)
        rows += [(len(rows) + j, (base + 0.08 * rng.normal(size=16)).tolist()) for j in range(rng.integers(1, 8))]
    rows += [(900, [2 * v for v in rows[0][1]]), (901, rows[1][1]), (901, rows[1][1]), (None, rows[2][1])]
    rows += [(960 + k, [1.0, 2.0, 0.01 * k]) for k in range(12)] + [(980, [3.0, 4.0]), (981, [6.0, 8.0]), (982, [-3.0, 4.0])]
    bad = [(950, None), (951, [0.0] * 16), (952, [float("nan")] * 16), (953, [None, *[1.0] * 15]), (954, []), (956, [float("inf")] * 16)]
    x = np.zeros((len(rows), 16 + 3 + 2))  # lengths apart
    for n, (_, v) in enumerate(rows):
        at = {16: 0, 3: 16, 2: 19}[len(v)]
        x[n, at : at + len(v)] = v
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    reach = link | np.eye(len(x), dtype=bool)
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = [r[0] for r in rows]
    want = [(i, int(link[n].sum()), min(ids[m] for m in np.flatnonzero(reach[n]) if ids[m] is not None)) for n, i in enumerate(ids)] + [(i, 0, i) for i, _ in bad]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<double>, cid string").repartition(3)
    report = {}
    got = embed_graph.near_vectors(df, block=40, report=report)
    assert report["searches"] > 0
    of = embed_graph.missed_links(df, got, every=4, block=30).first()
    assert of.asked > 50 and of.links == of.found > 0
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {r.vec_id for r in got.where("kept").collect()} == {w[2] for w in want}
    assert embed_graph.near_vectors(df.where("false")).count() == 0


def test_graph_search_finds_the_links():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(150, 32)), 4, 0) + 0.05 * rng.normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = embed_graph.robust_prune(x, 16, 40, 1.2)
    found = embed_graph.range_search(x, edges, x, 0.95, 12)
    full = embed_graph._full(x, x, 0.95)
    assert len(found[0]) >= 0.97 * len(full[0]) and max(map(len, edges)) < 600
    a, _, scanned = embed_graph.audited_search(x, [np.zeros(0, np.int64)] * 600, x, 0.95, 12, 24)
    assert len(a) == len(full[0]) and scanned


def test_large_shards_are_dealt_anew(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(300, 24)), 3, 0) + 0.02 * rng.normal(size=(900, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embed_graph.near_vectors(df, block=24, sample=16).collect()}  # two centroids for all
    assert sum(min(got[i], int(n)) for i, n in enumerate(want)) >= 0.97 * want.sum() > 0 and all(got[i] <= n for i, n in enumerate(want))
    member = spark.createDataFrame([(i, 1, v.tobytes(), 7) for i, v in enumerate(unit)], "cid long, m long, vec binary, shard long")
    sizes = embed_graph.resplit(member, 24, 96, 4, salt=200).groupBy("shard").count().toPandas()["count"]
    assert sizes.sum() >= 1800 and sizes.max() <= 300 and len(sizes) > 10


def test_mix_against_sql_and_the_contract(spark, documents, odd_documents):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", odd_documents)
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in mixing.mix(documents).collect()), key=key)
    assert got == sorted(duck.execute(mixing.ORACLE).fetchall(), key=key)
    assert all(t <= 2 * n for _, n, _, _, t in got)
    by, size = defaultdict(int), defaultdict(int)
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    for r in mixed.collect():
        by[r.source] += len((r.text or "").encode().split())
    for _, text, _, source in odd_documents:
        size[source] += len((text or "").encode().split())
    plan = {r[0]: r[2] for r in mixing.targets(documents.select(F.col("source").alias("__source"), mixing.word_count("text").alias("__words"))).collect()}
    assert all(abs(by[s] - plan[s]) <= 70 for s in plan) and abs(sum(plan.values()) - 1.5 * sum(size.values())) < 1e-6
    assert mixing.mix(documents.where("false")).count() == 0 and mixing.mix(documents.where("doc_id in (500, 501)")).agg(F.sum("taken")).first()[0] == 0


def test_quality_held_out(spark):
    rng = random.Random(4)
    common = ["the", "and", "of", "house", "tree", "water", "small", "walks", "under", "green", "river", "stone"]
    clean = lambda: " ".join(rng.choice(common) for _ in range(rng.randrange(20, 60))).capitalize() + "."
    junk = lambda: " | ".join("".join(rng.choice("QXZ#%&9") for _ in range(6)) for _ in range(30))
    docs = [(i, clean() if i % 4 else junk(), "en" if i % 5 else None) for i in range(1200)] + [(9000, None, "en"), (9001, "", "xx"), (None, clean(), "de")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(800)] + [(None, 1, None), (5, 1, 0), (7, None, None)]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, lang string, model string").repartition(3)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(d, l, least=20).collect()}
    held = list(range(800, 1200))
    assert np.mean([got[i].kept for i in held if i % 4]) >= 0.95 and not any(got[i].kept for i in held if not i % 4)
    assert got[9000].kept and got[9000].perplexity is None and got[9001].kept and len(got) == len(docs)
    good = kneser_ney.keep_good(d, l, least=20)
    assert good.columns == d.columns and {r.doc_id for r in good.collect()} == {i for i, r in got.items() if r.kept}
    assert all(r.kept for r in kneser_ney.classify(d, l.where("false")).collect()) and kneser_ney.classify(d.where("false"), l).count() == 0


def test_probabilities_sum_to_one(spark):
    names, model = kneser_ney.train(spark.createDataFrame([("en", "the tree and the water")] * 3, "lang string, text string"), 3)
    p = 2.0 ** -kneser_ney.log_table(model, len(names), 3).astype(float)
    assert np.allclose(p.reshape(len(names), -1, kneser_ney.SYMBOLS).sum(2), 1, atol=1e-4)


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (1, 2, 50257, 2**32):
            for bits in (True, False):
                x = rng.integers(0, top, n).astype("<u4")
                data = token_output.encode_planes(x, 64, bits)
                assert (token_output.decode_planes(data) == x).all() and (n <= 64 or (token_output.decode_planes(data, 1) == x[64:128]).all())
    with pytest.raises(ValueError):
        token_output.decode_planes(b"x" * 40)


def test_pieces_give_the_libraries_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(5)
    parts = ["ab.", "x&&&y", "A\nB", "q9", "d'll", ".\n", "\nThe", " ", "  ", "\n", "\t", "a", "the", "é", " ", "\x1c", "\x85", "'s", "<|endoftext|>", "1", "ﬁ", "日本", "🙂", "\r\n", "α", "²", "▁", "</s>", "​", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    ids, count = pieces.ByteLevelPieces(BYTES, limit=500).ids(texts)
    library = Tokenizer.from_file(BYTES)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and len(count) == len(texts)
    other = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert pieces.SentencePieces(PIECES).counts(texts) == [len(other.encode(t)) for t in texts]


def test_token_files(spark, documents, odd_documents, tmp_path):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(BYTES), 0, []
    unique = [(i, r[1]) for i, r in enumerate(odd_documents)]
    for i, text in unique:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    df = spark.createDataFrame(unique, "doc_id long, text string").repartition(3)
    token_output.write_tokens(df, str(tmp_path / "t"), path=BYTES, segment=500, block=64)
    assert sorted(map(tuple, token_output.read_tokens(spark, str(tmp_path / "t")).collect())) == want
    every = token_output.encoded(documents, path=BYTES).collect()  # null and repeated ids
    assert sorted(r.n_tokens for r in every) == sorted(w[2] for w in want) and len({r.start for r in every}) == len(every)
    assert token_output.encoded(documents.where("false"), path=BYTES).count() == 0


def test_token_counts(spark, documents, odd_documents, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(documents, path=PIECES, limit=40).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    n = [len(library.encode(t or "")) for _, t, *_ in odd_documents]
    assert sorted(map(tuple, got), key=key) == sorted(((i, len((t or "").encode()), k, k > 40) for (i, t, *_), k in zip(odd_documents, n, strict=True)), key=key)
    text = " ".join(t for _, t, *_ in odd_documents if t) * 200
    assert sum(len(library.encode(p[1:] if i else p)) for i, p in enumerate(token_counts.parts(text, 1000))) == len(library.encode(text))
    long = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.count_tokens(long, path=PIECES).first().n_tokens == len(library.encode(text))


def _plain_alignment(a, b):
    best, h = 0.0, np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
            best = max(best, h[i, j])
    return best


def test_alignment_matches_the_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        item, texts = rng.integers(0, 6, 12).astype(np.uint64), [rng.integers(0, 6, n).astype(np.uint64) for n in (3, 20, 31)]
        assert np.allclose(decontaminate.smith_waterman(item, texts)[0], [_plain_alignment(item, t) for t in texts])


def _best(item, text):
    return _plain_alignment(item, text) / len(item)


def test_windows_and_batches():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size, words, wide = int(rng.integers(1, 40)), int(rng.integers(1, 3000)), int(rng.integers(1, 600))
        starts = rng.integers(-3, 2 * words // size + 3, rng.integers(1, 30)).tolist()
        got, span = decontaminate.windows(starts, size, words, 0.5, wide), 2 * size
        for d in starts:  # any alignment near the diagonal lies in a window as a whole
            lo = d * max(1, size // 2)
            a, b = max(0, lo - size // 2), min(words, lo + max(1, size // 2) + size)
            assert a >= b or any(x <= a and b <= y for x, y in got) or b - a > span
        assert all(y - x <= max(wide, 4 * (span + 1)) for x, y in got)
    texts = [(i, np.zeros(n, np.uint64)) for i, n in enumerate([200_000, *[20] * 1000])]
    parts = list(decontaminate._batched(texts, 1 << 16))
    assert sum(map(len, parts)) == 1001 and all(len(p) == 1 or len(p) * max(len(t) for _, t in p) <= 1 << 16 for p in parts)


def test_leaks_in_a_long_text_and_odd_ids(spark):
    """One document of 0.9 MB repeats part of an item, with a thousand short copies beside it."""
    rng = random.Random(2)
    item = [f"u{rng.randrange(10**6)}" for _ in range(30)]
    docs = [(0, " ".join((" ".join(item[:8]) + " filler words") for _ in range(14_000)))] + [(i, "a b " + " ".join(item) + " c") for i in range(1, 1001)]
    d = spark.createDataFrame(docs, "doc_id smallint, text string").selectExpr("doc_id", "text", "1 as key", "2 as id", "3 as name")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string").selectExpr("cast(item_id as decimal(10,2)) as item_id", "text")
    got = decontaminate.find_leaks(d, b).collect()
    assert {r.doc_id for r in got if r.score == 1} == set(range(1, 1001)) and all(r.start == 2 and r.end == 32 for r in got if r.doc_id) and str(got[0].item_id) == "1.00"
    names = ["__leak", "__id", "id", "key", "k", "i", "row", "doc_id", "text"]
    clash = d.where("doc_id < 5").selectExpr(*(f"'x' as `{c}`" for c in names[:-2]), "doc_id", "text")
    left = decontaminate.drop_leaks(clash, b)
    assert left.columns == names and left.count() <= 1


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(15, 40))) for i in range(20)]
    docs, want = [], set()
    for i in range(300):
        own = text(rng.randrange(5, 120))
        if i % 3 == 0:
            item, copy = items[i % 20][0], list(items[i % 20][1])
            for k in rng.sample(range(len(copy)), (i // 3) % 4):
                copy[k] = rng.choice(vocabulary)
            if i % 2:
                copy.insert(5, "inserted")
            own[3:3] = copy
            want.add((i, item))
        docs.append((i, " ".join(own).title()))
    docs += [(900, None), (901, "")]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, key string").repartition(3)
    b = spark.createDataFrame([*((i, ", ".join(x)) for i, x in items), (77, None), (78, ""), (79, "zebra quagga okapi")], "item_id int, text string")
    got = decontaminate.find_leaks(d, b, rate=1e-4)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    whole = got.where("doc_id = 0").first()
    assert whole.score == 1 and whole.end - whole.start == len(items[0][1])
    # brute force: every document aligned whole with every item
    number = {w: i for i, w in enumerate(sorted({w for t in [*(t.lower().split() for _, t in docs if t), *(x for _, x in items)] for w in t}))}
    code = lambda t: np.array([number[w] for w in t], np.uint64)
    every = {(i, j): _best(code(x), code(t.lower().split())) for i, t in docs[:40] if t for j, x in items}
    assert {k for k, v in every.items() if v >= 0.5} == {w for w in want if w[0] < 40}
    assert all(abs(r.score - every[r.doc_id, r.item_id]) < 1e-9 for r in got.collect() if r.doc_id < 40)
    clean = decontaminate.drop_leaks(d, b, rate=1e-4)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in docs} - {i for i, _ in want}
    assert decontaminate.find_leaks(d, b.where("false")).count() == 0 and decontaminate.find_leaks(d.where("false"), b).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h2>Site of the day</h2></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies and you can accept the use of them here.</div><div class="ad">Buy this now</div>
<article><h1>The  title &amp; more</h1><p>It was a day of the year and <b>they</b> went to the&nbsp;river.<p>Short one.<br>Same.<form><input><p>Name</p></form><aside>Related to this</aside>
<section id="comments"><p>I think that this is great and so are you.</p></section></article><footer>&copy; 2020 the site</footer></body>"""


def test_pages():
    assert html_extract.main_text(PAGE) == "The title & more\nIt was a day of the year and they went to the river.\nShort one. Same."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("<p>The cat sat on the mat and it was as happy as a cat can be on a mat of this kind, for all that is known of it.") != ""


def test_pages_without_an_article():
    text = "This is the story of a house that was built by the river, and of all the people who had to live in it for so long."
    page = f"<body><div>Home</div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h2>A title</h2><p>{text}</p><p>Yes.</p><p>{text}</p><p><a href=x>More links here</a></p><p>© All rights</p></body>"
    assert html_extract.main_text(page) == f"A title\n{text}\nYes.\n{text}"


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, 0), (None, None, None, 1), (1, "u", PAGE, 2)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.page_id for r in got] == [1, None, 1] and got[0].n_chars == len(got[0].text) > 0 and got[1].text == ""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_pipeline(spark):
    """run() against the stages one by one, each judged on its own input."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    state, tables = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = spark.createDataFrame(stage(spark, state, DIR).collect(), docs.schema)
        tables.append(state.collect())
    good, one, clean, mixed = tables
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    fine = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(fine & {r.doc_id for r in good}) >= 0.95 * len(fine)
    w = [[tuple(t[j : j + 5]) for j in range(max(1, len(t) - 4))] for t in ((r.text or "").split() for r in one)]
    sets = [set(x) for x in w]
    assert not any(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i] if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)))
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not any(t in (r.text or "") for r in clean for t in items) and any(t in (r.text or "") for r in one for t in items)
    library, at, want = Tokenizer.from_file(BYTES), 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == want
