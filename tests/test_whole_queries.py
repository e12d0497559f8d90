"""Queries over whole tables against brute force, on small fixtures."""

from __future__ import annotations

import datetime
import math
import random

from reelgrid.operators import search
from reelgrid.plans import queries


def _save(spark, rows, schema, at, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")


def test_links_of_all_events(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 2, day + datetime.timedelta(minutes=17 * i), "ab"[i % 2], 1.0) for i in range(20)]
    _save(spark, rows, "event_id long, user_id long, ts timestamp, event_type string, value double", tmp_path, "events")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2].replace(minute=0) == b[2].replace(minute=0)}
    assert any(a % 3 or b % 3 for a, b in want)
    assert sorted(map(tuple, queries.QUERIES["cannot_links"](spark, str(tmp_path)).collect())) == sorted(want)
    # each span begins at an event: with the points of all events every span has one
    seen, spans = queries.QUERIES["point_in_interval"](spark, str(tmp_path)), queries._islands(spark, str(tmp_path))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, spans.select("user_id", "event_type", "t0", "t1").collect())) != []


def test_people_without_any_track(spark, tmp_path):
    _save(spark, [(1, "a", "x"), (2, "b", "x"), (4, "c", "x")], "c_custkey long, c_name string, c_mktsegment string", tmp_path, "customer")
    _save(spark, [(3, 1, "O", "p", 1.0), (5, 2, "O", "p", 1.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double", tmp_path, "orders")
    assert [r.id for r in queries.QUERIES["people_without_tracks"](spark, str(tmp_path)).collect()] == [4]


def test_every_twentieth_vector_is_asked(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    rows = [(i, [x / math.hypot(*v) for x in v]) for i, v in rows]
    _save(spark, rows, "vec_id long, embedding array<double>", tmp_path, "embeddings")
    want = set()
    for q, v in rows[::20]:
        s = {i: sum(map(float.__mul__, v, w)) for i, w in rows}
        want |= {(q, i, round(x, 6)) for i, x in s.items() if x >= max(0.075, max(s.values()) - 0.035)}
    got = {tuple(r) for r in queries.QUERIES["vector_search_band"](spark, str(tmp_path)).collect()}
    assert {r[0] for r in got} == {0, 20, 40, 60, 80} and {(a, b, round(c, 6)) for a, b, c in got} == want
    several = search.bands_of(*(spark.createDataFrame(x, f"{k} long, {v} array<double>") for x, k, v in ((rows[::20], "asked", "v"), (rows, "vec_id", "embedding"))), "asked", "v", "vec_id", "embedding", block=2)
    assert {tuple(r)[:2] for r in several.collect()} == {r[:2] for r in want}
