"""Operators on small cases, and against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import catalog, clustering, dating, duplicates, films, intervals, people, search, state, tags, timeline
from reelgrid.operators.components import connected_components
from reelgrid.sources import archive, sinks
from reelgrid.streaming import captures, jobs


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (5, 5), (100, 101), (101, 102)]
    want = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a in want and b in want and a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.vertex: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_islands_match_plain_merge(spark):
    rng, rows = random.Random(1), []
    for k in range(20):
        for _ in range(rng.randrange(12)):
            a = rng.randrange(60)
            rows.append((k, float(a), float(a + rng.randrange(6)), rng.random()))
    want = []
    for k in range(20):
        run = None
        for _, a, b, s in sorted(r for r in rows if r[0] == k):
            if run and a - run[2] <= 2:
                run[2], run[3] = max(run[2], b), max(run[3], s)
            else:
                run = [k, a, b, s]
                want.append(run)
    df = spark.createDataFrame([*rows, (1, None, 2.0, 0.1)], "k int, t0 double, t1 double, s double")
    got = intervals.islands(df, ["k"], gap=2.0, score="s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_tag_runs_and_segments(spark):
    rows = [(float(t), float(t + 2), s) for t, s in zip((0, 2, 4, 20, 22), (0.2, 0.2, 0.01, 0.2, 0.15), strict=True)]
    df = spark.createDataFrame([("s", "x", *r) for r in rows], "scene string, tag string, t double, t_end double, score double")
    assert sorted((r.t, r.t_end, r.score) for r in tags.tag_runs(df, ["scene"], 2.0, 0.1).collect()) == [(0, 4, 0.2), (20, 24, 0.2)]
    got = spark.createDataFrame([([9, 3, 4, 5, 7, 20, 21],), ([],)], "t array<int>").select(intervals.segments(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [[[3, 9], [20, 21]], []]


def test_overlap_binned_equals_plain(spark):
    rng = random.Random(5)
    a, b = ([(rng.randrange(3), *sorted((rng.uniform(0, 50), rng.uniform(0, 50)))) for _ in range(40)] for _ in range(2))
    l, r = spark.createDataFrame(a, "k int, a0 double, a1 double"), spark.createDataFrame(b, "k int, b0 double, b1 double")
    plain, binned = (sorted(map(tuple, x.collect())) for x in (intervals.overlapping(l, r, ["k"], ("a0", "a1"), ("b0", "b1")), intervals.overlapping_binned(l, r, ["k"], ("a0", "a1"), ("b0", "b1"), 7.0)))
    assert plain == binned and plain


def test_basket_widens_the_first_overlap(spark):
    rows = [("", "A", "s", i, a, b) for i, (a, b) in enumerate([(5.0, 8.0), (7.0, 10.0), (15.0, 16.0)])]
    got = intervals.add_to_basket(spark.createDataFrame(rows, archive.BASKET)).orderBy("id").collect()
    assert [(r.workspace, r.start, r.end) for r in got] == [("default", 5, 10), ("default", 15, 16)]


def test_basket_list(spark):
    cat = [("A", "s1", "dv", "2006-07-08", "10:00:00", "tape A", None, 60.0), ("@media", "7", "photo", "2007-01-01", None, "album", "x.jpg", None)]
    cat = spark.createDataFrame(cat, "tape_id string, scene_id string, kind string, date string, time string, label string, name string, duration double")
    basket = spark.createDataFrame([("default", "A", "s1", 1, 5.0, 10.0), ("default", "@media", "7", 2, 0.0, 0.0), ("default", "B", "gone", 3, 1.0, 2.0)], intervals.BASKET)
    who = spark.createDataFrame([("A", "s1", "Ann", [4]), ("A", "s1", "Bob", [30]), ("@media", "7", "Cid", [0])], "tape_id string, scene_id string, name string, times array<int>")
    what = spark.createDataFrame([("A", "s1", "dog", 10.5, 12.0, 0.2), ("A", "s1", "cat", 20.0, 22.0, 0.2)], archive.TAGS)
    got = {r.id: r for r in sinks.basket_list(basket, cat, who, what).collect()}
    assert (got[1]["od [s]"], got[1]["do [s]"], got[1].osoby, got[1].tagi, got[1].rodzaj) == ("4.0", "11.0", "Ann", "dog", "MiniDV")
    assert got[2].osoby == "Cid" and got[3].missing and not got[1].missing


def _index(spark):
    tapes = [("A", "a", None, None, {"0002_x": "unknown"}, None, 2), ("B", "b", None, "2001-01-01", None, "w2", 1)]
    rec = lambda d, ok: (d, "vaux", ok)
    scenes = [
        ("A", "0001_2004-07-11_17-42-44", 1, 250, rec("2067-02-15T22:26:25", False), ("00:00:00:00", None), ("PAL",), (1, ["x"], 2, 4), None, ((100,),)),
        ("A", "0002_x", 2, 50, rec("2004-07-20T09:00:00", True), None, None, None, None, None),
        ("B", "0001_UNKNOWN-DATE", 1, 10, None, None, None, None, None, None),
        ("B", "0002_y", 2, 10, rec("2006-01-05T08:00:00", True), None, None, None, None, None),
    ]
    return catalog.index_scenes(spark.createDataFrame(tapes, archive.TAPE), spark.createDataFrame(scenes, archive.SCENE), 2026)


def test_index(spark):
    idx = _index(spark)
    got = {(r.tape_id, r.scene_index): r for r in idx.collect()}
    assert {k: r.date for k, r in got.items()} == {("A", 1): "2004-07-11", ("A", 2): None, ("B", 1): "2001-01-01", ("B", 2): "2006-01-05"}
    assert got["A", 1].time == "17:42:44" and got["A", 1].discontinuities == 1 and got["A", 2].read_date == "2004-07-20"
    totals = {r.tape_id: r for r in catalog.tape_totals(idx).collect()}
    assert (totals["A"].total_dv, totals["A"].undated_scenes, totals["B"].undated_scenes, totals["B"].date_max) == (100, 0, 1, "2006-01-05")
    flags = {(r.tape_id, r.scene_index): r.flags for r in catalog.quality_flags(idx, 2026).collect()}
    assert flags["A", 1] == ["dropped", "discontinuity"] and flags["A", 2] == ["clock"] and flags["B", 2] == []


def test_timeline_and_month(spark):
    rows = [("2004-07-11", "a", 1), ("2004-07-20", None, 0), ("2004-09-01", "c", 3), ("2006-01-05", "d", 4), (None, "e", 5)]
    df = spark.createDataFrame(rows, "date string, thumb string, ord int")
    got = [(r.year, r.month, r["count"], r.thumb) for r in timeline.timeline(df).collect()]
    assert got == [(2006, None, 1, "d"), (2006, 1, 1, "d"), (2004, None, 3, "a"), (2004, 9, 1, "c"), (2004, 7, 2, "a")]
    assert timeline.undated(df).first()[0] == 1
    day = [("B", "2004-07-11", "15:00:00", 1), ("A", "2004-07-11", "09:00:00", 1), ("A", "2004-07-11", "20:00:00", 2), ("C", "2004-07-11", None, 1), ("C", "2004-08-11", None, 1)]
    m = spark.createDataFrame([(*d, str(i)) for i, d in enumerate(day)], "tape_id string, date string, time string, scene_index int, scene_id string")
    assert [r.tape_id for r in timeline.month_items(m, 2004, 7).collect()] == ["A", "B", "A", "C"]


def _scenes(spark, rows):
    schema = "key string, tape_id string, scene_id string, scene_index int, frame_count long, error_score int, fingerprint struct<datetime:string,tc_start:string,tc_end:string,frame_count:bigint,frame_hashes:array<string>>"
    return spark.createDataFrame([(f"{t}/{s}", t, s, i, n, e, fp) for i, (t, s, n, e, fp) in enumerate(rows)], schema)


def test_duplicates(spark):
    near = [("A", "1", 100, 5, (None, None, None, 100, ["00000000000000ff", "1111111111111110", ""])), ("B", "1", 100, 0, (None, None, None, 100, ["00000000000000fe", "1111111111111111", ""]))]
    got = duplicates.duplicate_groups(_scenes(spark, near)).orderBy("rank").collect()
    assert [(r.tape_id, r["count"], r.best) for r in got] == [("B", 2, True), ("A", 2, False)]
    no = spark.createDataFrame([("B/1", "A/1")], "scene_a string, scene_b string")
    assert duplicates.duplicate_groups(_scenes(spark, near), no).count() == 0
    one_far = [near[0], ("B", "1", 100, 0, (None, None, None, 100, ["00000000000000fe", "eeeeeeeeeeeeeeee", ""]))]
    assert duplicates.duplicate_groups(_scenes(spark, one_far)).count() == 0
    timed = [("A", "1", 9, None, ("2004-01-01T00:00:00", "00:01", None, 100, None)), ("A", "2", 12, None, ("2004-01-01T00:00:00", "00:01", "x", 500, None)), ("C", "3", 5, None, ("", "00:09", None, 100, [])), ("D", "3", 5, None, ("", "00:09", None, 105, [])), ("E", "3", 5, None, ("", "00:09", None, 111, []))]
    got = duplicates.duplicate_groups(_scenes(spark, timed)).collect()
    assert sorted((r.tape_id, r.scene_id, r["count"]) for r in got) == [("A", "1", 2), ("A", "2", 2), ("C", "3", 2), ("D", "3", 2)]
    assert {r.scene_id for r in got if r.tape_id == "A" and r.best} == {"2"}


def test_hamming_pairs_match_all_pairs(spark):
    rng, rows = random.Random(9), []
    for k in range(60):
        base = [rng.getrandbits(64) for _ in range(3)] if k % 3 == 0 or not rows else [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * (rng.random() < 0.5) for b in last]
        last = base
        rows.append([b if rng.random() < 0.9 else None for b in base])
    want = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[i + 1 :], i + 1):
            both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
            if len(both) >= 2 and all(bin(x ^ y).count("1") <= 5 for x, y in both):
                want.add((i, j))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(i, p, signed(b)) for i, r in enumerate(rows) for p, b in enumerate(r) if b is not None], "key long, position int, bits long")
    assert {tuple(r) for r in duplicates.hamming_pairs(df).collect()} == want and want


MEDIA0 = dict.fromkeys(c.split()[0] for c in archive.MEDIA.split(", "))


def _media(spark, rows):
    full = [{**MEDIA0, "status": "ready", "album": "a", "kind": "photo", "mtime": 0.0, **r} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], archive.MEDIA)


def test_dates_from_neighbours(spark):
    rows = [
        {"id": 1, "name": "DSC07359.JPG", "taken": "2010-05-01T15:01:11", "date_source": "exif"}, {"id": 2, "name": "DSC07363.JPG", "taken": "2010-05-01T16:41:11", "date_source": "exif"},
        {"id": 3, "name": "MOV07362.MPG", "date_source": "none", "kind": "video"}, {"id": 4, "name": "MOV09000.MPG", "date_source": "none"}, {"id": 5, "name": "x.MPG", "date_source": "none"},
        {"id": 6, "name": "clip", "parent_id": 3, "clip_start": 60.0, "date_source": "none"},
    ]
    got = {r.id: (r.taken, r.date_source) for r in dating.date_from_neighbours(_media(spark, rows)).collect()}
    assert got == {3: ("2010-05-01T15:51:11", "neighbors"), 4: (None, "nodate"), 5: (None, "nodate"), 6: ("2010-05-01T15:52:11", "neighbors")}


def test_dates_from_file_times(spark):
    t = 1277370000  # 2010-06-24T09:00:00Z
    iso = lambda s: np.datetime_as_string(np.datetime64(s, "s"))
    good = [{"id": i, "mtime": float(t + 3600 * i), "taken": str(iso(t + 3600 * i)), "date_source": "exif", "album": "good"} for i in range(3)]
    bulk = [{"id": 10 + i, "mtime": float(t + i), "album": "bulk", "added_at": "2020-01-01T00:00:00"} for i in range(4)]
    rows = [*good, {"id": 5, "mtime": float(t), "album": "good", "kind": "video", "added_at": "2020-01-01T00:00:00"}, *bulk]
    got = {r.id: (r.taken, r.date_source) for r in dating.date_from_file_times(_media(spark, rows), "UTC", 2026).collect()}
    assert got[5] == ("2010-06-24T09:00:00", "file") and all(got[10 + i] == (None, "none") for i in range(4))


def test_search(spark):
    cat = spark.createDataFrame(
        [("A", "1", "default", "dv", "2006-07-08", None, "t", None, 1, None, 60.0), ("A", "2", "default", "dv", None, None, "t", None, 2, None, 60.0), ("@media", "3", "default", "photo", "2007-01-01", None, "al", "x", None, 3, None), ("B", "1", "w2", "dv", "2006-07-08", None, "t", None, 1, None, 60.0)],
        "tape_id string, scene_id string, workspace string, kind string, date string, time string, label string, name string, scene_index int, media_id long, duration double",
    )
    frames = [("A", "1", 0.0, 2.0, [1.0, 0.0]), ("A", "1", 2.0, 4.0, [0.99, 0.1]), ("A", "1", 30.0, 32.0, [0.98, 0.1]), ("A", "2", 0.0, 2.0, [0.5, 0.5]), ("B", "1", 0.0, 2.0, [2.0, 0.0])]
    frames = spark.createDataFrame(frames, archive.FRAMES)
    tag = spark.createDataFrame([("A", "1", "dog", 3.0, 5.0, 0.2), ("A", "1", "cat", 0.0, 1.0, 0.2), ("@media", "3", "dog", 0.0, 0.0, 0.3)], archive.TAGS)
    who = spark.createDataFrame([("A", "1", 7, [3, 4, 9]), ("A", "2", 8, [1])], "tape_id string, scene_id string, person_id long, times array<int>")

    def keys(**q):
        return [(r.tape_id, r.scene_id) for r in search.search(cat, frames, tag, who, search.Query(**q)).collect()]

    assert keys() == [] and keys(not_tags=frozenset({"dog"})) == []
    assert keys(vector=(1.0, 0.0)) == [("A", "1")]
    got = search.search(cat, frames, tag, who, search.Query(vector=(1.0, 0.0))).first()
    assert got.moments == [[0.0, 4.0], [30.0, 32.0]] and got.total == 1 and got.score == 1.0 and got.tags == ["cat", "dog"] and got.people == [7]
    assert keys(tags=frozenset({"dog"})) == [("A", "1"), ("@media", "3")] and keys(tags=frozenset({"dog"}), not_tags=frozenset({"cat"})) == [("@media", "3")]
    assert keys(date_from="2007") == [("@media", "3")] and keys(kinds=frozenset({"photo"})) == [("@media", "3")]
    assert keys(with_people=frozenset({7})) == [("A", "1")] and keys(with_people=frozenset({7, 8})) == []
    assert search.search(cat, frames, tag, who, search.Query(with_people=frozenset({7}))).first().moments == [[3.0, 5.0], [9.0, 10.0]]


def test_distill(spark):
    rows = [(i, t, 0.05, s, e) for i, (t, s, e) in enumerate(zip((0.11, 0.11, 0.02, 0.11, 0.11), (0, 0, 0, 1, 2), (0, 0, 0, 0, 1), strict=True))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "i int, score double, rival double, scene int, event int, tag string")
    got = {r.i: r.keep for r in tags.distill(df).collect()}
    assert [got[i] for i in range(5)] == [True, True, False, True, False]


def test_dense_scores_equal_columns(spark):
    rng = np.random.default_rng(2)
    frames = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "i int, emb array<double>")
    prompts = spark.createDataFrame([(t, r, rng.normal(size=6).tolist()) for t in ("x", "y") for r in ("own", "own", "rival")], "tag string, role string, vector array<double>")
    dense = {(r.i, r.tag): (r.score, r.rival) for r in tags.score_tags_dense(frames, prompts, ["i"]).collect()}
    plain = tags.score_tags(frames, prompts, ["i"]).collect()
    assert all(abs(dense[r.i, r.tag][r.role == "rival"] - r.score) < 1e-5 for r in plain) and len(plain) == 160


def test_held_frames(spark):
    rows = [("s", i, ok, [v]) for i, (ok, v) in enumerate([(True, 1.0), (True, 5.0), (True, 50.0), (False, 0.0), (True, 50.0)])]
    df = spark.createDataFrame(rows, "scene string, i int, usable boolean, thumb array<double>")
    assert sorted((r.t, r.t_end) for r in tags.held_frames(df, ["scene"], 2.0).collect()) == [(0, 4), (4, 6), (8, 10)]


def _unit(v):
    return (np.asarray(v) / np.linalg.norm(v)).tolist()


def test_people(spark):
    persons = spark.createDataFrame([(1, "w", "Zoe", False, None, 1, "", 10, None), (2, "w", "ann", False, None, 1, "", 20, None), (3, "w", None, False, None, 1, "", None, None), (4, "w", None, True, None, 1, "", None, None)], archive.PERSONS)
    t = lambda i, p, s, v, f=0.9: (i, p, "w", "A", s, None, 1.0, [i % 3], v, 1.0 + i, f)
    tracks = spark.createDataFrame([t(10, 1, "1", [1.0, 0.0]), t(11, 1, "2", [0.9, 0.1]), t(20, 2, "1", [0.0, 1.0]), t(30, 3, "3", [0.8, 0.2])], archive.TRACKS)
    got = people.person_summary(persons, tracks).collect()
    assert [(r.id, r.tracks, r.scenes, r.cover) for r in got] == [(2, 1, 1, 20), (1, 2, 2, 11), (3, 1, 1, 30), (4, 0, 0, None)]
    none = spark.createDataFrame([], "kind string, a long, b long")
    assert [(r.id, r.suggested) for r in people.suggestions(tracks, persons, none).collect()] == [(3, 1)]
    no = spark.createDataFrame([("diff", 30, 11)], "kind string, a long, b long")
    assert people.suggestions(tracks, persons, no).count() == 0 or people.suggestions(tracks, persons, no).first().suggested == 2
    assert [r.id for r in people.without_tracks(persons, tracks).collect()] == [4]
    moved, kept = people.merge_people(tracks, persons, 1, 3)
    assert moved.where("person_id = 3").count() == 3 and kept.where("id = 3").first().name == "Zoe"
    assert sorted(r.person_id for r in people.dissolve(tracks, 1, 100).collect()) == [2, 3, 100, 101]
    assert [(r.a, r.b) for r in people.differently_named(persons).collect()] == [(10, 20)]


def test_clustering_rules(spark):
    rng = np.random.default_rng(4)
    base = [_unit(rng.normal(size=64)) for _ in range(3)]
    schema = "workspace string, id long, person_id long, tape_id string, scene_id string, times array<int>, arc array<double>, frontal double, rq double"
    face = lambda i, k, noise=0.05, front=0.9, times=(0,), scene=None, person=None, arc=True: ("w", i, person, "t", scene or str(i), list(times), _unit(np.array(base[k]) + noise * rng.normal(size=64)) if arc else None, front, 1.0)

    def groups(tracks, feedback=(), people=()):
        said = spark.createDataFrame([("w", *x) for x in feedback], "workspace string, kind string, a long, b long")
        who = spark.createDataFrame([("w", *x) for x in people], "workspace string, id long, name string, anchor long")
        rows = clustering.cluster_workspaces(spark.createDataFrame(tracks, schema), who, said).collect()
        owner = {r.track: r.person_id for r in rows}
        found = {}
        for r in rows:
            found.setdefault(r.group, set()).add(r.track)
        assert sorted(owner) == sorted(t[1] for t in tracks)
        return sorted(found.values(), key=min), owner

    tracks = [face(i, i % 3) for i in range(12)]
    assert groups(tracks)[0] == [{0, 3, 6, 9}, {1, 4, 7, 10}, {2, 5, 8, 11}]
    assert not any({0, 3} <= g for g in groups(tracks, [("diff", 0, 3), ("diff", 0, 999)])[0])
    assert any({0, 1} <= g for g in groups(tracks, [("same", 0, 1)])[0])
    assert not any({0, 3} <= g for g in groups(tracks, [], [(5, "Ann", 0), (6, "Bob", 3)])[0])
    found, owner = groups([*tracks, face(50, 1, 0.1, 0.1), face(51, 1, arc=False, person=9)], [], [(5, "Ann", 1)])
    assert {1, 4, 7, 10, 50} in found and {51} in found and owner[50] == owner[1] == 5 and owner[51] == 9
    assert len(groups([face(0, 0, scene="s", times=(1, 2)), face(1, 0, scene="s", times=(2, 3))])[0]) == 2
    # confirmed faces come home with their group, or alone if they may be the person; a profile can't be judged
    said = [("confirm", 0, 1), ("confirm", 1, 4), ("confirm", 4, 7)]
    assert {0, 3, 6, 9, 1, 4, 7, 10} in groups(tracks, said, [(5, "Ann", 0)])[0]
    lone = [*tracks[:6], face(60, 2, front=0.1, scene="0", times=(7,))]
    assert any({0, 60} <= g for g in groups(lone, [("confirm", 0, 60)], [(5, "Ann", 0)])[0])
    # a weak anchor gives way to the best frontal track of its person; old people keep their groups
    weak = [face(70, 0, 1.0, 0.1, person=8), face(71, 0, person=8), *(face(80 + i, 1, person=4) for i in range(2))]
    found, owner = groups(weak, [], [(8, "Eve", 70)])
    assert owner[71] == 8 and owner[80] == owner[81] == 4


def test_average_linkage_merges_best_first():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(25, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    groups = [[i] for i in range(25)]
    while True:
        pairs = [(np.mean(sim[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        if not pairs or max(pairs)[0] < 0.2:
            break
        _, i, j = max(pairs)
        groups[i] += groups.pop(j)
    labels = clustering.average_linkage(sim, 0.2)
    got = {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())}
    assert got == {frozenset(g) for g in groups}


def test_tracks_and_assignment(spark):
    v = {k: _unit(np.eye(4)[k] + 0.05) for k in range(3)}
    faces = [("t", "s", i, d, v[d], 1.0 + i) for i in range(4) for d in (0, 1)]
    got = clustering.scene_tracks(spark.createDataFrame(faces, "tape_id string, scene_id string, second int, detection int, embedding array<double>, quality double")).collect()
    assert sorted((r.track, r.times, r.quality) for r in got) == [(0, [0, 1, 2, 3], 4.0), (1, [0, 1, 2, 3], 4.0)]
    df = spark.createDataFrame([("w", i, v[i % 3]) for i in range(9)] + [("x", 100, v[0])], "workspace string, id long, embedding array<double>")
    assert {r.id: r.person for r in clustering.assign_people(df, 0.6).collect()} == {**{i: i % 3 for i in range(9)}, 100: 0}


def _clip_ends(cuts, duration, least=45, most=300):
    """Plain loop."""
    if duration <= most:
        return [duration]
    ends = []
    while duration - (ends[-1] if ends else 0) > most:
        at = ends[-1] if ends else 0
        strong = sorted((-s, t) for t, s in cuts if least <= t - at <= most)
        ends.append(strong[0][1] if strong else at + most)
    return [*(ends if duration - ends[-1] >= least else ends[:-1]), duration]


def test_clips(spark):
    rng = random.Random(2)
    videos = [(0, 600.0, [(30, 0.9), (100, 0.4), (130, 0.8), (290, 0.5), (420, 0.95), (560, 0.6)]), (1, 620.0, []), (2, 100.0, []), (3, None, [(5, 1.0)])]
    videos += [(10 + k, 2000 * rng.random(), [(2000 * rng.random(), rng.choice([0.3, 0.5, rng.random()])) for _ in range(40)]) for k in range(20)]
    got = films.plan_clips(spark.createDataFrame([v[:2] for v in videos], "id long, duration double"), spark.createDataFrame([(v[0], float(t), s) for v in videos for t, s in v[2]], "id long, t double, strength double")).collect()
    for i, d, cuts in videos:
        own = sorted((r.clip_start, r.clip_end) for r in got if r.id == i)
        ends = _clip_ends(cuts, d) if d else []
        assert own == list(zip([0.0, *ends[:-1]], ends, strict=True) if ends else [])
    log = [(1, 0, "frame:0 pts_time:1.5"), (1, 1, "lavfi.scene_score=0.41"), (1, 2, "lavfi.scene_score=0.9"), (1, 3, "pts_time:7"), (1, 4, "pts_time:8"), (1, 5, "lavfi.scene_score=0.5"), (1, 6, "x")]
    assert sorted(map(tuple, films.shot_cuts(spark.createDataFrame(log, "id long, n int, line string")).collect())) == [(1, 1.5, 0.41), (1, 8.0, 0.5)]


def test_films(spark):
    rows = [("p", "t", str(i % 4), f"200{i % 3}-01-01" if i % 13 else None, None, "photo" if i % 2 else "dv", float(5 * i), 5.0, i / 10) for i in range(40)]
    m = spark.createDataFrame(rows, "person string, tape_id string, scene_id string, date string, time string, kind string, start double, length double, score double")
    film = films.pick_films(m, ["person"], 60.0, 3).orderBy("pos").collect()
    assert film == films.pick_films(m.repartition(3), ["person"], 60.0, 3).orderBy("pos").collect() and [r.pos for r in film] == list(range(len(film)))
    for k in range(4):
        starts = sorted(r.start for r in film if r.scene_id == str(k))
        assert len(starts) <= 2 and all(b - a >= 10 for a, b in zip(starts, starts[1:], strict=False))
    assert len({r.date for r in film}) == 4 and [r.date or "9999" for r in film] == sorted(r.date or "9999" for r in film)
    assert sum(r.kind == "photo" for r in film) <= max(2, 0.4 * len(film) + 1)
    # parts give one each before any gives two, the worthiest first; moments of earlier films count less
    ranked = films.in_turn(m, ["person"], 3).toPandas().assign(more=False, moving_later=False)
    order = [ranked.loc[i] for i in films.reel(ranked, 60.0)[0]]
    assert len({r["part"] for r in order[:4]}) == 4 and all(0.7 <= r["worth"] / r["score"] <= 1 for r in order if r["score"])
    used = films.used_moments(m).withColumn("person", F.lit("p"))
    worn = films.in_turn(m, ["person"], 3, used).agg(F.sum("worth")).first()[0]
    assert worn == pytest.approx(0.4 * ranked["worth"].sum())
    short = films.pick_films(m, ["person"], 60.0, 3, first=1).orderBy("pos")
    assert short.collect() == film


def test_trim_equals_removing_the_lowest(spark):
    rng, rows, want = random.Random(6), [], set()
    for film in range(40):
        items = [(film, p, 2.6 + rng.random() * 3, rng.choice([0.1, 0.2, 0.3, rng.random()])) for p in range(rng.randrange(12))]
        rows += items
        left = list(items)
        while left and sum(i[2] for i in left) + 4 - 0.6 * len(left) > 20:
            left.remove(min(left, key=lambda i: i[3]))
        want |= {(i[0], i[1]) for i in left}
    df = spark.createDataFrame(rows, "film int, pos int, d double, score double")
    assert {(r.film, r.pos) for r in films.trim_to_budget(df, ["film"], F.lit(20.0)).collect()} == want


def test_sound(spark):
    rate, t = 11025, np.arange(11025 * 20) / 11025
    clicks = ((t % 0.5) < 0.02) * np.random.default_rng(0).normal(size=len(t))
    period, first = films.beat_grid(clicks.astype(np.float32), rate)
    assert abs(period - 0.5) < 0.01 and min(first % 0.5, 0.5 - first % 0.5) < 0.06
    x = np.full(12800, 1000, np.int16)
    x[320 * 20 : 320 * 21] = 0
    df = spark.createDataFrame([(x.tolist(), 2.0), (x.tolist(), 0.5), ([5] * 900, 2.0)], "x array<int>, t double")
    assert [r[0] for r in df.select(films.quiet_start(F.col("x"), F.col("t"))).collect()] == [pytest.approx(1.2 + 20 * 0.04), pytest.approx(20 * 0.04), 2.0]


def test_state(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "z", False), ("a", 2, "y", False), ("b", 1, "x", False), ("b", 2, None, True)], "k string, version long, v string, deleted boolean")
    assert [tuple(r) for r in state.latest(log, ["k"]).select("k", "v").collect()] == [("a", "z")]
    again = state.upsert(log, spark.createDataFrame([("b", "new")], "k string, v string"), 9)
    assert {r.k: r.v for r in state.latest(again, ["k"]).collect()} == {"a": "z", "b": "new"}
    gone = state.delete(again, spark.createDataFrame([("a",)], "k string"), 10)
    assert [r.k for r in state.latest(gone, ["k"]).collect()] == ["b"]
    old = spark.createDataFrame([("k", "RUNNING", True), ("m", "QUEUED", False)], "key string, status string, cancel boolean")
    new = spark.createDataFrame([("k", "RUNNING", False)], "key string, status string, cancel boolean")
    assert {r.key: r.cancel for r in state.merge_builds(old, new).collect()} == {"k": True, "m": False}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    one = state.change_token(rows, ["id"], "v").first()[0]
    assert one == state.change_token(rows.orderBy(F.desc("id")), ["id"], "v").first()[0] != state.change_token(rows.where("id = 1"), ["id"], "v").first()[0]


def test_files(spark, tmp_path):
    tape = tmp_path / "archive" / "T1"
    tape.mkdir(parents=True)
    (tape / "tape.json").write_text('{"tape_id": "T1", "scene_dates": {"a": "2001-01-01"}}')
    (tape / "0001_x.json").write_text('{"scene_id": "0001_x", "scene_index": 1, "frame_count": 25}')
    (tape / "0002_y.json").write_text("{broken")
    s = archive.scenes(spark, str(tmp_path / "archive")).collect()
    assert [(r.tape_id, r.scene_id) for r in s] == [("T1", "0001_x")] and archive.tapes(spark, str(tmp_path / "archive")).first().scene_dates == {"a": "2001-01-01"}
    media = tmp_path / "media"
    for name, size in (("a/IMG_1.jpg", 3), ("a/.hidden.jpg", 3), ("Screenshots/x.png", 3), ("a/empty.jpg", 0), ("a/note.txt", 3), ("Screenshot 1.png", 3), ("d/VIDEO_TS/VTS_01_1.VOB", 9), ("v/b.MP4", 5)):
        p = media / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    files = archive.listing(spark, str(media))
    now = 4_000_000_000.0
    found = {r.path.rsplit("/", 1)[1]: r.kind for r in archive.media_files(files, [str(media)], now).collect()}
    assert found == {"IMG_1.jpg": "photo", "b.MP4": "video"}
    assert archive.media_files(files, [str(media)]).count() == 0  # all fresh
    sums = archive.checksums(archive.listing(spark, str(media), content=True)).where("name = 'b.MP4'").first().sha256
    lines = spark.createDataFrame([("b.MP4", "0"), ("old", "1")], "name string, sha256 string")
    fresh = spark.createDataFrame([("b.MP4", sums)], "name string, sha256 string")
    assert {r.name: r.sha256 for r in archive.refresh_checksums(lines, fresh).collect()} == {"b.MP4": sums, "old": "1"}
    assert archive.folder_signature(archive.listing(spark, str(tape))).first().signature.count(";") == 2


def test_system_text(spark):
    mem = spark.createDataFrame([("MemTotal:  100 kB",), ("MemFree: 20 kB",), ("MemAvailable: 60 kB",), ("SwapTotal: 10 kB",), ("SwapFree: 4 kB",)], "value string")
    r = archive.memory_info(mem).first()
    assert (r.total, r.used, r.buff_cache, r.swap_used) == (102400, 40960, 40960, 6144)
    cpu = spark.createDataFrame([(1, "cpu  0 0 0 0 0 0 0 0"), (2, "cpu  10 10 20 50 10 0 0 0")], "at int, value string")
    r = archive.cpu_shares(cpu).first()
    assert (r.user, r.system, r.iowait, r.idle) == (20.0, 20.0, 10.0, 50.0)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "tags")
    sinks.replace_partitions(spark.createDataFrame([("A", 1), ("B", 1)], "tape_id string, n int"), path, ["tape_id"])
    sinks.replace_partitions(spark.createDataFrame([("B", 2)], "tape_id string, n int"), path, ["tape_id"])
    assert {r.tape_id: r.n for r in spark.read.parquet(path).collect()} == {"A": 1, "B": 2}
    gone = sinks.save_faces(spark.createDataFrame([(1, "A")], "person_id long, tape_id string"), spark.createDataFrame([(2,)], "id long"), str(tmp_path / "f"))
    assert gone is False
    sinks.write_list(spark.createDataFrame([("a;b", 1)], "plik string, x int"), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.startswith("﻿plik;x") and '"a;b";1' in text


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    def rows(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return df.sparkSession.sql(f"select * from {name}").collect()

    base = datetime(2020, 1, 1)
    sig = [("T", base + timedelta(seconds=s), s % 2 == 0) for s in (0, 10, 20, 100, 110)] + [("T", base + timedelta(days=1), False)]
    spark.createDataFrame(sig, "tape_id string, ts timestamp, blank boolean").repartition(1).write.parquet(str(tmp_path / "sig"))
    s = spark.readStream.schema("tape_id string, ts timestamp, blank boolean").parquet(str(tmp_path / "sig"))
    got = rows(jobs.capture_sessions(s), "append", "sessions")
    assert sorted((r.frames, r.blank) for r in got) == [(2, 2), (3, 3)]
    v = {k: np.eye(4)[k].tolist() for k in range(3)}
    spark.createDataFrame([("w", i, v[i % 3]) for i in range(9)], "workspace string, id long, embedding array<double>").write.parquet(str(tmp_path / "tr"))
    s = captures.stateful(spark).readStream.schema("workspace string, id long, embedding array<double>").parquet(str(tmp_path / "tr"))
    got = {r.id: r.person for r in rows(jobs.assign_stream(s, 0.5), "append", "assigned")}
    assert len(set(got.values())) == 3 and all(got[i] == got[i + 3] for i in range(6))
    fr = [("s", i, ok, [x], i == 4) for i, (ok, x) in enumerate([(True, 1.0), (True, 5.0), (True, 50.0), (False, 0.0), (True, 50.0)])]
    spark.createDataFrame(fr, "scene string, i int, usable boolean, thumb array<double>, last boolean").repartition(1).write.parquet(str(tmp_path / "fr"))
    s = spark.readStream.schema("scene string, i int, usable boolean, thumb array<double>, last boolean").parquet(str(tmp_path / "fr"))
    assert sorted((r.t, r.t_end) for r in rows(jobs.hold_frames(s), "append", "held")) == [(0, 4), (4, 6), (8, 10)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"tape_id": "A"}')
    seen = []
    for name in ("b", "c"):
        (tmp_path / "docs" / f"{name}.json").write_text(f'{{"tape_id": "{name}"}}')
        q = jobs.refresh(jobs.watch(spark, str(tmp_path / "docs"), "tape_id string"), lambda df, _: seen.append(sorted(r.tape_id for r in df.collect())), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert seen == [["A", "b"], ["c"]]


def test_frames(spark):
    from reelgrid.operators import frames

    f = spark.createDataFrame([("s", 0, 0, 10.0), ("s", 0, 1, 50.0), ("s", 0, 2, 90.0), ("s", 1, 25, 41.0)], "scene string, second int, i int, sharpness double")
    assert sorted((r.second, r.i) for r in frames.sharp_frames(f, ["scene"]).collect()) == [(0, 1), (1, 25)]
    s = spark.createDataFrame([("s", [1, 1])], "scene string, times array<int>")
    assert sorted(r.frame for r in frames.frame_numbers(s, ["scene"], F.lit(5.0), 2).collect()) == [6, 8]
    d = spark.createDataFrame([(1, "t", "s", 5, [1.0, 0.0]), (2, "t", "s", 9, [1.0, 0.0])], "detection int, tape_id string, scene_id string, second int, embedding array<double>")
    t = spark.createDataFrame([(7, "t", "s", [4], [0.9, 0.1]), (8, "t", "s", [5], [0.5, 0.5])], "track int, tape_id string, scene_id string, times array<int>, embedding array<double>")
    assert [(r.detection, r.track) for r in frames.nearest_track(d, t).collect()] == [(1, 7)]


def test_media_edits(spark):
    m = _media(spark, [{"id": 1, "album": "a"}, {"id": 2, "album": "a", "taken": "2001-01-01"}, {"id": 3, "parent_id": 1, "album": "a"}, {"id": 4, "album": "b"}])
    assert {r.id: r.date_fix for r in state.set_album_date(m, "a", "1999").collect()} == {1: "1999", 2: None, 3: "1999", 4: None}
    marker = spark.createDataFrame([("old", "1")], "k string, v string")
    assert state.import_once(m, marker, "old").count() == 0 and state.import_once(m, marker, "new").count() == 4
    assert [r.name for r in state.workspaces(spark.createDataFrame([("zoe",), ("ann",)], "name string")).collect()] == ["default", "ann", "zoe"]
