"""Queries that SQL can't say, on whole tables, against plain loops written from what they promise."""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import films
from reelgrid.plans import records  # noqa: F401  registers more queries
from reelgrid.plans.queries import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


def _vectors(spark):
    return sorted((r.vec_id, str(r.label), np.asarray(r.embedding, float)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect() if r.embedding is not None)


def test_basket_moments(spark):
    held = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{DIR}/events.parquet").collect(), key=lambda r: r.event_id):
        start = float((r.ts - type(r.ts)(1970, 1, 1)).total_seconds() // 1 % 3600)
        moments = held[str(r.user_id), r.event_type]
        for m in moments:
            if start <= m[2] and start + r.value >= m[1]:
                m[1:] = [min(m[1], start), max(m[2], start + r.value)]
                break
        else:
            moments.append([r.event_id, start, start + r.value])
    want = sorted((*k, *m) for k, ms in held.items() for m in ms)
    got = sorted((r.tape_id, r.scene_id, r.id, r.start, r.end) for r in QUERIES["basket_moments"](spark, DIR).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_assigned_people(spark):
    centres, want = defaultdict(list), {}
    for i, label, v in _vectors(spark):
        own = centres[label]
        sims = [float(c @ v) for c, _ in own]
        best = max(range(len(sims)), key=lambda k: (sims[k], -k)) if sims else None
        if best is not None and sims[best] >= 0.25:
            c, n = own[best]
            moved = c * n + v
            own[best] = (moved / np.linalg.norm(moved), n + 1)
            want[i] = best
        else:
            want[i] = len(own)
            own.append((v, 1))
    assert {r.id: r.person for r in QUERIES["assigned_people"](spark, DIR).collect()} == want


def test_scene_tracks(spark):
    scenes, want = defaultdict(list), []
    for i, label, v in _vectors(spark):
        tracks, second = scenes[label], i // 2
        sims = [float(t["mean"] @ v) for t in tracks]
        best = int(np.argmax(sims)) if sims else -1
        if best < 0 or sims[best] < 0.3:
            tracks.append({"mean": v, "sum": v.copy(), "times": [second]})
        else:
            t = tracks[best]
            t["sum"] = t["sum"] + v
            t["mean"] = t["sum"] / np.linalg.norm(t["sum"])
            t["times"] += [second] if t["times"][-1] != second else []
    want = sorted((label, k, t["times"]) for label, ts in scenes.items() for k, t in enumerate(ts))
    assert sorted((r.scene_id, r.track, r.times) for r in QUERIES["scene_tracks"](spark, DIR).collect()) == want


def test_film_picks(spark):
    """Piece by piece: the part that gave fewest, of these the one whose next is worthiest."""
    e = spark.read.parquet(f"{DIR}/events.parquet")
    m = e.select(F.col("user_id").alias("person"), F.lit("t").alias("tape_id"), (F.col("event_id") % 40).cast("string").alias("scene_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.when(F.col("event_id") % 3 == 0, "photo").otherwise("video").alias("kind"), (F.col("event_id") % 97).cast("double").alias("start"), F.lit(4.0).alias("length"), (F.col("value") / 100).alias("score"))
    people = defaultdict(list)
    for r in films.in_turn(m, ["person"], 7).collect():
        people[r.person].append(r)
    want = []
    for person, rows in people.items():
        rows.sort(key=lambda r: (-r.worth, r.tape_id, r.scene_id, r.start))
        left, given, film, seconds = list(rows), defaultdict(int), [], 0.0
        while left and seconds < 50:
            first = {r.part: r for r in reversed(left)}
            r = min(first.values(), key=lambda r: (given[r.part], -r.worth))
            left.remove(r)
            mates = [x.start for x in film if x.scene_id == r.scene_id]
            photos = sum(x.kind == "photo" for x in film)
            if len(mates) >= 2 or any(abs(s - r.start) < 10 for s in mates) or (r.kind == "photo" and photos >= max(2, 0.4 * (len(film) + 1))):
                continue
            film.append(r)
            given[r.part] += 1
            seconds += 4.0 - 0.6
        film.sort(key=lambda r: (r.date, r.time, r.scene_id, r.start))
        want += [(person, r.scene_id, r.start, k) for k, r in enumerate(film)]
    assert sorted((r.person, r.scene_id, r.start, r.pos) for r in QUERIES["film_picks"](spark, DIR).collect()) == sorted(want)


def test_clustered_tracks(spark):
    """The rules hold in every group; frontal tracks without rules are merged best pair first."""
    rows = QUERIES["clustered_tracks"](spark, DIR).collect()
    vectors = {i: (label, v) for i, label, v in _vectors(spark)}
    group = {r.track: (r.workspace, r.group) for r in rows}
    assert sorted(group) == sorted(vectors) and all(vectors[t][0] == g[0] for t, g in group.items())
    for a in vectors:
        b = a + 10
        if a % 10 == 0 and b in vectors and vectors[a][0] == vectors[b][0]:
            assert group[a] == group[b]
    # alike in neither scene nor second
    seen = defaultdict(list)
    for i, (label, _) in vectors.items():
        seen[label, i % 50, i % 7].append(i)
    glued = {(a, a + 10) for a in vectors}
    for same in seen.values():
        for x in same:
            assert not any(group[x] == group[y] and (x, y) not in glued and (x % 10 or y % 10) for y in same if x < y)
    named = [i for i in range(20) if i in vectors]
    assert all(group[a] != group[b] or a % 10 == b % 10 == 0 for a in named for b in named if a < b and vectors[a][0] == vectors[b][0])
