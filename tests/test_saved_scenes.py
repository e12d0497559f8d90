"""Scene by scene writes."""

from __future__ import annotations

import pytest

from reelgrid.operators import clustering, people
from reelgrid.plans.queries import QUERIES
from reelgrid.sources import sinks


def test_other_scenes_of_the_tape_stay(spark, tmp_path):
    persons = spark.createDataFrame([(1,), (2,)], "id long")
    path = str(tmp_path / "faces")
    rows = lambda *r: spark.createDataFrame(r, "tape_id string, scene_id string, person_id long, id long")

    def stored():
        return sorted((r.tape_id, r.scene_id, r.id) for r in spark.read.parquet(path).collect())

    assert sinks.save_faces(rows(("t", "s1", 1, 1), ("t", "s2", 2, 2), ("u", "s1", 1, 3)), persons, path)
    assert sinks.save_faces(rows(("t", "s1", 1, 10), ("t", "s1", None, 11)), persons, path)
    assert stored() == [("t", "s1", 10), ("t", "s1", 11), ("t", "s2", 2), ("u", "s1", 3)]
    assert not sinks.save_faces(rows(("t", "s2", 9, 12)), persons, path) and len(stored()) == 4
    gone = spark.createDataFrame([("t", "s1"), ("u", "s1")], "tape_id string, scene_id string")
    assert sinks.save_faces(rows(("t", "s3", 2, 20)), persons, path, gone.unionByName(rows(("t", "s3", 2, 20)).select("tape_id", "scene_id")))
    assert stored() == [("t", "s2", 2), ("t", "s3", 20)]


def test_a_track_moved_to_a_new_person(spark):
    persons = spark.createDataFrame([(1, "w", None), (2, "v", None)], "id long, workspace string, anchor long")
    tracks = spark.createDataFrame([(10, 1, "w", 0.5, 1.0), (11, 1, "w", 0.9, 1.0), (20, 2, "v", None, 1.0)], "id long, person_id long, workspace string, rq double, quality double")
    moves = spark.createDataFrame([(11, None), (20, 1)], "track long, target long")
    moved, said = people.move_tracks(tracks, persons, moves)
    assert {r.id: r.person_id for r in moved.collect()} == {10: 1, 11: 3, 20: 2}  # 20 is of another workspace
    assert [tuple(r) for r in said.collect()] == [("diff", 11, 10)]


@pytest.mark.parametrize("name", ["planned_clips", "index_work", "moved_tracks", "streamed_hours"])
def test_queries_of_empty_tables(spark, tmp_path, name):
    from tests.test_queries import DIR

    for t in ("events", "orders", "customer"):
        spark.read.parquet(f"{DIR}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    from reelgrid.plans import records  # noqa: F401

    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_detections_meet_tracks_one_to_one():
    import numpy as np

    assert clustering.match_detections(np.array([[0.9, 0.8], [0.85, 0.1]]), 0.2) == [(0, 0)]
