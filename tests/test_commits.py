"""Commits of several writers: one of two is refused, nothing is lost, no job is held twice."""

from __future__ import annotations

import threading

import pytest

from reelgrid.operators.commits import CommitLog, Conflict, apply_if_unedited, claim, enqueue, finish, jobs_table, renew, replace_scene


def _table(spark, path, most=20) -> CommitLog:
    return CommitLog(spark, str(path), "id long, scene string, person_id long", ["id"], most)


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "id long, scene string, person_id long")


def _all(table) -> list:
    return sorted(map(tuple, table.rows().collect()))


def test_one_of_two_writers_is_refused(spark, tmp_path):
    t = _table(spark, tmp_path)
    base = t.snapshot()
    first = t.commit(base, _rows(spark, (1, "a", 7)))
    with pytest.raises(Conflict):
        t.commit(base, _rows(spark, (1, "b", 8)))
    assert _all(t) == [(1, "a", 7)] and t.snapshot() == first
    t.change(lambda rows, at: _rows(spark, (2, "b", 8)))
    assert _all(t) == [(1, "a", 7), (2, "b", 8)] and sorted(map(tuple, t.rows(first).collect())) == [(1, "a", 7)]


def test_a_writer_that_lost_sees_the_other(spark, tmp_path):
    t, tries = _table(spark, tmp_path), []

    def make(rows, at):
        tries.append(at.version)
        if len(tries) == 1:
            t.commit(at, _rows(spark, (1, "a", 1)))
        return rows.selectExpr("id", "scene", "person_id + 10 AS person_id") if rows.count() else _rows(spark, (9, "z", 9))

    t.change(make)
    assert tries == [0, 1] and _all(t) == [(1, "a", 11)]


def test_reassignment_is_refused_after_an_edit(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.commit(t.snapshot(), _rows(spark, (1, "a", 1), (2, "a", 1)))
    seen = t.snapshot().marks.get("people", 0)
    assert apply_if_unedited(t, "people", seen, _rows(spark, (1, "a", 2)))
    t.change(lambda rows, at: _rows(spark, (2, "a", 5)), bump="people")
    assert not apply_if_unedited(t, "people", seen, _rows(spark, (2, "a", 3)))
    assert _all(t) == [(1, "a", 2), (2, "a", 5)]


def test_a_scene_is_replaced_whole_or_not(spark, tmp_path):
    t, people = _table(spark, tmp_path, most=2), spark.createDataFrame([(1,), (2,)], "id long")
    assert replace_scene(t, {"scene": "a"}, _rows(spark, (1, "a", 1), (2, "a", None)), lambda: people)
    assert replace_scene(t, {"scene": "b"}, _rows(spark, (5, "b", 2)), lambda: people)
    assert replace_scene(t, {"scene": "a"}, _rows(spark, (2, "a", 2), (3, "a", 1)), lambda: people)
    assert not replace_scene(t, {"scene": "b"}, _rows(spark, (6, "b", 99)), lambda: people)
    assert _all(t) == [(2, "a", 2), (3, "a", 1), (5, "b", 2)] and len(t.snapshot().folders) <= 2


def test_workers_never_hold_one_job(spark, tmp_path):
    t = jobs_table(spark, str(tmp_path))
    for i in range(5):
        assert enqueue(t, f"j{i}", "build", now=100 + i)
    assert not enqueue(t, "j3", "build", now=200)
    got: dict[str, list] = {"x": [], "y": [], "z": []}

    def work(name: str) -> None:
        own = jobs_table(spark, str(tmp_path))
        while (key := claim(own, "build", name, now=1000, lease=60)) is not None:
            got[name].append(key)

    threads = [threading.Thread(target=work, args=(n,)) for n in got]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    assert sorted(sum(got.values(), [])) == [f"j{i}" for i in range(5)]


def test_leases_run_out(spark, tmp_path):
    t = jobs_table(spark, str(tmp_path))
    assert enqueue(t, "scan-1", "faces", 1, singleton=True) and not enqueue(t, "scan-2", "faces", 2, singleton=True)
    assert claim(t, "faces", "a", now=10, lease=5) == "scan-1" and claim(t, "faces", "b", now=12, lease=5) is None
    assert renew(t, "scan-1", "a", now=14, lease=5) and claim(t, "faces", "b", now=18, lease=5) is None
    assert claim(t, "faces", "b", now=19, lease=5) == "scan-1"
    assert not finish(t, "scan-1", "a") and not renew(t, "scan-1", "a", now=20, lease=5) and finish(t, "scan-1", "b")
    assert enqueue(t, "scan-2", "faces", 30, singleton=True)
