"""Linkage in rounds over tables against the matrix form, with many blocks and rules."""

from __future__ import annotations

import numpy as np
import pytest

from reelgrid.operators import clustering
from reelgrid.operators.linkage import linkage


def _data(n: int, seed: int):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 12)) * 0.9
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = rng.integers(1, 4, n)
    apart = [(int(a), int(b)) for a, b in rng.integers(0, n, (n, 2))]
    return x, size, apart


@pytest.mark.parametrize(("block", "seed"), [(16, 1)])
def test_rounds_give_the_clusters_of_the_matrix(spark, block, seed):
    n = 60
    x, size, apart = _data(n, seed)
    want = {}
    for w in ("u", "v"):  # v: the same vectors without rules
        labels = clustering.average_linkage(x @ x.T, 0.35, size, [p for p in apart if p[0] != p[1]] if w == "u" else [])
        want |= {(w, i + 1000 * (w == "v")): frozenset(np.flatnonzero(labels == labels[i]) + 1000 * (w == "v")) for i in range(n)}
    rows = [(w, i + 1000 * (w == "v"), int(size[i]), (x[i] * size[i]).tolist()) for w in ("u", "v") for i in range(n)]
    units = spark.createDataFrame(rows, "workspace string, id long, n long, total array<double>").repartition(3)
    bars = spark.createDataFrame([("u", a, b) for a, b in apart] + [("u", 5, 99999)], "workspace string, a long, b long")
    got = linkage(units, bars, 0.35, block).collect()
    assert len(got) == 2 * n and 3 < len({r.cluster for r in got}) < n
    groups = {}
    for r in got:
        groups.setdefault((r.workspace, r.cluster), set()).add(r.id)
    assert all(min(g) == c for (_, c), g in groups.items())
    assert {(r.workspace, r.id): frozenset(groups[r.workspace, r.cluster]) for r in got} == want


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], "workspace string, id long, n long, total array<double>")
    bars = spark.createDataFrame([], "workspace string, a long, b long")
    assert linkage(none, bars, 0.5).count() == 0
    one = spark.createDataFrame([("w", 4, 1, [1.0, 0.0]), ("w", 5, 1, [0.0, 1.0])], none.schema)
    assert sorted(map(tuple, linkage(one, bars, 0.5).collect())) == [("w", 4, 4), ("w", 5, 5)]


def test_large_workspaces_are_grouped_like_small_ones(spark):
    x, _, apart = _data(50, 3)
    rng = np.random.default_rng(9)
    rows = [("w", i, i % 5 if i % 9 == 0 else None, "t", str(i // 6), [i % 4], x[i].tolist() if i % 17 else None, float(rng.random()), 1.0) for i in range(50)]
    tracks = spark.createDataFrame(rows, "workspace string, id long, person_id long, tape_id string, scene_id string, times array<int>, arc array<double>, frontal double, rq double")
    people = spark.createDataFrame([("w", 1, "Ann", 2), ("w", 2, "Bob", 30), ("w", 3, None, 40)], "workspace string, id long, name string, anchor long")
    said = [("w", "diff", a, b) for a, b in apart[:30]] + [("w", "same", 3, 4), ("w", "same", 40, 31), ("w", "confirm", 2, 9), ("w", "confirm", 9, 11)]
    feedback = spark.createDataFrame(said, "workspace string, kind string, a long, b long")

    def groups(**how) -> set:
        found = {}
        for r in clustering.cluster_workspaces(tracks, people, feedback, core_frontal=0.4, cluster=0.35, attach=0.3, **how).collect():
            found.setdefault(r.group, set()).add((r.track, r.person_id))
        return {frozenset(g) for g in found.values()}

    one, other = groups(), groups(matrix=10)
    assert one == other and len(one) > 5


def test_equal_vectors_take_few_rounds(spark, monkeypatch):
    """Copies are all equally near: they pair off, instead of each looking at the one with the smallest id."""
    from reelgrid.operators import linkage as module

    asked, nearest = [], module.nearest
    monkeypatch.setattr(module, "nearest", lambda *a: asked.append(1) or nearest(*a))
    rows = [("w", i, 1, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(48)]
    units = spark.createDataFrame(rows, "workspace string, id long, n long, total array<double>")
    got = linkage(units, spark.createDataFrame([], "workspace string, a long, b long"), 0.5, 16).collect()
    assert {(r.id, r.cluster) for r in got} == {(i, i % 2) for i in range(48)}
    assert len(asked) <= 14


@pytest.mark.parametrize("block", [16, 200])
def test_shared_cells_keep_units_apart(spark, block):
    """Cells bar the same merges as a row for each pair of units does."""
    n = 60
    x, size, _ = _data(n, 4)
    cells = [[i % 7, 100 + i % 11] if i % 3 else [] for i in range(n)]
    apart = [(i, j) for i in range(n) for j in range(i) if set(cells[i]) & set(cells[j])]
    labels = clustering.average_linkage(x @ x.T, 0.3, size, apart)
    want = {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())}
    rows = [("w", i, int(size[i]), (x[i] * size[i]).tolist(), cells[i]) for i in range(n)]
    units = spark.createDataFrame(rows, "workspace string, id long, n long, total array<double>, cells array<long>").repartition(3)
    groups = {}
    for r in linkage(units, spark.createDataFrame([], "workspace string, a long, b long"), 0.3, block).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == want
