"""The change applier against a plain loop, with ranges so small that clients have many."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from reelgrid.llm import change_applier
from tests.llm.plain_changes import plain

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double, range int, status string"


def _rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = rng.choice((7, 7, 7, 1, 2, 3, None, *range(10, 30)))
        seq = rng.choice((i // 4, i // 4 + rng.randrange(40), 5, None if i % 40 == 0 else i))
        at = None if rng.random() < 0.02 else datetime(2024, 1, 1) + timedelta(days=i * 130 / n + rng.choice((0, 0, 0, 3, 30)), hours=rng.randrange(24))
        balance = rng.choice((None, round(rng.uniform(-50, 900), 3), 0.125))
        rows.append((i if i % 50 else None, client, seq, rng.choice("IUUUD") if i % 30 else rng.choice((None, "X")), at, rng.choice((None, "Ror", "Bel")), balance, i % 3, "s"))
    rows += [(n, 2, 3, "U", datetime(2023, 11, 1), "early", 1.0, 1, "s"), (n + 1, 4, 9, "I", datetime(2024, 9, 1), "late", 2.5, 1, "s")]
    rows.append((*rows[9][:7], 99, "t"))  # equal but for other columns
    return rows + rows[20:60]


@pytest.mark.parametrize(("size", "seed"), [(4, 1)])
def test_against_a_plain_loop(spark, size, seed, monkeypatch):
    monkeypatch.setattr(change_applier, "SHARD", 200)
    rows = _rows(900, seed)
    got = change_applier.apply_changes(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size)
    assert got.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_empty(spark):
    assert change_applier.apply_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_are_merged():
    merge = change_applier._Merge({1: [(1, 5, 0), (4, 6, 0)], 2: [(2, 3, 0)], 3: [(7, 1, 0)]})
    assert [r[0] for r in merge.drain(1, -1, True)] == [1, 2]
    assert [r[0] for r in merge.drain(3, -1, True)] == []
    merge.add(4, [(3, 9, 0), (5, 9, 0)])
    assert [r[0] for r in merge.drain(3, -1, False)] == []
    assert [r[0] for r in merge.drain(3, -1, True)] == [3, 4, 5]
    assert merge.rest(3) == [(7, 1, 0)] and [r[0] for r in merge.drain(6, 7, False)] == [7] and not merge.heap
