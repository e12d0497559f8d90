"""Ends of captures against a plain loop, with rows that come in several batches and out of order."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from reelgrid.plans import records  # noqa: F401  registers more queries
from reelgrid.plans.queries import QUERIES
from reelgrid.streaming import captures

DIR = "/root/testdata/sf0.001"
BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "tape_id string, ts timestamp, blank boolean"


def _plain(rows, rules: captures.EndRules) -> list:
    out, run = [], {}

    def over(tape, at):
        start, last, content, n, blanks = run[tape]
        for reason, end in (("longest", start + rules.longest), ("no signal", last + rules.no_signal), ("blank", content + rules.blank_tail), ("idle", last + rules.idle)):
            if at > end and end == min(start + rules.longest, last + rules.no_signal, content + rules.blank_tail, last + rules.idle):
                out.append((tape, start, end, n, blanks, reason))
                del run[tape]
                return

    for tape, at, blank in sorted(rows):
        if tape in run:
            over(tape, at)
        start, _, content, n, blanks = run.get(tape, (at, at, at, 0, 0))
        run[tape] = (start, at, content if blank else at, n + 1, blanks + blank)
    for tape in list(run):
        over(tape, 10**9)
    return sorted(out)


@pytest.mark.parametrize("rules", [captures.EndRules(longest=400), captures.EndRules(no_signal=1000, blank_tail=150, idle=90)])
def test_all_rules(spark, tmp_path, rules):
    rng, rows = random.Random(5), []
    for tape in "abc":
        at = 0
        for _ in range(60):
            at += rng.choice((1, 5, 20, 44, 45, 46, 90, 91, 200))
            rows.append((tape, at, rng.random() < 0.7))
    own = captures.stateful(spark)
    (tmp_path / "in").mkdir()
    frame = lambda rs: own.createDataFrame([(t, BASE + timedelta(seconds=a), b) for t, a, b in rs], SCHEMA)
    stream = captures.captures(own.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "100000 seconds", rules)
    edge = sorted(a for _, a, _ in rows)[len(rows) // 2]
    early, later = [r for r in rows if r[1] <= edge], [r for r in rows if r[1] > edge]
    moved = later[:10]  # early rows of the second half come first, some of the first half late
    for part in (early[8:] + moved, early[:8] + later[10:], [("~", 10**8, False)]):
        frame(part).write.mode("append").parquet(f"{tmp_path}/in")
        query = captures.drained(stream, str(tmp_path))
    got = spark.read.schema(captures.ENDED).parquet(f"{tmp_path}/out").selectExpr("tape_id", "unix_seconds(start) - 1704067200", "unix_seconds(`end`) - 1704067200", "frames", "blank", "reason").collect()
    assert sorted(map(tuple, got)) == _plain(rows, rules) and {r.reason for r in got} >= {"blank"}
    frame([("a", 5, False), ("b", 6, False)]).write.mode("append").parquet(f"{tmp_path}/in")
    assert captures.late_rows(captures.drained(stream, str(tmp_path))) == 2 and query is not None


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_streamed_people_are_those_of_the_loop(spark):
    got, want = (sorted(map(tuple, QUERIES[name](spark, DIR).select("workspace", "id", "person").collect())) for name in ("streamed_people", "assigned_people"))
    assert got == want and got
