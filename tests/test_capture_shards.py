"""Tapes share states, so that calls of the state store do not grow with them; far dates are kept."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from reelgrid.streaming import captures

SCHEMA = "tape_id string, ts timestamp, blank boolean"


class _Store:
    """Counts the calls of value and list states and timers."""

    def __init__(self):
        self.calls, self.states = 0, {}

    def state(self, name, _schema):
        call = lambda f: lambda *a: (setattr(self, "calls", self.calls + 1), f(*a))[1]
        get, put = call(lambda: self.states.get(name)), call(lambda x: self.states.update({name: x}))
        return SimpleNamespace(get=get, update=put, put=put, clear=call(lambda: self.states.pop(name, None)), appendValue=call(lambda x: self.states.setdefault(name, []).append(x)))

    getValueState = getListState = state

    def registerTimer(self, ms):
        self.calls += 1
        self.timer = ms

    deleteTimer = registerTimer


def test_calls_of_a_shard_do_not_grow_with_its_tapes():
    calls = {}
    for tapes in (2, 300):
        store, capture = _Store(), captures.Capture(captures.EndRules())
        capture.init(store)
        rows = pd.DataFrame([(f"t{i % tapes}", 1000 * i, False) for i in range(600)], columns=["tape_id", "ms", "blank"])
        list(capture.handleInputRows((0,), iter([rows]), None))
        for now in (300_000, 10**7):
            at = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
            out = list( capture.handleExpiredTimer((0,), at, SimpleNamespace(getExpiryTimeInMs=lambda store=store: store.timer)))
        assert pd.concat(out)["tape_id"].nunique() == tapes and not {"running", "waiting"} & store.states.keys()
        calls[tapes] = store.calls
    assert calls[2] == calls[300]


def test_far_dates_and_nulls(spark, tmp_path):
    own = captures.stateful(spark)
    rows = "('a', timestamp'2024-01-01 00:00:00', null), ('a', timestamp'2024-01-01 00:00:10', true), ('b', timestamp'2500-01-01 00:00:00', false), ('~', timestamp'9000-01-01 00:00:00', false)"
    own.sql(f"SELECT * FROM VALUES {rows} AS t(tape_id, ts, blank)").write.parquet(f"{tmp_path}/in")
    stream = captures.captures(own.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), shards=3)
    captures.drained(stream, str(tmp_path))
    got = spark.read.schema(captures.ENDED).parquet(f"{tmp_path}/out").selectExpr("tape_id", "cast(start as string)", "unix_seconds(`end`) - unix_seconds(start)", "frames", "blank", "reason").collect()
    assert sorted(map(tuple, got)) == [("a", "2024-01-01 00:00:00", 55, 2, 1, "no signal"), ("b", "2500-01-01 00:00:00", 45, 1, 0, "no signal"), ("~", "9000-01-01 00:00:00", 45, 1, 0, "no signal")]
