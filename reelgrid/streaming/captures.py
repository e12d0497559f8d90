"""Where a capture ends: a stateful stream with a timer for each rule."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


@dataclass(frozen=True)
class EndRules:
    """Seconds after which a capture is over. The values are fixed, as archives were captured with them."""

    no_signal: int = 45
    blank_tail: int = 120
    idle: int = 300
    longest: int = 9000


ENDED = "tape_id string, start timestamp, end timestamp, frames long, blank long, reason string"
_OUTPUT = "tape_id string, start long, end long, frames long, blank long, reason string"
# times in pandas end in 2262: the watermark's column is kept within them, and what comes after 2200 waits for that year only
_FIRST, _FAR, _LAST = -8_520_336_000, 7_258_118_400, 9_214_646_400
_COLUMNS = [c.split()[0] for c in ENDED.split(", ")]


def deadline(start: int, last: int, content: int, rules: EndRules) -> tuple[int, str]:
    """When a capture ends if nothing more comes, and why: ms. Of rules that end it at once the first named counts."""
    ends = ((start + rules.longest * 1000, "longest"), (last + rules.no_signal * 1000, "no signal"), (content + rules.blank_tail * 1000, "blank"), (last + rules.idle * 1000, "idle"))
    return min(ends, key=lambda e: e[0])


class Capture(StatefulProcessor):
    """Signal of one shard of tapes, in order of time whatever order it comes in: rows wait until the watermark has passed
    them.

    A call of the state store costs far more than a row, so one serves all tapes of a shard. The state is the captures
    that run, as five numbers each, and a list of what waits, a packed entry a batch; one timer stands for the next moment
    at which a row of any tape is due or a capture ends.
    """

    def __init__(self, rules: EndRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "tapes binary")
        self.wake = handle.getValueState("wake", "at long")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([f[["tape_id", "ms", "blank"]] for f in rows], ignore_index=True)
        self.waiting.appendValue((pickle.dumps(new),))
        self._wake_by(min(int(new["ms"].min()), _FAR * 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.wake.get()
        if not at or at[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.wake.clear()
        now, packed, stored = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get()), self.running.get()
        rows = pd.concat([pickle.loads(x[0]) for x in packed], ignore_index=True) if packed else pd.DataFrame({"tape_id": [], "ms": [], "blank": []})
        running = pickle.loads(stored[0]) if stored else {}
        is_due, ended = rows["ms"].clip(upper=_FAR * 1000) <= now, []
        due, rest = rows[is_due].sort_values(["tape_id", "ms", "blank"]), rows[~is_due]
        for tape, ms, blank in zip(*(due[c].tolist() for c in ("tape_id", "ms", "blank")), strict=True):
            run = running.get(tape)
            if run and ms > deadline(*run[:3], self.rules)[0]:
                ended.append((tape, run))
                run = None
            start, _, content, frames, blanks = run or (ms, ms, ms, 0, 0)
            running[tape] = (start, ms, content if blank else ms, frames + 1, blanks + blank)
        ends = {tape: min(deadline(*run[:3], self.rules)[0], _FAR * 1000) for tape, run in running.items()}
        ended += [(tape, running.pop(tape)) for tape, end in ends.items() if end < now]
        if running:
            self.running.update((pickle.dumps(running),))
        else:
            self.running.clear()
        if len(rest):
            self.waiting.put([(pickle.dumps(rest),)])
        else:
            self.waiting.clear()
        ahead = [ends[tape] + 1 for tape in running] + ([min(int(rest["ms"].min()), _FAR * 1000)] if len(rest) else [])
        if ahead:
            self._wake_by(min(ahead))
        if ended:
            out = [(tape, run[0], end, run[3], run[4], why) for tape, run in ended for end, why in [deadline(*run[:3], self.rules)]]
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass

    def _wake_by(self, ms: int) -> None:
        have = self.wake.get()
        if have and have[0] <= ms:
            return
        if have:
            self.handle.deleteTimer(have[0])
        self.handle.registerTimer(ms)
        self.wake.update((ms,))


def captures(signal: DataFrame, late: str = "10 minutes", rules: EndRules | None = None, shards: int = 256) -> DataFrame:
    """(tape_id, start, end, frames, blank, reason): each capture of a tape once it is over.

    signal: a stream of (tape_id, ts timestamp, blank). A capture starts with the first signal after the one before; it
    ends when nothing came for `no_signal`, only blank frames for `blank_tail`, nothing for `idle`, or `longest` after
    its start, whichever is first. Rows that come later than `late` are left out; late_rows tells how many. Tapes are
    dealt to `shards` states, a number that a checkpoint keeps; the result does not depend on it. Of rows after
    the year 2200 those that come in one batch are in order. The session needs the RocksDB state store.
    """
    shard, blank = F.pmod(F.xxhash64("tape_id"), F.lit(shards)).alias("shard"), F.coalesce("blank", F.lit(False)).alias("blank")
    at = F.least(F.greatest("ts", F.timestamp_seconds(F.lit(_FIRST))), F.timestamp_seconds(F.lit(_LAST))).alias("at")
    rows = signal.where("tape_id is not null and ts is not null").select(shard, "tape_id", F.unix_millis("ts").alias("ms"), blank, at)
    out = rows.withWatermark("at", late).groupBy("shard").transformWithStateInPandas(Capture(rules or EndRules()), _OUTPUT, "append", "EventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("start", "end")})


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query left out because they came later than its watermark, as far as it remembers its progress."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that timers and lists need."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return own


def drained(stream: DataFrame, folder: str) -> StreamingQuery:
    """Run a stream over all that waits, into folder/out; returns the query when it is done."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
