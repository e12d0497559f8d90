"""Sequenced change applier: each client's changes take effect in the order of their numbers, whatever order they come in.

A streaming query holds early changes in runs, as a log-structured store does: a batch appends one run sorted by number,
a heap over the runs' cursors drains what is next or has waited too long, and several runs are merged into one now and then.

No client need fit into one task. Its numbers are cut into ranges of RANGE, each with state of its own. Two
facts tell a range what happens outside: when the numbers before it are through, and when a later change that has waited
too long makes the client jump over it. A number is passed in the batch min(J, max(a, p)): p the batch that passes the
number before, a that of its change, J the first that jumps it. Such steps compose to steps of the same form, so both facts
are windows over one row a range, and reach the range as rows of the batch in which they come true. Repeats of a number,
which only its earliest change can win, are dealt out by salt.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelgrid.plans.scratch import new_folder

BATCHES, FIRST_DAY, DAYS, PATIENCE = 10, 19723, 160, 8
RANGE = 1024  # numbers of a client in one range
SHARD = 20_000  # rows of a shard of ranges, about
SALTS = 64  # shards that repeats of a range's numbers are dealt to
RUNS = 4  # runs beyond which they are merged
_NEVER, _DAY_MS, _LAST_DAY = BATCHES + 2, 86_400_000, 2_900_000
_INPUT = "shard long, client_id long, range long, n long, day int, change_id long, op string, city string, balance double, order string, repeat boolean"
_OUTPUT = "change_id long, client_id long, range long, status string, batch int, n long, missed long, op string, city string, city_set boolean, balance double, balance_set boolean"
_Out = Row(*(f.split()[0] for f in _OUTPUT.split(", ")))


class _Head:
    """What a range of a client's numbers is at: the next number, whether all before the range are through, where its
    rows in each stored run begin to be unread, and the values that its changes left."""

    __slots__ = ("at", "city", "cursors", "earliest", "open", "balance")

    def __init__(self, at: int, open_: bool):
        self.at, self.open, self.cursors, self.earliest = at, open_, {}, None
        self.city: tuple | None = None
        self.balance: tuple | None = None

    def __getstate__(self):
        return tuple(getattr(self, x) for x in self.__slots__)

    def __setstate__(self, values):
        for x, v in zip(self.__slots__, values, strict=True):
            setattr(self, x, v)


class Applier(StatefulProcessor):
    """Applies the changes of one shard of ranges in one batch; at the end all that is held.

    A shard is a bounded number of rows, so that a call of the state store, which costs far more than a change, serves
    many. Its list state has a run a batch: for each range that kept rows, these in order of number. Rows of the order
    "jump" or "open" say that a jump passes a whole range at the start of this batch, or that in it all numbers before
    are through. The watermark is the largest day of all batches before; a shard's timer rings when the first row of any
    of its ranges has waited too long, or early.
    """

    def __init__(self, batch: int, last: bool = False, size: int = RANGE):
        self.batch, self.last, self.size = batch, last, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "heads binary, alarm long, runs array<int>")
        self.runs = handle.getListState("runs", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[tuple, list] = {}
        orders: dict[tuple, set] = {}
        for r in rows:
            if r.repeat:  # not the earliest of its number
                yield self._rejected(r.client_id, r.range, r.change_id, r.n, r.op)
            elif r.order:
                orders.setdefault((r.client_id, r.range), set()).add(r.order)
            elif r.n is not None:
                fresh.setdefault((r.client_id, r.range), []).append((r.n, r.day, r.change_id, r.op, r.city, r.balance))
        if fresh or orders:
            yield from self._turn(fresh, orders, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._turn({}, {}, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _rejected(self, client: int | None, range_: int, change_id: int, n: int, op: str | None) -> Row:
        return _Out(change_id, client, range_, "rejected", self.batch, n, 0, op, None, False, None, False)

    def _turn(self, fresh: dict[tuple, list], orders: dict[tuple, set], timers, fired: int = -1) -> Iterator[Row]:
        """The start of the batch for ranges with something due, then the batch's rows."""
        packed, alarm, names = self.heads.get() or (None, -1, [])
        if fired >= 0:
            if fired != alarm:
                return
            alarm = -1
        heads: dict[tuple, _Head] = pickle.loads(packed) if packed else {}
        stored = dict(zip(names, (pickle.loads(x[0]) for x in self.runs.get()), strict=True)) if names else {}
        expired, new_run, kept = timers.getCurrentWatermarkInMs() // _DAY_MS - PATIENCE, {}, False
        due = {k for k, h in heads.items() if h.earliest is not None and (self.last or h.earliest <= expired)}
        for key in due | fresh.keys() | orders.keys():
            head = heads.get(key) or heads.setdefault(key, _Head(key[1] * self.size + 1, key[1] == 0))
            merge = _Merge({run: stored[run][key][i:] for run, i in head.cursors.items()})
            yield from self._range(key, head, merge, fresh.get(key, []), orders.get(key, ()), expired)
            left = merge.rest(self.batch)
            if left:
                new_run[key] = left
            cursors = {run: i + merge.used[run] for run, i in head.cursors.items()}
            head.cursors = {run: i for run, i in cursors.items() if i < len(stored[run][key])}
            if left:
                head.cursors[self.batch] = 0
            days = [r[1] for run in merge.runs for r in merge.rest(run)]
            head.earliest = min(days, default=None)
        names = self._keep(heads, stored, new_run)
        wake = min((h.earliest for h in heads.values() if h.earliest is not None), default=None)
        if wake is not None:
            ms = (wake + PATIENCE) * _DAY_MS - 1
            if alarm < 0 or ms < alarm:
                self.handle.registerTimer(ms)
                alarm = ms
        self.heads.update((pickle.dumps(heads), alarm, names))

    def _range(self, key: tuple, head: _Head, merge: _Merge, fresh: list, orders, expired: int) -> Iterator[Row]:
        # the start of the batch: what has waited too long, here or in a later range
        end = (key[1] + 1) * self.size
        until = max((r[0] for run in merge.runs for r in merge.rest(run) if self.last or r[1] <= expired), default=-1)
        if "jump" in orders:
            until = end
        head.open |= until >= 0
        yield from self._drained(key, head, merge, until)
        if "jump" in orders:
            head.at = end + 1
        # the batch's rows, in order of day and id
        held, run = {r[0] for old in merge.runs for r in merge.rest(old)}, []
        for r in sorted(fresh, key=lambda r: (r[1], r[2])):
            if r[0] < head.at or r[0] in held:
                yield self._rejected(key[0], key[1], r[2], r[0], r[3])
            else:
                held.add(r[0])
                run.append(r)
        if run:
            merge.add(self.batch, sorted(run, key=lambda r: r[0]))
        head.open |= "open" in orders
        yield from self._drained(key, head, merge, -1)

    def _drained(self, key: tuple, head: _Head, merge: _Merge, until: int) -> Iterator[Row]:
        for n, _, change_id, op, city, balance in merge.drain(head.at, until, head.open):
            if op in ("I", "D"):
                head.city, head.balance = ((city,), (balance,)) if op == "I" else ((None,), (None,))
            elif op == "U":
                head.city = head.city if city is None else (city,)
                head.balance = head.balance if balance is None else (balance,)
            yield _Out(change_id, key[0], key[1], "applied", self.batch, n, n - head.at, op, *(head.city or (None,)), head.city is not None, *(head.balance or (None,)), head.balance is not None)
            head.at = n + 1

    def _keep(self, heads: dict[tuple, _Head], stored: dict[int, dict], new_run: dict) -> list[int]:
        """Names of the runs that are stored now. The batch's run is appended; a run that no cursor points to goes, and
        when more than RUNS are left, their unread rows are merged into one."""
        used = {run for h in heads.values() for run in h.cursors if run in stored}
        if used == stored.keys() and len(used) + bool(new_run) <= RUNS:
            if new_run:
                self.runs.appendValue((pickle.dumps(new_run),))
            return [*stored, *([self.batch] if new_run else [])]
        if len(used) + bool(new_run) > RUNS:
            one = {}
            for key, h in heads.items():
                if h.cursors:
                    one[key] = list(heapq.merge(*((new_run[key] if run == self.batch else stored[run][key][i:]) for run, i in h.cursors.items())))
                    h.cursors = {self.batch: 0}
            runs = {self.batch: one}
        else:
            runs = {run: rows for run, rows in stored.items() if run in used} | ({self.batch: new_run} if new_run else {})
        if runs:
            self.runs.put([(pickle.dumps(rows),) for rows in runs.values()])
        else:
            self.runs.clear()
        return list(runs)


class _Merge:
    """Rows of sorted runs in turn, by a heap with one cursor a run."""

    def __init__(self, runs: dict[int, list[tuple]]):
        self.runs, self.used = dict(runs), dict.fromkeys(runs, 0)
        self.heap = [(rows[0][0], run) for run, rows in self.runs.items() if rows]
        heapq.heapify(self.heap)

    def add(self, run: int, rows: list[tuple]) -> None:
        self.runs[run], self.used[run] = rows, 0
        heapq.heappush(self.heap, (rows[0][0], run))

    def drain(self, at: int, until: int, is_open: bool) -> Iterator[tuple]:
        """All rows up to the number `until`, and those that follow without a gap."""
        while self.heap and (self.heap[0][0] <= until or (is_open and self.heap[0][0] == at)):
            n, run = heapq.heappop(self.heap)
            row = self.runs[run][self.used[run]]
            self.used[run] += 1
            if self.used[run] < len(self.runs[run]):
                heapq.heappush(self.heap, (self.runs[run][self.used[run]][0], run))
            yield row
            at = n + 1

    def rest(self, run: int) -> list[tuple]:
        """What is unread of a run."""
        return self.runs[run][self.used[run] :] if run in self.runs else []


def _batch(day: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def _numbers(rows: DataFrame, size: int) -> DataFrame:
    """(client_id, seq, n, lead): n is the dense rank of seq in its client, lead the earliest row left with that number.

    Ranks are counted inside stretches of seq first; the stretches' counts, a row each, are added up by client.
    """
    pairs = rows.groupBy("client_id", "seq").agg(F.min(F.when(F.col("stays"), F.struct("day", "change_id", "op", "city", "balance"))).alias("lead"))
    pairs = pairs.withColumn("stretch", F.floor(F.col("seq") / size))
    inside = pairs.withColumn("place", F.row_number().over(Window.partitionBy("client_id", "stretch").orderBy(F.col("seq").asc_nulls_last())))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("client_id").orderBy(F.col("stretch").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = pairs.groupBy("client_id", "stretch").agg(F.count(F.lit(1)).alias("size")).select(F.col("client_id").alias("c"), F.col("stretch").alias("s"), before.alias("before"))
    joined = inside.join(sizes, F.col("client_id").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")))
    return joined.select("client_id", "seq", (F.col("before") + F.col("place")).alias("n"), "lead")


def _orders(numbers: DataFrame, last_days: dict[int, int], size: int) -> DataFrame:
    """Rows of the orders "open" and "jump" for ranges of clients that have several; last_days: the largest day by batch."""
    seen, due = None, []
    for b in range(1, BATCHES + 1):
        if seen is not None:
            due.append(F.when((F.lit(b) > F.col("a")) & (F.col("lead.day") + PATIENCE <= seen), b))
        if b in last_days:
            seen = max(last_days[b], -(1 << 31) if seen is None else seen)
    wide = numbers.where(F.col("n") > size).select(F.col("client_id").alias("c")).distinct()
    own = numbers.join(wide, F.col("client_id").eqNullSafe(F.col("c")), "left_semi").withColumn("range", F.floor((F.col("n") - 1) / size)).withColumn("a", _batch(F.col("lead.day")))
    own = own.withColumn("e", F.coalesce(*due, F.lit(BATCHES + 1)))
    one = F.when(F.col("lead").isNotNull(), F.struct(F.col("n").cast("long").alias("n"), "a", F.col("e").cast("int").alias("e")))
    spans = own.groupBy("client_id", "range").agg(F.sort_array(F.collect_list(one), asc=False).alias("xs"))
    start = F.struct(
        F.lit(_NEVER).alias("best"), F.lit(0).alias("most"), F.lit(_NEVER).alias("e"), ((F.col("range") + 1) * size + 1).cast("long").alias("prev"),
    )

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(acc["prev"] - x["n"] > 1, _NEVER).otherwise(acc["most"])
        e = F.least(acc["e"], x["e"])
        return F.struct(F.least(acc["best"], F.greatest(e, gap)).alias("best"), F.greatest(gap, x["a"]).alias("most"), e.alias("e"), x["n"].alias("prev"))

    spans = spans.select("client_id", "range", F.aggregate("xs", start, step).alias("f"))
    through = F.when(F.col("f.prev") > F.col("range") * size + 1, _NEVER).otherwise(F.col("f.most"))
    w = Window.partitionBy("client_id").orderBy("range")
    later = F.coalesce(F.min("f.e").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(_NEVER))
    spans = spans.select("client_id", "range", F.col("f.best").alias("best"), through.alias("through"), later.alias("jump"))

    def before(x: Column) -> Column:
        return F.coalesce(F.max(F.when(x, F.col("range"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))

    freed = F.least("jump", "best")
    when = F.coalesce(*(F.when(before(freed <= b) >= before((F.col("through") > b) & (freed > b)), b) for b in range(1, BATCHES + 1)), F.lit(_NEVER))
    spans = spans.select("client_id", "range", "jump", F.when(F.col("range") > 0, when).otherwise(_NEVER).alias("open"))
    told = spans.select("client_id", "range", F.explode(F.create_map(F.lit("jump"), F.col("jump"), F.lit("open"), F.col("open"))).alias("order", "batch"))
    return told.where(F.col("batch") <= BATCHES)


def _prepared(changes: DataFrame, folder: str, size: int) -> None:
    """Write the rows of all batches to folder/batch=<n>."""
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")))
    rows = changes.distinct().select("change_id", "client_id", "seq", "op", "city", "balance", h.alias("h"), F.unix_date(F.to_date("valid_at")).alias("d"))
    rows = rows.withColumn("day", (F.col("d") + 5 * (F.col("h") % 4)).cast("int")).withColumn("stays", F.col("day").isNotNull() & (F.col("h") % 11 != 0))
    numbers = _numbers(rows, size).withColumnsRenamed({"client_id": "c", "seq": "s"})
    mine = F.struct("day", "change_id", "op", "city", "balance").eqNullSafe(F.col("lead"))
    numbered = rows.where("stays").join(numbers, F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s")))
    salt = F.when(mine, 0).otherwise(1 + F.pmod(F.xxhash64("change_id"), F.lit(SALTS))).cast("int")
    kept = numbered.select("client_id", F.floor((F.col("n") - 1) / size).alias("range"), salt.alias("salt"), mine.alias("first"), "n", "day", "change_id", "op", "city", "balance", F.lit(None).cast("string").alias("order"), _batch(F.col("day")).alias("batch"))
    days = rows.where("stays").groupBy(_batch(F.col("day")).alias("batch")).agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("n")).collect()  # a row a batch
    orders = _orders(numbers.withColumnsRenamed({"c": "client_id", "s": "seq"}), {r.batch: r.day for r in days}, size)
    every = kept.unionByName(orders.withColumns({"salt": F.lit(0), "first": F.lit(True)}), allowMissingColumns=True)
    shard = F.pmod(F.xxhash64("client_id", "range", "salt"), F.lit(1 + sum(r.n for r in days) // SHARD))
    every.withColumns({"shard": shard, "repeat": ~F.col("first")}).drop("salt", "first").write.partitionBy("batch").parquet(folder)


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream's settings."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each small store takes MB of disk ahead
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # else each start of the query leaves its stores open for a minute
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def _feed(spark: SparkSession, folder: str, batch: int, size: int, last: bool = False) -> None:
    """Start the query on what is new in the input folder, and wait until it has run."""
    rows = spark.readStream.schema(_INPUT).parquet(f"{folder}/in")
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("day").cast("long") * 86400)).withWatermark("at", "0 seconds")
    out = rows.groupBy("shard").transformWithState(Applier(batch, last, size), _OUTPUT, "append", "EventTime")
    stream = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    stream.trigger(availableNow=True).start().awaitTermination()


def _settled(out: DataFrame) -> DataFrame:
    """The result, with what each range can't know of those before: the values they leave and the last number applied."""
    applied = out.where("status = 'applied'")
    ends = applied.groupBy(F.col("client_id").alias("c"), F.col("range").alias("r")).agg(
        F.min("n").alias("first"), F.max("n").alias("last"),
        F.max_by(F.struct("city"), F.when(F.col("city_set"), F.col("n"))).alias("city_end"), F.max_by(F.struct("balance"), F.when(F.col("balance_set"), F.col("n"))).alias("balance_end"),
    )
    w = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(
        "c", "r", "first", F.max("last").over(w).alias("before"), F.max("last").over(Window.partitionBy("c")).alias("final"),
        *(F.last(x, ignorenulls=True).over(w).alias(x) for x in ("city_end", "balance_end")),
    )
    joined = applied.join(known, F.col("client_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    balance = F.when(F.col("balance_set"), F.col("balance")).otherwise(F.col("balance_end.balance"))
    after = joined.select(
        "change_id", "client_id", "status", "batch",
        F.when(F.col("n") == F.col("first"), F.col("n") - 1 - F.coalesce("before", F.lit(0))).otherwise(F.col("missed")).alias("missed"),
        F.when(F.col("city_set"), F.col("city")).otherwise(F.col("city_end.city")).alias("city"), F.floor(balance * 100 + 0.5).cast("long").alias("cents"),
        ((F.col("n") == F.col("final")) & F.coalesce(F.col("op") != "D", F.lit(True))).alias("current"),
    )
    gone = out.where("status = 'rejected'").select("change_id", "client_id", "status", "batch", F.lit(0).cast("long").alias("missed"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("long").alias("cents"), F.lit(False).alias("current"))
    return after.unionByName(gone)


def apply_changes(changes: DataFrame, size: int = RANGE) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current of all changes that are not dropped.

    changes: change_id, client_id, seq, op, valid_at, city, balance. Distinct rows get the number n, the dense rank of seq
    in their client (null is the last one), and the day (valid_at's, later by 0, 5, 10 or 15 as crc32 of the id says);
    those without valid_at and an eleventh by the same hash go, and so do null ids. Ten batches by day are written under
    spark.checkpoint.dir and fed in turn to a query that is started anew for each on one checkpoint; days before the first
    batch count for it. A client's changes apply by number. A change whose number is held or below the next is rejected;
    one whose day was PATIENCE days ago when a batch starts makes its client jump to the least number held; the rest is
    applied after the last batch. Insert sets city and balance, update those that are given, delete none; other
    operations count as applied and change nothing. A null client_id is a client. Rows that are equal but for other
    columns are rows of their own, of which one is applied. A lost executor costs a rerun of its tasks; a query that fails
    goes on from its checkpoint. A new folder is used at every call.
    size: numbers of a client in one range; the result does not depend on it.
    """
    spark = changes.sparkSession
    folder = new_folder(spark, "changes")
    _prepared(changes, f"{folder}/prepared", size)
    own = _session(spark)
    prepared = own.read.schema(f"{_INPUT}, batch int").parquet(f"{folder}/prepared")
    for batch in range(1, BATCHES + 1):
        prepared.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{folder}/in")
        _feed(own, folder, batch, size)
    tick = own.range(1).select(F.lit(-1).cast("long").alias("shard"), F.lit(_LAST_DAY).alias("day"))
    own.createDataFrame([], _INPUT).unionByName(tick, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    _feed(own, folder, BATCHES + 1, size, last=True)
    return _settled(spark.read.schema(_OUTPUT).parquet(f"{folder}/out"))
