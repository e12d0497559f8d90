"""Intervals in seconds: islands, segments, overlap joins and the basket."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators.scans import BUCKET, bucketed, handed_on, inside


def islands(spans: DataFrame, keys: Sequence[str], start: str = "t0", end: str = "t1", gap: float = 0.0, score: str | None = None, width: float | None = None) -> DataFrame:
    """Runs of spans of one key that overlap or lie within gap of the run's end so far: keys, start, end, the best score.

    A window over the key in order of start: a span opens a run when it begins later than the greatest end before it plus
    gap. With width the window runs inside stretches of so many seconds, and the greatest end and the number of runs
    before each are handed on, so a key with most of the spans is spread. Spans with a null start or end are left out.
    Needs end >= start and gap >= 0.
    """
    spans = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = bucketed(spans, start, width) if width else spans.withColumn(BUCKET, F.lit(0))
    order = inside(keys, start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    if width:
        rows = handed_on(rows, keys, {"end": F.max(end)}, {"__reach": ("max", "end")})
        reach = F.greatest(reach, F.col("__reach"))
    run = rows.withColumn("__opens", (reach.isNull() | (F.col(start) - reach > gap)).cast("int"))
    number = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    if width:
        run = handed_on(run, keys, {"opens": F.sum("__opens")}, {"__runs": ("sum", "opens")})
        number = number + F.col("__runs")
    best = [F.max(score).alias(score)] if score else []
    return run.withColumn("__run", number).groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), *best).drop("__run")


def segments(times: Column, gap: int = 2) -> Column:
    """Whole seconds of an array as [first, last] stretches; a stretch goes on over pauses of up to gap. Linear: the
    places where neighbours are farther apart end one stretch and begin the next."""
    ts = F.array_sort(F.array_distinct(F.filter(times, lambda t: t.isNotNull()))).cast("array<int>")
    n = F.size(ts)
    pairs = F.zip_with(F.slice(ts, 1, F.greatest(n - 1, F.lit(0))), F.slice(ts, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cuts = F.filter(pairs, lambda c: c["q"] - c["p"] > gap)
    firsts = F.concat(F.slice(ts, 1, 1), F.transform(cuts, lambda c: c["q"]))
    lasts = F.concat(F.transform(cuts, lambda c: c["p"]), F.slice(ts, F.greatest(n, F.lit(1)), F.lit(1)))
    return F.zip_with(firsts, lasts, lambda a, b: F.array(a, b))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of a key's closed intervals that share a point. The key is an equi-join; the range is its residual."""
    return left.join(right, list(keys)).where((F.col(a[0]) <= F.col(b[1])) & (F.col(a[1]) >= F.col(b[0])))


def overlapping_binned(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """overlapping() for keys with very many intervals: each goes to the bins of `width` that it touches, bins are joined,
    and a pair counts in the first bin that both touch."""

    def bins(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        lo, hi = (F.floor(F.col(c) / width).cast("long") for c in ends)
        return df.where(F.col(ends[0]) <= F.col(ends[1])).withColumn("__bin", F.explode(F.sequence(lo, hi)))

    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width).cast("long")
    both = bins(left, a).join(bins(right, b), [*keys, "__bin"])
    return both.where((F.col(a[0]) <= F.col(b[1])) & (F.col(a[1]) >= F.col(b[0])) & (F.col("__bin") == first)).drop("__bin")


def overlapping_levels(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """overlapping() without a width to choose: intervals have levels by powers of two of their length.

    An interval stands in the one or two bins of its level that it touches, and in those of each longer level in use; a
    pair meets at the level of its longer interval, in the first bin that both touch. So neither long intervals among
    short ones nor a key with half of the rows makes a large group, unless that many intervals do overlap. Only the list
    of levels, at most some sixty numbers, reaches the driver. Lengths under 2**-10 count as that.
    """

    def level(ends: tuple[str, str]) -> Column:
        size = F.greatest(F.col(ends[1]).cast("double") - F.col(ends[0]).cast("double"), F.lit(2.0**-10))
        return F.ceil(F.log2(size)).cast("int")

    left, right = (df.where(F.col(e[0]) <= F.col(e[1])).withColumn(name, level(e)) for df, e, name in ((left, a, "__la"), (right, b, "__lb")))
    levels = sorted(r[0] for r in left.select("__la").union(right.select("__lb")).distinct().collect())

    def bins(df: DataFrame, ends: tuple[str, str], own: str) -> DataFrame:
        known = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
        each = df.withColumn("__level", F.explode(F.filter(known, lambda x: x >= F.col(own))))
        lo, hi = (F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("__level"))).cast("long") for c in ends)
        return each.withColumn("__bin", F.explode(F.sequence(lo, hi)))

    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])).cast("double") / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    both = bins(left, a, "__la").join(bins(right, b, "__lb"), [*keys, "__level", "__bin"])
    meets = (F.col(a[0]) <= F.col(b[1])) & (F.col(a[1]) >= F.col(b[0])) & (F.col("__bin") == first) & (F.col("__level") == F.greatest("__la", "__lb"))
    return both.where(meets).drop("__bin", "__level", "__la", "__lb")


def seen_within(times: Column, start: Column, end: Column) -> Column:
    """True if any of the times lies in [start, end]."""
    return F.exists(times, lambda t: t.between(start, end))


def sessions(events: DataFrame, keys: Sequence[str], at: str, breaks: Column) -> DataFrame:
    """events with `session`, the number of breaks up to them; breaks may look at lag(...) over sessions_window()."""
    order = sessions_window(keys, at)
    flagged = events.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn("session", F.sum("__break").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def sessions_window(keys: Sequence[str], at: str) -> Window:
    return Window.partitionBy(*keys).orderBy(at)


def timecode_breaks(frames: DataFrame, keys: Sequence[str], index: str, timecode: str, fresh: str, jump: float = 1.0) -> DataFrame:
    """Recordings of a tape: a new one starts at a marked frame, and where the timecode (seconds) runs back or jumps."""
    before = F.lag(timecode).over(sessions_window(keys, index))
    return sessions(frames, keys, index, F.col(fresh) | (F.col(timecode) < before) | (F.col(timecode) - before > jump))


def offsets(rows: DataFrame, keys: Sequence[str], order: str, count: str, name: str = "start_frame", width: float | None = None) -> DataFrame:
    """The sum of the counts before each row; with width in stretches of the order, whose sums are handed on."""
    each = bucketed(rows, order, width) if width else rows.withColumn(BUCKET, F.lit(0))
    before = F.coalesce(F.sum(count).over(inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if width:
        each = handed_on(each, keys, {"count": F.sum(count)}, {"__sum": ("sum", "count")})
        before = before + F.coalesce("__sum", F.lit(0))
    return each.withColumn(name, before).drop(BUCKET, "__sum")


BASKET = "workspace string, tape_id string, scene_id string, id long, start double, end double"


def add_to_basket(moments: DataFrame) -> DataFrame:
    """The basket after moments (workspace, tape_id, scene_id, seq, start, end) were added in order of seq.

    A moment that overlaps one of its scene already there widens the first such; else it becomes one of its own, with
    its seq as id. Not transitive: two stored moments that come to overlap stay two, so the order matters and a scene's
    moments, which people picked by hand, are taken in turn in one task, scene after scene.
    """

    kinds = [pa.string()] * 3 + [pa.int64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in BASKET.split(", ")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scenes one after the other, each with its moments in order of seq; a scene may go on in the next batch."""
        scene, kept = None, []

        def full(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done: list[tuple] = []
            for *key, seq, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != scene:
                    done += [(*scene, *k) for k in kept] if scene else []
                    scene, kept = key, []
                a, b = max(0.0, min(start, end)), max(start, end)
                for k in kept:
                    if a <= k[2] and b >= k[1]:
                        k[1], k[2] = min(k[1], a), max(k[2], b)
                        break
                else:
                    kept.append([seq, a, b])
            if done:
                yield full(done)
        if kept:
            yield full([(*scene, *k) for k in kept])

    named = moments.withColumn("workspace", F.coalesce(F.nullif("workspace", F.lit("")), F.lit("default")))
    named = named.select("workspace", "tape_id", "scene_id", "seq", F.col("start").cast("double"), F.col("end").cast("double")).where("start is not null and end is not null")
    keys = ["workspace", "tape_id", "scene_id"]
    return named.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("seq")).mapInArrow(fill, BASKET)


def basket(stored: DataFrame, workspace: str) -> DataFrame:
    """A workspace's moments in the order that they were added."""
    return stored.where(F.col("workspace") == workspace).orderBy("id")


def remove_from_basket(stored: DataFrame, workspace: str, ids: DataFrame | None = None) -> DataFrame:
    """stored without the workspace's moments of ids (id), or without all of them."""
    if ids is None:
        return stored.where(F.col("workspace") != workspace)
    gone = ids.select("id", F.lit(workspace).alias("workspace"))
    return stored.join(gone, ["id", "workspace"], "left_anti")
