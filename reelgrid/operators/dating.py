"""Dates for files that carry none: from trusted file times, and from numbered neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.config import DEFAULTS
from reelgrid.functions import dates
from reelgrid.operators.scans import BUCKET, bucketed, handed_on, inside

STRETCH = 1024  # file counters that one window of neighbours looks at


def _local(mtime: str, zone: str) -> F.Column:
    return F.from_utc_timestamp(F.timestamp_seconds(mtime), zone)


def album_trust(media: DataFrame, zone: str = "UTC", tolerance_s: int = DEFAULTS.file_tolerance_s) -> DataFrame:
    """(album, refs, agree, near_share, trusted): whether an album's file times can be believed.

    Three or more photos dated by their camera decide: 70 % must agree with their file time. Else a bulk copy is looked
    for: more than half of the files within ten minutes of the upper median. The median is found by rank, so no list
    of an album's files is built.
    """
    m = media.where(F.coalesce("mtime", F.lit(0)) != 0)
    ref = (F.col("date_source") == "exif") & (F.length("taken") >= 19)
    off = F.abs(F.unix_timestamp(_local("mtime", zone)) - F.unix_timestamp(F.try_to_timestamp("taken")))
    each = Window.partitionBy("album")
    ranked = m.withColumn("__n", F.count("*").over(each)).withColumn("__r", F.row_number().over(each.orderBy("mtime", "id")))
    middle = ranked.where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select("album", F.col("mtime").alias("__mid"))
    votes = m.join(middle, "album").groupBy("album").agg(
        F.count_if(ref).alias("refs"), F.count_if(ref & (off <= tolerance_s)).alias("agree"), F.count("*").alias("files"), F.count_if(F.abs(F.col("mtime") - F.col("__mid")) <= 600).alias("near")
    )
    near = F.col("near") / F.col("files")
    trusted = F.when(F.col("refs") >= 3, F.col("agree") / F.col("refs") >= 0.7).otherwise((F.col("files") < 3) | (near <= 0.5))
    return votes.select("album", "refs", "agree", near.alias("near_share"), trusted.alias("trusted"))


def date_from_file_times(media: DataFrame, zone: str = "UTC", now_year: int | None = None) -> DataFrame:
    """(id, taken, date_source) for undated originals: "file" where the album's file times are trusted and older than
    the copy, else "none"; clips of a dated film follow."""
    todo = media.where(F.col("taken").isNull() & F.col("date_source").isNull() & F.col("parent_id").isNull() & (F.col("status") == "ready"))
    found = todo.join(album_trust(media, zone), "album", "left")
    seen = F.unix_timestamp(F.try_to_timestamp("added_at"))
    believed = F.coalesce("trusted", F.lit(False)) & (F.coalesce(seen, F.unix_timestamp(F.current_timestamp())) - F.col("mtime") > DEFAULTS.copy_window_s)
    taken = F.when(believed, dates.sane(F.date_format(_local("mtime", zone), "yyyy-MM-dd'T'HH:mm:ss"), now_year=now_year))
    out = found.select("id", taken.alias("taken")).withColumn("date_source", F.when(F.col("taken").isNotNull(), "file").otherwise("none"))
    return with_clips(out, media)


def with_clips(dated: DataFrame, media: DataFrame) -> DataFrame:
    """dated (id, taken, date_source) and the clips cut from those that have a date, moved by where they begin."""
    clips = media.where("parent_id is not null").select(F.col("id").alias("__clip"), "parent_id", F.coalesce("clip_start", F.lit(0)).alias("__at"))
    rows = dated.where("taken is not null").join(clips, F.col("id") == F.col("parent_id"))
    return dated.unionByName(rows.select(F.col("__clip").alias("id"), dates.shift("taken", F.col("__at")).alias("taken"), "date_source"))


def neighbours(points: DataFrame, keys: tuple[str, ...], at: str, known: str, value: str, most: float, width: float | None = None) -> DataFrame:
    """points with before and after: the value of the nearest known point on either side, at most `most` away, not at
    the same place. Two as-of joins as one sort: the last and the first known place in running windows by distinct
    place, so a key's points are never paired. With width the windows run inside stretches of `at`, and the nearest known
    places of the stretches around are handed on."""
    places = points.groupBy(*keys, at).agg(F.max(F.when(F.col(known), F.struct(F.col(at).alias("p"), F.col(value).alias("hi")))).alias("last"), F.min(F.when(F.col(known), F.struct(F.col(at).alias("p"), F.col(value).alias("lo")))).alias("first"))
    places = bucketed(places, at, width) if width else places.withColumn(BUCKET, F.lit(0))
    order = inside(keys, at)
    below = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    if width:
        places = handed_on(places, keys, {"last": F.max("last"), "first": F.min("first")}, {"__below": ("last", "last"), "__above": ("first", "first")})
        below, above = F.coalesce(below, "__below"), F.coalesce(above, "__above")
    around = places.withColumn("__b", below).withColumn("__a", above)
    around = around.select(*keys, at, F.when(F.col(at) - F.col("__b.p") <= most, F.col("__b.hi")).alias("before"), F.when(F.col("__a.p") - F.col(at) <= most, F.col("__a.lo")).alias("after"))
    return points.join(around, [*keys, at], "left")


def date_from_neighbours(media: DataFrame, gap: int = DEFAULTS.neighbour_gap, span_s: int = DEFAULTS.neighbour_span_s) -> DataFrame:
    """(id, taken, date_source) for files whose times were not believed: the middle between the nearest dated files of
    the same counter before and after, if these are within span_s ("neighbors"), else none ("nodate")."""
    m = media.withColumn("n", dates.file_counter("name"))
    known = F.col("taken").isNotNull() & ~F.coalesce("date_source", F.lit("")).isin("none", "nodate", "neighbors")
    m = m.withColumn("known", known).withColumn("s", F.unix_timestamp(F.try_to_timestamp("taken")))
    placed = neighbours(m.where("n is not null"), ("album",), "n", "known", "s", gap, width=STRETCH)
    close = F.abs(F.col("after") - F.col("before")) <= span_s
    middle = F.floor((F.col("before") + F.col("after")) / 2).cast("long")
    found = placed.select("id", F.when(close, F.date_format(F.timestamp_seconds(middle), "yyyy-MM-dd'T'HH:mm:ss")).alias("__taken"))
    todo = media.where((F.col("date_source") == "none") & F.col("parent_id").isNull()).select("id")
    out = todo.join(found, "id", "left").select("id", F.col("__taken").alias("taken"))
    return with_clips(out.withColumn("date_source", F.when(F.col("taken").isNotNull(), "neighbors").otherwise("nodate")), media)


def redate_scans(media: DataFrame, now_year: int | None = None) -> DataFrame:
    """(id, old, taken, date_source) of scans and transfers whose date should come from their name or folder."""
    own = media.where((F.col("status") == "ready") & F.col("parent_id").isNull() & F.coalesce("date_fix", F.lit("")).eqNullSafe(F.lit("")))
    scans = own.where(dates.analog_origin("path", F.col("camera")))
    device = F.when(F.col("date_source").isin("exif", "meta"), F.col("taken"))
    picked = scans.withColumn("__p", dates.pick_date(F.col("path"), device, F.col("date_source"), F.lit(True), now_year))
    changed = ~(F.col("__p.taken").eqNullSafe(F.col("taken")) & F.col("__p.date_source").eqNullSafe(F.col("date_source")))
    useful = F.col("__p.taken").isNotNull() | F.coalesce("date_source", F.lit("")).isin("exif", "meta", "file", "neighbors")
    return picked.where(changed & useful).select("id", F.col("taken").alias("old"), F.col("__p.taken").alias("taken"), F.coalesce("__p.date_source", F.lit("scan")).alias("date_source"))
