"""The archive's index: tapes, scenes, media files, and the catalog that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions import dates, numbers

MEDIA_TAPE = "@media"


def in_workspace(workspace: str | None, column: str = "workspace") -> Column:
    """None lets all pass; a row without a workspace belongs to "default"."""
    if workspace is None:
        return F.lit(True)
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("default")) == workspace


def public_columns(df: DataFrame) -> DataFrame:
    """df without the columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def index_scenes(tapes: DataFrame, scenes: DataFrame, now_year: int | None = None) -> DataFrame:
    """A row for each scene with the tape's fields and the effective date and time. See sources.archive for the schemas."""
    t = tapes.select("tape_id", "label", "workspace", "recording_date", "undated_date", "scene_dates")
    s = scenes.join(t, "tape_id")
    rec = F.col("recording")
    own = F.try_element_at("scene_dates", F.col("scene_id"))

    def date(*given: Column) -> Column:
        return dates.scene_date(*given[:2], rec["datetime"], rec["datetime_valid"], F.col("scene_id"), given[2], now_year)

    none = F.lit(None).cast("string")
    return s.select(
        "tape_id", "label", "workspace", "scene_id", "scene_index", "frame_count",
        date(own, F.col("recording_date"), F.col("undated_date")).alias("date"),
        date(none, none, none).alias("read_date"),
        dates.scene_time(rec["datetime"], rec["datetime_valid"], F.col("scene_id")).alias("time"),
        F.col("timecode.start").alias("tc_start"), F.col("timecode.end").alias("tc_end"), F.col("video.standard").alias("standard"),
        F.col("files.archive.size_compressed").alias("dv"),
        F.coalesce("capture.dropped_frames", F.lit(0)).alias("dropped_frames"),
        F.when(F.col("capture.source_discontinuities").isNull(), 0).otherwise(F.size("capture.source_discontinuities")).alias("discontinuities"),
        F.col("capture.decode_errors").alias("decode_errors"), F.col("capture.error_score").alias("error_score"), "fingerprint",
    )


def tape_totals(index: DataFrame) -> DataFrame:
    """Per tape: first and last date, compressed bytes, scenes that no date could be read for."""
    return index.groupBy("tape_id").agg(
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.coalesce(F.sum("dv"), F.lit(0)).alias("total_dv"),
        F.count_if(F.col("read_date").isNull()).alias("undated_scenes"), F.count("*").alias("scenes"),
    )


def quality_flags(index: DataFrame, now_year: int | None = None) -> DataFrame:
    """index with `flags`: what a viewer is warned about."""
    year = F.substring("date", 1, 4).try_cast("int")
    marks = ((F.col("dropped_frames") > 0, "dropped"), (F.col("discontinuities") > 0, "discontinuity"), (year.isNull() | (year > dates.plausible_year(now_year)), "clock"))
    return index.withColumn("flags", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in marks))))


def visible() -> Column:
    """Media rows that are not split into clips."""
    return F.col("split").isNull() | (F.col("split") == 0)


def ready_media(media: DataFrame, workspace: str | None = None) -> DataFrame:
    return media.where((F.col("status") == "ready") & visible() & in_workspace(workspace))


def public_media(media: DataFrame) -> DataFrame:
    """Media as they are shown: date and time computed, no paths."""
    return media.select(
        "id", "kind", "name", "album", dates.effective_date("date_fix", "taken").alias("date"), dates.effective_time("date_fix", "taken").alias("time"),
        F.when(F.length("date_fix") > 0, "fix").otherwise(F.col("date_source")).alias("date_source"), "date_fix", "width", "height", "duration", "camera", "status",
        (F.coalesce(F.col("playable") != 0, F.lit(False)) | F.coalesce(F.col("proxy") == 1, F.lit(False))).alias("playable"),
        "size", "parent_id", "clip_start", "clip_end", F.nullif("fps", F.lit(0.0)).alias("fps"),
    )


def is_dvd(path: Column) -> Column:
    return path.rlike(r"(?i)/VTS_\d\d$")


def catalog(index: DataFrame, media: DataFrame) -> DataFrame:
    """One row for everything that can be searched: tape scenes, and ready media under the pseudo tape @media."""
    scenes = index.select(
        "tape_id", "scene_id", F.coalesce(F.nullif("workspace", F.lit("")), F.lit("default")).alias("workspace"), F.lit("dv").alias("kind"), "date", "time",
        F.coalesce("label", "tape_id").alias("label"), F.lit(None).cast("string").alias("name"), "scene_index", F.lit(None).cast("long").alias("media_id"),
        numbers.duration("frame_count", "standard").alias("duration"),
    )
    parents = media.select(F.col("id").alias("__p"), F.col("path").alias("__path"))
    m = media.where((F.col("status") == "ready") & visible()).join(parents, F.col("parent_id") == F.col("__p"), "left")
    dvd = is_dvd(F.col("path")) | F.coalesce(is_dvd(F.col("__path")), F.lit(False))
    files = m.select(
        F.lit(MEDIA_TAPE).alias("tape_id"), F.col("id").cast("string").alias("scene_id"), F.coalesce(F.nullif("workspace", F.lit("")), F.lit("default")).alias("workspace"),
        F.when((F.col("kind") == "video") & dvd, "dvd").otherwise(F.col("kind")).alias("kind"),
        dates.effective_date("date_fix", "taken").alias("date"), dates.effective_time("date_fix", "taken").alias("time"), F.col("album").alias("label"), "name",
        F.lit(None).cast("int").alias("scene_index"), F.col("id").alias("media_id"), F.col("duration").cast("double").alias("duration"),
    )
    return scenes.unionByName(files)


def albums(media: DataFrame, workspace: str | None = "default") -> DataFrame:
    """Albums with counts, dates and the first four covers, the newest first. Covers are the four least ids of 64 parts
    of an album, then of these; counts combine on the map side, so no task sorts an album."""
    m = media.where(visible() & (F.col("status") == "ready") & in_workspace(workspace)).withColumn("date", dates.effective_date("date_fix", "taken"))
    ids = m.select(F.col("album").alias("__album"), "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("__part"))
    for by in (["__album", "__part"], ["__album"]):
        ids = ids.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where("__rank <= 4")
    covers = ids.groupBy("__album").agg(F.sort_array(F.collect_list("id")).alias("cover"))
    out = m.groupBy("album").agg(
        F.count("*").alias("count"), F.count_if(F.col("kind") == "photo").alias("photos"), F.count_if(F.col("kind") != "photo").alias("videos"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
    )
    out = out.join(covers, F.col("album").eqNullSafe(F.col("__album"))).drop("__album")
    return out.orderBy(F.coalesce("date_max", F.lit("")).desc(), F.col("album").desc())


def media_counts(media: DataFrame) -> DataFrame:
    """One row of totals by status and kind."""
    m = media.where(visible())
    ready = F.col("status") == "ready"
    return m.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ready", "new", "error")),
        F.count_if(ready & (F.col("kind") == "photo")).alias("photos"), F.count_if(ready & (F.col("kind") != "photo")).alias("videos"),
        F.count_if(ready & (F.col("kind") == "video") & (F.col("playable") == 0) & (F.col("proxy") == 0)).alias("proxies_pending"),
    )


def backlog(media: DataFrame, what: str, limit: int = 50) -> DataFrame:
    """Rows that wait for a step, in order of id."""
    ready_video = (F.col("status") == "ready") & (F.col("kind") == "video")
    waits = {
        "new": F.col("status") == "new",
        "proxy": ready_video & visible() & (F.col("playable") == 0) & (F.col("proxy") == 0),
        "split": ready_video & F.col("split").isNull() & F.col("parent_id").isNull(),
        "fps": ready_video & F.col("fps").isNull(),
        "undated": (F.col("status") == "ready") & F.col("taken").isNull() & F.col("date_source").isNull() & F.col("parent_id").isNull(),
        "reproxy": ready_video & (F.col("reproxy") == 1),
    }
    return media.where(waits[what]).orderBy("id").limit(limit)


def pending(items: DataFrame, scanned: DataFrame, model: str) -> DataFrame:
    """Catalog rows that the model has not been run on yet."""
    done = scanned.where(F.col("model") == model).select("tape_id", "scene_id")
    return items.join(done, ["tape_id", "scene_id"], "left_anti")


def coverage(items: DataFrame, scanned: DataFrame, model: str, workspace: str | None = None) -> DataFrame:
    """Scenes scanned and in all."""
    done = scanned.where(F.col("model") == model).select("tape_id", "scene_id", F.lit(1).alias("__done")).distinct()
    own = items.where(in_workspace(workspace)).join(done, ["tape_id", "scene_id"], "left")
    return own.agg(F.count("__done").alias("scanned"), F.count("*").alias("total"))


def playlist(items: DataFrame) -> DataFrame:
    """(tape_id, scene_id) of valid items in order of pos, each once."""
    name = r"^[0-9A-Za-z._-]{1,80}$"
    good = items.where(((F.col("tape_id") == MEDIA_TAPE) | F.col("tape_id").rlike(name)) & F.col("scene_id").rlike(name))
    return good.groupBy("tape_id", "scene_id").agg(F.min("pos").alias("pos"))


def album_items(media: DataFrame, album: str) -> DataFrame:
    """An album's files as they are shown, by date, time and name; undated ones last."""
    own = public_media(media.where((F.col("album") == album) & (F.col("status") == "ready") & visible()))
    return own.orderBy(F.coalesce("date", F.lit("9999")), F.coalesce("time", F.lit("")), "name", "id")


def mark_reproxy(media: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """media with copies marked to be encoded anew: those of ids (id), or all. Only whole videos with a copy can be."""
    can = (F.col("kind") == "video") & F.col("parent_id").isNull() & (F.col("proxy") == 1)
    asked = media if ids is None else media.join(ids.select("id"), "id", "left_semi")
    marked = asked.where(can).select("id", F.lit(1).alias("__mark"))
    return media.join(marked, "id", "left").withColumn("reproxy", F.coalesce("__mark", "reproxy")).drop("__mark")


def reproxy_progress(media: DataFrame, done: int) -> DataFrame:
    """One row: copies done and in all, and the share."""
    waits = (F.col("status") == "ready") & (F.col("kind") == "video") & (F.col("reproxy") == 1)
    out = media.agg(F.count_if(waits).alias("left")).select(F.lit(done).cast("long").alias("done"), (F.col("left") + done).alias("total"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total"), 4)).otherwise(1.0))


def with_overlay(index: DataFrame, overlay: DataFrame) -> DataFrame:
    """Scenes as edited: overlay (tape_id, scene_id, name, value) holds the newest value of each field that was changed
    (name "date" or "label"), or "deleted" for scenes that are gone; a null scene_id means the whole tape, which an
    edit of the scene itself beats. Documents on disk stay as they are."""
    by_tape = overlay.where("scene_id is null").groupBy("tape_id").pivot("name", ["date", "label", "deleted"]).agg(F.first("value"))
    by_scene = overlay.where("scene_id is not null").groupBy("tape_id", "scene_id").pivot("name", ["date", "label", "deleted"]).agg(F.first("value"))
    t = by_tape.select("tape_id", *(F.col(c).alias(f"__t_{c}") for c in ("date", "label", "deleted")))
    s = by_scene.select("tape_id", "scene_id", *(F.col(c).alias(f"__s_{c}") for c in ("date", "label", "deleted")))
    both = index.join(t, "tape_id", "left").join(s, ["tape_id", "scene_id"], "left")
    live = both.where(F.coalesce("__s_deleted", "__t_deleted").isNull())
    return live.select([F.coalesce(f"__s_{c}", f"__t_{c}", c).alias(c) if c in ("date", "label") else F.col(c) for c in index.columns])


def build_token(scene: Column, restore: Column, stabilize: Column, upscale: Column) -> Column:
    """What a compressed or restored copy is kept under: the scene or TAPE, and a mark for each choice."""
    marks = F.concat(F.lit("-RES"), F.when(stabilize, "-STAB").otherwise(""), F.when(upscale, "-UP").otherwise(""))
    return F.concat(F.coalesce(scene, F.lit("TAPE")), F.when(restore, marks).otherwise(""))
