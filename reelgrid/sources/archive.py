"""Reading an archive: scene and tape documents, folders of files, rule files, system text, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.config import DEFAULTS

SCENE = (
    "tape_id string, scene_id string, scene_index int, frame_count bigint, "
    "recording struct<datetime:string,datetime_source:string,datetime_valid:boolean>, timecode struct<start:string,end:string>, video struct<standard:string>, "
    "capture struct<dropped_frames:int,source_discontinuities:array<string>,decode_errors:int,error_score:int>, "
    "fingerprint struct<datetime:string,tc_start:string,tc_end:string,frame_count:bigint,frame_hashes:array<string>>, files struct<archive:struct<size_compressed:bigint>>"
)
TAPE = "tape_id string, label string, recording_date string, undated_date string, scene_dates map<string,string>, workspace string, scene_count int"
MEDIA = (
    "id bigint, path string, album string, name string, kind string, size bigint, mtime double, status string, error string, taken string, date_source string, date_fix string, "
    "width int, height int, duration double, camera string, playable int, proxy int, workspace string, added_at string, parent_id bigint, clip_start double, clip_end double, "
    "split int, fps double, reproxy int"
)
FRAMES = "tape_id string, scene_id string, t double, t_end double, emb array<float>"
TAGS = "tape_id string, scene_id string, tag string, t0 double, t1 double, score double"
TRACKS = (
    "id bigint, person_id bigint, workspace string, tape_id string, scene_id string, embedding array<float>, quality double, times array<int>, "
    "arc array<float>, rq double, frontal double"
)
PERSONS = "id bigint, workspace string, name string, hidden boolean, centroid array<float>, n int, created_at string, anchor bigint, grp string"
BASKET = "workspace string, tape_id string, scene_id string, seq bigint, start double, end double"

# Names of files and folders.
PHOTOS = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "bmp", "tif", "tiff")
VIDEOS = ("mp4", "mov", "avi", "mkv", "mpg", "mpeg", "m4v", "mts", "m2ts", "3gp", "wmv", "webm", "vob", "mod", "dv")
SKIPPED_FOLDERS = (
    "screenshots", "screenshot", "zrzuty ekranu", "program files", "program files (x86)", "windows", "appdata", "$recycle.bin", "recycler",
    "system volume information", "@eadir", "#recycle", ".@__thumb",
)
SCREENSHOT = r"(?i)^(screen ?shot|zrzut[ _]ekranu|capture d.écran|bildschirmfoto)"
TITLE_PART = r"(?i)^VTS_(\d\d)_([1-9])\.VOB$"
TITLE_FILE = r"(?i)^(VTS_\d\d_\d|VIDEO_TS)\.(VOB|IFO|BUP)$"


def documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON documents, one a file; those that can't be read are left out."""
    raw = spark.read.schema(f"{schema}, _corrupt string").json(paths, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return raw.where("_corrupt is null").drop("_corrupt")


def scenes(spark: SparkSession, archive: str) -> DataFrame:
    """The scene documents of all tapes: files whose names begin with a digit; a missing tape id is the folder's name."""
    d = documents(spark, f"{archive}/*/[0-9]*.json", SCENE).withColumn("__f", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return d.withColumn("tape_id", F.coalesce("tape_id", F.url_decode("__f"))).drop("__f")


def tapes(spark: SparkSession, archive: str) -> DataFrame:
    return documents(spark, f"{archive}/*/tape.json", TAPE)


def listing(spark: SparkSession, roots: str | list[str], content: bool = False) -> DataFrame:
    """path, name, folder, size, mtime (and content) of all files below roots."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    path = F.url_decode(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", ""))
    out = f.select(path.alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("m"), *(["content"] if content else []))
    out = out.withColumn("mtime", F.col("m") / 1e6).drop("m")
    return out.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))


def kind_of(name: Column) -> Column:
    """"photo" or "video" by the extension, else null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext.isin(*PHOTOS), "photo").when(ext.isin(*VIDEOS), "video")


def settled(mtime: Column, now: float | None = None) -> Column:
    """Not touched of late: it may still be copied in."""
    at = F.lit(now) if now is not None else F.unix_timestamp()
    return at - mtime >= DEFAULTS.settle_s


def media_files(files: DataFrame, roots: list[str], now: float | None = None) -> DataFrame:
    """path, root, kind, size, mtime of photos and videos that count: no hidden or system folders, no screenshots, no
    empty or fresh files; the parts of a DVD title as one."""
    root = F.coalesce(*(F.when(F.col("path").startswith(r.rstrip("/") + "/"), F.lit(r.rstrip("/"))) for r in roots))
    f = files.withColumn("root", root).where("root is not null")
    below = F.split(F.expr("substring(folder, length(root) + 2)"), "/")
    outside = F.exists(below, lambda d: d.startswith(".") | F.lower(d).isin(*SKIPPED_FOLDERS))
    f = f.where(~outside & ~F.col("name").startswith("."))
    own = f.where(~F.col("name").rlike(TITLE_FILE) & ~F.col("name").rlike(SCREENSHOT) & (F.col("size") > 0) & settled(F.col("mtime"), now))
    own = own.select("path", "root", kind_of(F.col("name")).alias("kind"), "size", "mtime").where("kind is not null")
    return own.unionByName(dvd_titles(f, now))


def dvd_titles(files: DataFrame, now: float | None = None) -> DataFrame:
    """One row for each DVD title set: size and time of its parts together; small sets are menus."""
    parts = files.where(F.col("name").rlike(TITLE_PART)).withColumn("title", F.regexp_extract("name", TITLE_PART, 1))
    sets = parts.groupBy("root", "folder", "title").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    big = sets.where((F.col("size") >= DEFAULTS.least_title_bytes) & settled(F.col("mtime"), now))
    return big.select(F.concat("folder", F.lit("/VTS_"), "title").alias("path"), "root", F.lit("video").alias("kind"), "size", "mtime")


def folder_signature(files: DataFrame) -> DataFrame:
    """(folder, signature): names, times and sizes of a tape's documents in order of name."""
    docs = files.where((F.col("name") == "tape.json") | F.col("name").rlike(r"^[0-9].*\.json$"))
    one = F.concat_ws(":", "name", F.floor("mtime").cast("long"), "size")
    return docs.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("signature"))


def file_signature(size: Column, mtime: Column, model: str) -> Column:
    return F.concat_ws(":", size, F.floor(mtime).cast("long"), F.lit(model))


def checksums(files: DataFrame) -> DataFrame:
    """(name, sha256) of files with content."""
    return files.select("name", F.sha2("content", 256).alias("sha256"))


def refresh_checksums(lines: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old lines with the new hashes of the files that were read again, and lines for new files."""
    both = lines.withColumnRenamed("sha256", "__old").join(fresh, "name", "full")
    return both.select("name", F.coalesce("sha256", "__old").alias("sha256"))


def parse_checksums(text: DataFrame) -> DataFrame:
    """(name, sha256) of lines as checksum tools write them."""
    m = r"^([0-9a-f]{64})\s+\*?(.+)$"
    return text.where(F.col("value").rlike(m)).select(F.regexp_extract("value", m, 2).alias("name"), F.regexp_extract("value", m, 1).alias("sha256"))


def new_rules(spark: SparkSession, folder: str, imported: DataFrame) -> DataFrame:
    """(file, kind, a, b) of rule files whose names were not imported before."""
    schema = "rules array<struct<kind:string,a:bigint,b:bigint>>, _corrupt string"
    raw = spark.read.schema(schema).json(f"{folder}/face_rules-*.json", multiLine=True, columnNameOfCorruptRecord="_corrupt").where("_corrupt is null")
    rows = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.inline("rules"))
    return rows.join(imported.select("file"), "file", "left_anti")


def memory_info(text: DataFrame) -> DataFrame:
    """One row of bytes from lines as "MemTotal:  123 kB"."""
    line = r"^(\w+):\s+(\d+)"
    kv = text.select(F.regexp_extract("value", line, 1).alias("k"), (F.regexp_extract("value", line, 2).try_cast("long") * 1024).alias("v"))

    def of(name: str) -> Column:
        return F.max(F.when(F.col("k") == name, F.col("v")))

    m = kv.agg(of("MemTotal").alias("total"), of("MemAvailable").alias("a"), of("MemFree").alias("free"), of("SwapTotal").alias("swap_total"), of("SwapFree").alias("swap_free"))
    used = F.greatest(F.lit(0), F.col("total") - F.coalesce("a", "free"))
    return m.select("total", used.alias("used"), F.greatest(F.lit(0), F.col("total") - F.col("free") - used).alias("buff_cache"), "free", "swap_total", F.greatest(F.lit(0), F.col("swap_total") - F.col("swap_free")).alias("swap_used"))


def cpu_shares(samples: DataFrame) -> DataFrame:
    """at, user, system, iowait, idle in per cent between samples (at, value: a line of counters "cpu  1 2 …")."""
    from pyspark.sql import Window

    n = F.transform(F.slice(F.split(F.trim("value"), r"\s+"), 2, 8), lambda x: x.cast("long"))
    order = Window.orderBy("at")  # a handful of samples of one machine
    d = samples.select("at", n.alias("n")).withColumn("b", F.lag("n").over(order)).where("b is not null").withColumn("d", F.zip_with("n", "b", lambda x, y: x - y))
    all_ = F.greatest(F.lit(1), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x))

    def share(*at: int) -> Column:
        return F.bround(100 * sum((F.coalesce(F.try_element_at("d", F.lit(i + 1)), F.lit(0)) for i in at), F.lit(0)) / all_, 1)

    return d.select("at", share(0, 1).alias("user"), share(2, 5, 6, 7).alias("system"), share(4).alias("iowait"), share(3).alias("idle"))


def music_hits(rows: DataFrame) -> DataFrame:
    """Tracks that a film can use: with a link, and no length or one to eight minutes."""
    return rows.where(F.col("url").isNotNull() & (F.col("duration_s").isNull() | F.col("duration_s").between(60, 480)))


def music_catalogue(built_in: DataFrame, fetched: DataFrame, own: DataFrame, cached: DataFrame) -> DataFrame:
    """All music in one table; ready: the file is here."""
    every = built_in.unionByName(fetched, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    here = cached.select("id", F.lit(True).alias("__h")).distinct()
    return every.join(here, "id", "left").withColumn("ready", F.coalesce("__h", F.lit(False))).drop("__h")
