"""More queries over the driver's tables: dates, numbers, catalog, people, index, state and streams, with SQL beside them.

Orders stand in for scenes and tracks, customers for people, documents for files, events for jobs and moments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import dates, numbers, text
from reelgrid.operators import catalog, clustering, commits, dating, duplicates, films, frames, intervals, people, search, state, tags, timeline, vision
from reelgrid.plans.queries import _UNIT, _media, _persons, _tracks, query, table
from reelgrid.plans.scratch import materialise, new_folder
from reelgrid.sources import archive, sinks
from reelgrid.streaming import captures, jobs

def _k():
    return F.col("o_orderkey")


def _orders(spark, sf_dir, *more):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *more)


def _day(c: str = "o_orderdate", f: str = "yyyy-MM-dd"):
    return F.date_format(c, f)


# ---- dates -------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2001-05-06' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN '2002-03-04' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
CASE WHEN o_orderkey % 6 IN (2, 4) THEN strftime(o_orderdate, '%H:%M:%S') WHEN o_orderkey % 6 = 3 THEN '10:20:30' END AS time FROM orders""")
def scene_dates(spark, sf_dir):
    """A scene's date by priority: the operator's, the tape's, the camera's, that in its id, the tape's for undated ones."""
    kind, none = _k() % 6, F.lit(None).cast("string")
    own = F.when(kind == 0, "unknown").when(kind == 1, "2001-05-06")
    override = F.when(kind == 4, "2002-03-04")
    recorded = F.when(kind.isin(0, 2, 4), _day(f="yyyy-MM-dd'T'HH:mm:ss"))
    named = F.when(kind == 3, F.concat(F.lit("0001_"), _day(), F.lit("_10-20-30"))).otherwise("0001")
    fallback = F.when(kind == 5, _day())
    o = _orders(spark, sf_dir, own.alias("own"), override.alias("over"), recorded.alias("rec"), named.alias("sid"), fallback.alias("fall"), kind.isin(2, 4).alias("valid"))
    date = dates.scene_date(F.col("own"), F.coalesce("over", none), F.col("rec"), F.col("valid"), F.col("sid"), F.col("fall"), 2026)
    return o.select("o_orderkey", date.alias("date"), dates.scene_time(F.col("rec"), F.col("valid"), F.col("sid")).alias("time"))


@query("""WITH y AS (SELECT o_orderkey, 1890 + o_orderkey % 150 AS y FROM orders) SELECT o_orderkey, CASE WHEN y BETWEEN 1990 AND 2027 THEN y::VARCHAR || '-02-03' END AS device, CASE WHEN y BETWEEN 1900 AND 2027 THEN y::VARCHAR || '-02-03' END AS named FROM y""")
def sane_dates(spark, sf_dir):
    d = F.concat((F.lit(1890) + _k() % 150).cast("string"), F.lit("-02-03"))
    return _orders(spark, sf_dir, dates.sane(d, now_year=2026).alias("device"), dates.sane_name(d, 2026).alias("named"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def date_from_folders(spark, sf_dir):
    """Dates in the names of the two folders above a file."""
    p = F.when(_k() % 3 == 0, F.concat(F.lit("/m/"), _day(), F.lit(" trip/a/x.jpg"))).when(_k() % 3 == 1, F.concat(F.lit("/m/2001-01-01/"), _day(f="dd.MM.yyyy"), F.lit("/x.jpg"))).otherwise("/m/trip/x.jpg")
    return _orders(spark, sf_dir, dates.date_from_folders(p, 2026).alias("date"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS taken FROM orders""")
def exif_dates(spark, sf_dir):
    v = F.when(_k() % 3 == 0, _day(f="yyyy:MM:dd HH:mm:ss")).when(_k() % 3 == 1, F.concat(F.lit(" "), _day(f="yyyy-MM-dd'T'HH:mm:ss"), F.lit("\x00"))).otherwise("0000:00:00 00:00:00")
    return _orders(spark, sf_dir, dates.exif_date(v, 2026).alias("taken"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS taken FROM orders""")
def container_dates(spark, sf_dir):
    """A video's own date from its tags: UTC is moved to the zone, the maker's local date is not."""
    utc = F.create_map(F.lit("Creation_Time"), _day(f="yyyy-MM-dd'T'HH:mm:ss'.000000Z'"))
    own = F.create_map(F.lit("com.apple.quicktime.creationdate"), _day(f="yyyy-MM-dd'T'HH:mm:ss'+0200'"), F.lit("creation_time"), F.lit("1999-01-01T00:00:00Z"))
    none = F.create_map(F.lit("encoder"), F.lit("x"))
    return _orders(spark, sf_dir, dates.container_date(F.when(_k() % 3 == 0, utc).when(_k() % 3 == 1, own).otherwise(none), "Etc/GMT-2", 2026).alias("taken"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '2010-01-02T03:04:05' WHEN o_orderkey % 4 = 1 THEN '1985-07-08' WHEN o_orderkey % 4 = 2 THEN '2003-04-05' END AS taken,
['exif', 'name', 'name', 'scan'][1 + o_orderkey % 4] AS date_source FROM orders""")
def picked_dates(spark, sf_dir):
    """A camera's clock, a date in the name, for scans one that is much older than the scanner's clock, else none."""
    kind = _k() % 4
    path = F.when(kind == 0, "/m/a/x.jpg").when(kind == 1, "/m/skany/1985-07-08.jpg").when(kind == 2, "/m/a/2003-04-05 x.jpg").otherwise("/m/scan/x.jpg")
    device = F.when(kind.isin(0, 1, 3), "2010-01-02T03:04:05")
    p = materialise(_orders(spark, sf_dir, path.alias("path"), device.alias("device")), "paths")
    out = dates.pick_date(F.col("path"), F.col("device"), F.lit("exif"), dates.analog_origin("path", F.lit(None)), 2026)
    return p.withColumn("p", out).select("o_orderkey", "p.taken", "p.date_source")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 100 + o_orderkey % 9000 END AS n FROM orders""")
def file_counters(spark, sf_dir):
    n = (F.lit(100) + _k() % 9000).cast("string")
    name = F.when(_k() % 3 == 0, "IMG_1.JPG").when(_k() % 3 == 1, F.concat(F.lit("DSC_"), n, F.lit("a.JPG"))).otherwise(F.concat(F.lit("555_"), n, F.lit(".mp4")))
    return _orders(spark, sf_dir, dates.file_counter(name).alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000000Z') AS utc, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') AS odd FROM orders""")
def utc_clocks(spark, sf_dir):
    d = _day(f="yyyy-MM-dd'T'HH:mm:ss")
    return _orders(spark, sf_dir, dates.local_to_utc(d, "Etc/GMT-2").alias("utc"), dates.local_to_utc(d, "No/Where").alias("odd"))


@query("""WITH b AS (SELECT o_orderkey, substr(CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE strftime(o_orderdate, '%Y-%m-%d') END, 1, 1 + o_orderkey % 10) AS b FROM orders)
SELECT o_orderkey, regexp_full_match(b, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?') AS valid FROM b""")
def date_bounds(spark, sf_dir):
    """Beginnings of the orders' dates: years, months and days are bounds, what breaks off between is none."""
    text = F.when(_k() % 5 == 0, _day(f="yyyy-M-d")).otherwise(_day(f="yyyy-MM-dd"))
    return _orders(spark, sf_dir, dates.valid_bound(F.substring(text, F.lit(1), (1 + _k() % 10).cast("int"))).alias("valid"))


@query("""WITH t AS (SELECT o_orderkey, 'probe001-' || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y.%m.%d_%H-%M-%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d %H-%M-%S') ELSE 'no date' END || '.dv 12 ok' AS line FROM orders),
m AS (SELECT o_orderkey, regexp_extract(line, '([0-9]{4})[.-]([0-9]{2})[.-]([0-9]{2})[_ ]([0-9]{2})[-:]([0-9]{2})[-:]([0-9]{2})', ['y', 'o', 'd', 'h', 'm', 's']) AS x FROM t)
SELECT o_orderkey, CASE WHEN x.y <> '' THEN x.y || '-' || x.o || '-' || x.d || 'T' || x.h || ':' || x.m || ':' || x.s END AS taken FROM m""")
def probed_dates(spark, sf_dir):
    """Recording times named by a probe's output."""
    form = F.when(_k() % 4 == 0, _day(f="yyyy.MM.dd_HH-mm-ss")).when(_k() % 4 == 1, _day(f="yyyy-MM-dd HH:mm:ss")).when(_k() % 4 == 2, _day(f="yyyy.MM.dd HH-mm-ss")).otherwise("no date")
    return _orders(spark, sf_dir, dates.recorded_in(F.concat(F.lit("probe001-"), form, F.lit(".dv 12 ok"))).alias("taken"))


@query("""WITH e AS (SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS hm, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day FROM events) SELECT event_id, hm >= '03:30' AND hm < '09:30' AND event_id % 2 = 0 AS due FROM e""")
def daily_schedule(spark, sf_dir):
    """Instants at which a nightly job is due: within six hours of its local start and not yet that day."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    last = F.when(F.col("event_id") % 2 == 1, F.date_format(F.from_utc_timestamp("at", "Etc/GMT-1"), "yyyy-MM-dd"))
    return e.select("event_id", dates.due(F.col("at"), last, "03:30", dates.camera_zone("Etc/GMT-1")).alias("due"))


@query("""SELECT 'Europe/Warsaw' AS bare, 'Europe/Warsaw' AS none, 'Asia/Tokyo' AS own""")
def camera_zones(spark, sf_dir):
    return spark.range(1).select(*(F.lit(dates.camera_zone(z)).alias(n) for n, z in (("bare", "utc"), ("none", None), ("own", "Asia/Tokyo"))))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' – 2030-01-01' END AS label,
'T · scena ' || lpad((o_orderkey % 90)::VARCHAR, 2, '0') AS title, 'MiniDV T · scena ' || (o_orderkey % 90)::VARCHAR || ' · TC 00:01-?' || CASE WHEN o_orderkey % 2 = 0 THEN ' · nagrano ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' (VAUX)' ELSE '' END AS comment FROM orders""")
def scene_labels(spark, sf_dir):
    """Ranges of dates, titles and comments of scenes."""
    day = _day()
    label = text.date_range_label(F.when(_k() % 3 != 2, day), F.when(_k() % 3 == 0, day).when(_k() % 3 == 1, "2030-01-01"))
    n, rec = (_k() % 90).cast("int"), F.when(_k() % 2 == 0, _day(f="yyyy-MM-dd'T'HH:mm:ss"))
    tape = F.lit("T")
    return _orders(spark, sf_dir, label.alias("label"), text.scene_title(tape, n).alias("title"), text.scene_comment(tape, n, F.lit("00:01"), F.lit(""), rec, F.lit("VAUX")).alias("comment"))


# ---- numbers ------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, greatest(2, (round_even(p_size * 10 * CASE p_size % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 16.0::DOUBLE / 15 ELSE 1.0 END / 2, 0) * 2)::INT) AS width FROM part""")
def display_widths(spark, sf_dir):
    aspect = F.when(F.col("p_size") % 3 == 0, "0:1").when(F.col("p_size") % 3 == 1, "16:15")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.display_width(F.col("p_size") * 10, aspect).alias("width"))


@query("""SELECT p_partkey, trunc(least(4000000.0::DOUBLE, greatest(500000.0::DOUBLE, 90 * 1024 * 1024 * 8 * 0.93::DOUBLE / greatest(1.0::DOUBLE, p_retailprice) - 128000)))::INT AS bits, greatest(0.0::DOUBLE, (p_retailprice * 1e9 - 1e11) / 1.296e10) AS hours,
CASE WHEN p_size > 10 THEN 60.0::DOUBLE / (p_size - 10) * 40 END AS eta FROM part""")
def budgets(spark, sf_dir):
    """Bit rates for a size, hours of tape that fit, seconds left."""
    done = F.col("p_size") - 10
    return table(spark, sf_dir, "part").select(
        "p_partkey", numbers.share_bitrate(F.col("p_retailprice"), 90).alias("bits"), numbers.free_hours(F.col("p_retailprice") * 1e9, F.lit(1e11)).alias("hours"), numbers.eta(done, done + 40, F.lit(60.0)).alias("eta")
    )


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber % 4 + CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 2 END + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 5 END)::INT AS score, l_discount * 100 >= 6 AND l_quantity BETWEEN 18 AND 40 AS usable FROM lineitem""")
def frame_scores(spark, sf_dir):
    """Errors of scenes, and frames that are neither blank nor burnt out."""
    n = F.col("l_linenumber")
    score = numbers.error_score((n % 4).cast("int"), F.when(n % 3 != 0, F.array(F.lit("a"), F.lit("b"))), F.when(n % 2 != 0, 5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.cast("int").alias("score"), (numbers.usable_frame(F.col("l_quantity"), F.col("l_discount") * 100) & (F.col("l_quantity") <= 40)).alias("usable"))


@query("""WITH f AS (SELECT c_custkey, 20.0::DOUBLE + c_custkey % 30 AS rx, 40.0::DOUBLE AS y, 10.0::DOUBLE + c_custkey % 20 AS nx FROM customer), s AS (SELECT *, abs(rx - 10) AS apart FROM f),
q AS (SELECT c_custkey, CASE WHEN apart < 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, apart / (0.42::DOUBLE * 50))) * greatest(0.0::DOUBLE, 1 - 2 * (abs(nx - (10 + rx) / 2) / apart)) END AS facing FROM s)
SELECT c_custkey, round(facing, 9) AS facing, round(0.9::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (50.0::DOUBLE - 20) / 60)) * least(1.0::DOUBLE, (c_custkey % 100)::DOUBLE / 80) * (0.2::DOUBLE + 0.8::DOUBLE * facing), 9) AS quality FROM q""")
def face_scores(spark, sf_dir):
    """How much faces look at the camera, and how well they can be recognised."""
    k = F.col("c_custkey")

    def at(x, y):
        return F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))

    facing = numbers.frontal(at(F.lit(10), 40.0), at(F.lit(20) + k % 30, 40.0), at(F.lit(10) + k % 20, 50.0), F.lit(50.0))
    quality = numbers.view_quality(F.lit(0.9), F.lit(50.0), F.lit(60.0), k % 100, facing)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(facing, 9).alias("facing"), F.round(quality, 9).alias("quality"))


@query("""WITH t AS (SELECT c_custkey, list_sort(list_distinct([1, 5, 3, 9, 3, 20, 20 + c_custkey % 4])) AS t FROM customer) SELECT c_custkey, CASE WHEN len(t) <= 4 THEN t ELSE list_distinct([t[1], t[1 + round_even((len(t) - 1) / 3.0::DOUBLE, 0)::INT], t[1 + round_even(2 * (len(t) - 1) / 3.0::DOUBLE, 0)::INT], t[len(t)]]).list_sort() END::INT[] AS times FROM t""")
def spread_samples(spark, sf_dir):
    times = F.array(*map(F.lit, (1, 5, 3, 9, 3, 20)), (F.col("c_custkey") % 4 + 20).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.spread_sample(times, 4).alias("times"))


@query(f"""WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings) SELECT vec_id, round(list_inner_product(v, v), 6) AS dot, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, len(v)::INT AS size FROM e""")
def unit_vectors(spark, sf_dir):
    """The scan of the vectors: squared lengths, and vectors of length one."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(numbers.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"), F.round(F.element_at(numbers.unit(F.col("embedding")), 1), 6).alias("first"), F.size("embedding").alias("size"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, n_chars::VARCHAR || ':' || doc_id::VARCHAR || ':m1' AS sig FROM documents""")
def file_marks(spark, sf_dir):
    """Checksums and signatures of files."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    s = archive.checksums(d).join(d.select("name", archive.file_signature(F.col("size"), F.col("mtime"), "m1").alias("sig")), "name")
    return s.select(F.col("name").cast("long").alias("doc_id"), "sha256", "sig")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 2 = 1""")
def refreshed_checksums(spark, sf_dir):
    """A manifest of all files after half of them were read again, written as lines and read back."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    fresh = archive.checksums(d)
    lines = fresh.select(F.concat("sha256", F.lit("  "), "name").alias("value"))
    old = archive.parse_checksums(lines).select("name", F.lit("old").alias("sha256"))
    out = archive.refresh_checksums(old, fresh.where(F.col("name").cast("long") % 2 == 0))
    return out.select(F.col("name").cast("long").alias("doc_id"), "sha256")


@query("""SELECT item_id, sha1('["' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '","x"]') AS key FROM benchmark""")
def prompt_keys(spark, sf_dir):
    """What encoded prompts are kept under."""
    return table(spark, sf_dir, "benchmark").select("item_id", frames.prompt_key(F.array("text", F.lit("x"))).alias("key"))


@query("""SELECT min(item_id) AS n, coalesce(text, '') AS text FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, text FROM benchmark) GROUP BY text""")
def distinct_prompts(spark, sf_dir):
    """Every text once, where it comes first."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), "text")
    return vision.distinct_texts(b.unionByName(b.withColumn("n", F.col("n") + 1_000_000))).withColumn("text", F.coalesce("text", F.lit("")))


# ---- catalog and media ---------------------------------------------------------------------------------------------
_INDEX = """i AS (SELECT o_orderpriority AS tape_id, o_orderkey::VARCHAR AS scene_id, (o_orderkey % 500)::INT AS scene_index, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderkey FROM orders)"""


def _scenes(spark, sf_dir):
    """Scene documents and tape documents from orders."""
    none = F.lit(None)
    o = table(spark, sf_dir, "orders")
    rec = F.struct(F.when(_k() % 9 != 0, _day(f="yyyy-MM-dd'T'HH:mm:ss")).alias("datetime"), F.lit("VAUX").alias("datetime_source"), F.lit(True).alias("datetime_valid"))
    fp = F.struct(F.when(_k() % 4 == 0, _day(f="yyyy-MM-dd'T'HH:mm:ss")).otherwise("").alias("datetime"), F.col("o_custkey").cast("string").alias("tc_start"), (F.col("o_custkey") % 3).cast("string").alias("tc_end"), (_k() % 40).alias("frame_count"), none.cast("array<string>").alias("frame_hashes"))
    s = o.select(
        F.col("o_orderpriority").alias("tape_id"), _k().cast("string").alias("scene_id"), (_k() % 500).cast("int").alias("scene_index"), (_k() % 1000).alias("frame_count"), rec.alias("recording"),
        F.struct(F.lit("00:00").alias("start"), F.lit("00:09").alias("end")).alias("timecode"), F.struct(F.lit("PAL").alias("standard")).alias("video"),
        F.struct((_k() % 3).cast("int").alias("dropped_frames"), F.when(_k() % 5 == 0, F.array(F.lit("x"))).alias("source_discontinuities"), F.lit(0).alias("decode_errors"), (_k() % 3).cast("int").alias("error_score")).alias("capture"),
        fp.alias("fingerprint"), F.struct(F.struct((_k() % 1000).alias("size_compressed")).alias("archive")).alias("files"),
    )
    t = o.select(F.col("o_orderpriority").alias("tape_id")).distinct().select(
        "tape_id", F.lower("tape_id").alias("label"), none.cast("string").alias("recording_date"), none.cast("string").alias("undated_date"), none.cast("map<string,string>").alias("scene_dates"), F.lit("").alias("workspace"), F.lit(0).alias("scene_count")
    )
    return t, s


def _index(spark, sf_dir):
    return catalog.index_scenes(*_scenes(spark, sf_dir), now_year=2026)


@query(f"""WITH {_INDEX} SELECT tape_id, min(date) AS date_min, max(date) AS date_max, sum(o_orderkey % 1000)::BIGINT AS total_dv, count(*) FILTER (date IS NULL) AS undated_scenes, count(*) AS scenes FROM i GROUP BY tape_id""")
def tape_totals(spark, sf_dir):
    """Tapes with first and last date, bytes and undated scenes."""
    return catalog.tape_totals(_index(spark, sf_dir))


@query(f"""WITH {_INDEX} SELECT tape_id, scene_id, list_filter([CASE WHEN o_orderkey % 3 > 0 THEN 'dropped' END, CASE WHEN o_orderkey % 5 = 0 THEN 'discontinuity' END, CASE WHEN date IS NULL THEN 'clock' END], lambda x: x IS NOT NULL) AS flags FROM i""")
def quality_flags(spark, sf_dir):
    """What viewers of a scene are warned about."""
    return catalog.quality_flags(_index(spark, sf_dir), 2026).select("tape_id", "scene_id", "flags")


@query(f"""WITH {_INDEX}, e AS (SELECT tape_id, scene_id, CASE WHEN o_orderkey % 7 = 0 THEN '2001-01-01' ELSE date END AS date, CASE WHEN o_orderkey % 10 = 1 THEN 'own' WHEN tape_id = '1-URGENT' THEN 'new name' ELSE lower(tape_id) END AS label FROM i WHERE o_orderkey % 11 <> 0)
SELECT tape_id, scene_id, date, label FROM e""")
def edited_scenes(spark, sf_dir):
    """Scenes as the operator edited them: dates, names of tapes and scenes, scenes deleted."""
    o = table(spark, sf_dir, "orders")
    key = [F.col("o_orderpriority").alias("tape_id"), _k().cast("string").alias("scene_id")]
    edits = o.where("o_orderkey % 7 = 0").select(*key, F.lit("date").alias("name"), F.lit("2001-01-01").alias("value"))
    edits = edits.unionByName(o.where("o_orderkey % 10 = 1").select(*key, F.lit("label").alias("name"), F.lit("own").alias("value")))
    edits = edits.unionByName(o.where("o_orderkey % 11 = 0").select(*key, F.lit("deleted").alias("name"), F.lit("1").alias("value")))
    tape = spark.range(1).select(F.lit("1-URGENT").alias("tape_id"), F.lit(None).cast("string").alias("scene_id"), F.lit("label").alias("name"), F.lit("new name").alias("value"))
    return catalog.with_overlay(_index(spark, sf_dir).select("tape_id", "scene_id", "date", "label"), edits.unionByName(tape))


def _files(spark, sf_dir):
    """Media rows from documents, with every field of the archive's."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    m = _media(spark, sf_dir).withColumn("doc_id", F.col("id"))
    more = d.select("doc_id", F.concat(F.lit("f"), (k % 1000).cast("string"), F.lit(".jpg")).alias("name"), F.concat(F.lit("/m/"), F.when(k % 17 == 0, F.concat(F.lit("d/VTS_0"), (k % 9).cast("string"))).otherwise(F.concat(F.lit("f"), k.cast("string")))).alias("path"), F.when(k % 3 == 0, "exif").alias("date_source"), F.col("n_chars").cast("long").alias("size"), F.when((k % 8 == 1) & (k > 8), k - 1).alias("parent_id"), (k % 100).cast("double").alias("duration"))
    nothing = {"width": "int", "height": "int", "camera": "string", "clip_start": "double", "clip_end": "double"}
    return m.join(more, "doc_id").drop("doc_id").withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}).withColumns({"fps": F.when(F.col("id") % 7 != 0, 25.0), "reproxy": (F.col("id") % 2).cast("int")})


_FILES = """f AS (SELECT doc_id AS id, source AS album, 'f' || (doc_id % 1000)::VARCHAR || '.jpg' AS name, CASE WHEN lang = 'en' THEN 'photo' ELSE 'video' END AS kind, CASE WHEN doc_id % 13 = 0 THEN 'new' WHEN doc_id % 29 = 0 THEN 'error' ELSE 'ready' END AS status,
 CASE WHEN doc_id % 6 <> 0 THEN (2000 + doc_id % 9)::VARCHAR || '-05-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') END AS taken, doc_id % 50 = 0 AS hidden_date, doc_id % 31 = 0 AS split, (doc_id % 2)::INT AS playable, (doc_id % 3)::INT AS proxy,
 doc_id % 17 = 0 AS dvd, CASE WHEN doc_id % 8 = 1 AND doc_id > 8 THEN doc_id - 1 END AS parent_id, doc_id % 7 <> 0 AS has_fps, doc_id % 3 = 0 AS exif, (doc_id % 2)::INT AS reproxy, (doc_id % 100)::DOUBLE AS duration FROM documents)"""


@query(f"""WITH {_FILES} SELECT id, CASE WHEN NOT hidden_date THEN substr(taken, 1, 10) END AS date, CASE WHEN NOT hidden_date THEN substr(taken, 12, 8) END AS time, CASE WHEN hidden_date THEN 'fix' WHEN exif THEN 'exif' END AS date_source, playable <> 0 OR proxy = 1 AS playable, CASE WHEN has_fps THEN 25.0::DOUBLE END AS fps FROM f""")
def public_media(spark, sf_dir):
    """Files as they are shown."""
    return catalog.public_media(_files(spark, sf_dir)).select("id", "date", "time", "date_source", "playable", "fps")


@query(f"""WITH {_FILES}, a AS (SELECT id, name, CASE WHEN NOT hidden_date THEN substr(taken, 1, 10) END AS date, CASE WHEN NOT hidden_date THEN substr(taken, 12, 8) END AS time FROM f WHERE album = (SELECT min(source) FROM documents) AND status = 'ready' AND NOT split)
SELECT id, row_number() OVER (ORDER BY coalesce(date, '9999'), coalesce(time, ''), name, id) AS rank FROM a""")
def album_order(spark, sf_dir):
    """An album's files in order of date, time and name."""
    m = _files(spark, sf_dir)
    first = m.agg(F.min("album")).first()[0]
    items = catalog.album_items(m, first)
    order = [F.coalesce("date", F.lit("9999")), F.coalesce("time", F.lit("")), F.col("name"), F.col("id")]
    return timeline.with_rank(items, ("album",), order).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_FILES}, w AS (SELECT *, status = 'ready' AND kind = 'video' AS rv FROM f),
a AS (SELECT 'new' AS what, id FROM w WHERE status = 'new' UNION ALL SELECT 'proxy', id FROM w WHERE rv AND NOT split AND playable = 0 AND proxy = 0 UNION ALL SELECT 'split', id FROM w WHERE rv AND NOT split AND parent_id IS NULL UNION ALL SELECT 'fps', id FROM w WHERE rv AND NOT has_fps
UNION ALL SELECT 'undated', id FROM w WHERE status = 'ready' AND taken IS NULL AND NOT exif AND parent_id IS NULL UNION ALL SELECT 'reproxy', id FROM w WHERE rv AND reproxy = 1), r AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY id) AS r FROM a) SELECT what, id FROM r WHERE r <= 50""")
def media_backlogs(spark, sf_dir):
    """The first fifty files that wait for each step."""
    m, out = _files(spark, sf_dir), None
    for what in ("new", "proxy", "split", "fps", "undated", "reproxy"):
        rows = catalog.backlog(m, what).select(F.lit(what).alias("what"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {_FILES}, {_INDEX} SELECT tape_id, scene_id, 'dv' AS kind, date, lower(tape_id) AS label, (o_orderkey % 1000) / 25.0::DOUBLE AS duration FROM i UNION ALL
SELECT '@media', f.id::VARCHAR, CASE WHEN f.kind = 'video' AND (f.dvd OR coalesce(p.dvd, false)) THEN 'dvd' ELSE f.kind END, CASE WHEN NOT f.hidden_date THEN substr(f.taken, 1, 10) END, f.album, f.duration FROM f LEFT JOIN f p ON p.id = f.parent_id WHERE f.status = 'ready' AND NOT f.split""")
def whole_catalog(spark, sf_dir):
    """All that can be searched: scenes of tapes, and files."""
    return catalog.catalog(_index(spark, sf_dir), _files(spark, sf_dir)).select("tape_id", "scene_id", "kind", "date", "label", "duration")


@query(f"""WITH {_INDEX}, s AS (SELECT tape_id, scene_id FROM i WHERE o_orderkey % 4 <> 0) SELECT tape_id, scene_id FROM i WHERE (tape_id, scene_id) NOT IN (SELECT (tape_id, scene_id) FROM s)""")
def pending_scenes(spark, sf_dir):
    """Scenes that a model has not been run on; marks of other models do not count."""
    i = _index(spark, sf_dir).select("tape_id", "scene_id")
    done = i.withColumn("model", F.when(F.col("scene_id").cast("long") % 4 != 0, "m1").otherwise("m0"))
    return catalog.pending(i, done, "m1")


@query(f"""WITH {_INDEX} SELECT count(*) FILTER (o_orderkey % 4 <> 0) AS scanned, count(*) AS total FROM i""")
def scan_coverage(spark, sf_dir):
    i = _index(spark, sf_dir).select("tape_id", "scene_id", "workspace")
    done = i.select("tape_id", "scene_id", F.when(F.col("scene_id").cast("long") % 4 != 0, "m1").otherwise("m0").alias("model"))
    return catalog.coverage(i, done, "m1", "default")


@query("""SELECT o_orderstatus AS tape_id, (o_orderkey // 10)::VARCHAR AS scene_id, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL""")
def playlists(spark, sf_dir):
    """Valid items of a playlist, each once, where it comes first."""
    scene = F.when(_k() % 5 == 0, F.concat(F.lit("../"), _k().cast("string"))).otherwise(F.floor(_k() / 10).cast("string"))
    return catalog.playlist(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tape_id"), scene.alias("scene_id"), _k().alias("pos")))


@query(f"""WITH {_FILES} SELECT id, CASE WHEN kind = 'video' AND parent_id IS NULL AND proxy = 1 AND id % 4 = 0 THEN 1 ELSE reproxy END::INT AS reproxy FROM f""")
def reproxy_marks(spark, sf_dir):
    """Copies marked to be encoded anew."""
    m = _files(spark, sf_dir)
    return catalog.mark_reproxy(m, m.where("id % 4 = 0").select("id")).select("id", "reproxy")


@query(f"""WITH {_FILES}, n AS (SELECT count(*) AS n FROM f WHERE status = 'ready' AND kind = 'video' AND reproxy = 1) SELECT 7::BIGINT AS done, n + 7 AS total, round(7 / (n + 7), 4) AS share FROM n""")
def reproxy_progress(spark, sf_dir):
    return catalog.reproxy_progress(_files(spark, sf_dir), 7)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'TAPE' ELSE o_orderkey::VARCHAR END || CASE WHEN o_orderkey % 2 = 0 THEN '-RES' || CASE WHEN o_orderkey % 4 = 0 THEN '-STAB' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '-UP' ELSE '' END ELSE '' END AS token FROM orders""")
def build_tokens(spark, sf_dir):
    return _orders(spark, sf_dir, catalog.build_token(F.when(_k() % 3 != 0, _k().cast("string")), _k() % 2 == 0, _k() % 4 == 0, _k() % 5 == 0).alias("token"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 1 THEN 'a' || doc_id::VARCHAR ELSE NULL END AS x FROM documents WHERE doc_id % 4 <> 0""")
def workspace_rows(spark, sf_dir):
    """Rows of a workspace, with private columns left out."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k.alias("id"), F.when(k % 4 == 0, "other").when(k % 4 == 1, "").when(k % 4 == 2, "default").alias("workspace"), F.when((k % 3 != 0) & (k % 2 == 1), F.concat(F.lit("a"), k.cast("string"))).alias("x"), F.lit(1).alias("_private"))
    return catalog.public_columns(d.where(catalog.in_workspace("default"))).drop("workspace")


@query("""SELECT c_custkey, c_custkey % 3 = 0 AS dv, c_custkey % 3 <> 2 AS video FROM customer""")
def source_choices(spark, sf_dir):
    """Kinds that a choice stands for."""
    chosen = {0: text.source_kinds("all"), 1: text.source_kinds("video,photo"), 2: text.source_kinds("photo")}
    pick = F.element_at(F.array(*(F.array(*map(F.lit, sorted(chosen[i]))) for i in range(3))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_contains(pick, "dv").alias("dv"), F.array_contains(pick, "video").alias("video"))


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 1, 2) AS analog FROM orders""")
def analog_origins(spark, sf_dir):
    """Scans and tape transfers, by folder, file name or maker."""
    p = F.when(_k() % 4 == 0, "/m/Skany/x.jpg").when(_k() % 4 == 1, "/m/a/scan_0012.jpg").otherwise("/m/a/b.jpg")
    return _orders(spark, sf_dir, dates.analog_origin(p, F.when(_k() % 4 == 2, "EPSON Perfection V600")).alias("analog"))


# ---- files ----------------------------------------------------------------------------------------------------------
def _listing(spark, sf_dir):
    k = F.col("doc_id")
    kind = k % 8
    name = F.when(kind == 0, F.concat(F.lit("p"), k.cast("string"), F.lit(".JPG"))).when(kind == 1, F.concat(F.lit("v"), k.cast("string"), F.lit(".mp4"))).when(kind == 2, F.lit("Screenshot 1.png")).when(kind == 3, F.concat(F.lit(".h"), k.cast("string"), F.lit(".jpg"))).when(kind == 4, "VTS_01_1.VOB").when(kind == 5, "VTS_01_2.VOB").when(kind == 6, "notes.txt").otherwise(F.concat(F.lit("q"), k.cast("string"), F.lit(".jpg")))
    folder = F.when(kind == 7, "/m/AppData/x").when(kind.isin(4, 5), F.concat(F.lit("/m/dvd"), F.floor(k / 8).cast("string"))).otherwise(F.concat(F.lit("/m/a"), (k % 5).cast("string")))
    d = table(spark, sf_dir, "documents").select(name.alias("name"), folder.alias("folder"), F.when(kind.isin(4, 5), F.lit(12 << 20) + k).otherwise(F.when(k % 40 == 0, 0).otherwise(k + 1)).alias("size"), (k + 0.5).alias("mtime"))
    return d.withColumn("path", F.concat("folder", F.lit("/"), "name"))


_LISTING = """l AS (SELECT doc_id AS k, doc_id % 8 AS kind, doc_id + 0.5::DOUBLE AS mtime FROM documents)"""


@query(f"""WITH {_LISTING} SELECT '/m/a' || (k % 5)::VARCHAR || '/' || CASE kind WHEN 0 THEN 'p' || k::VARCHAR || '.JPG' ELSE 'v' || k::VARCHAR || '.mp4' END AS path, CASE kind WHEN 0 THEN 'photo' ELSE 'video' END AS kind, k + 1 AS size, mtime FROM l WHERE kind <= 1 AND k % 40 <> 0
UNION ALL SELECT '/m/dvd' || (k // 8)::VARCHAR || '/VTS_01', 'video', sum(12582912 + k)::BIGINT, max(mtime) FROM l WHERE kind IN (4, 5) GROUP BY k // 8 HAVING sum(12582912 + k) >= 20971520""")
def media_listing(spark, sf_dir):
    """Photos and videos of a folder tree that count, DVD titles as one."""
    return archive.media_files(_listing(spark, sf_dir), ["/m/"], now=1e9).select("path", "kind", "size", "mtime")


@query("""SELECT o_orderpriority AS folder, string_agg(k.name || ':' || k.o_orderkey::VARCHAR || ':5', ';' ORDER BY k.name || ':' || k.o_orderkey::VARCHAR || ':5') AS signature FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || '.json' ELSE 'x' END AS name FROM orders) k WHERE name <> 'x' GROUP BY 1""")
def folder_signatures(spark, sf_dir):
    """What changes when a tape's documents change."""
    f = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("folder"), F.when(_k() % 2 == 0, F.concat(_k().cast("string"), F.lit(".json"))).otherwise("x").alias("name"), (_k() + 0.25).alias("mtime"), F.lit(5).alias("size"))
    return archive.folder_signature(f)


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer""")
def documents_round_trip(spark, sf_dir):
    """Documents written as JSON, nulls kept, and read back; one that can't be read is left out."""
    d = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    path = new_folder(spark, "documents")
    sinks.write_documents(d, path)
    spark.range(1).select(F.lit('{"c_custkey": ')).coalesce(1).write.mode("append").text(path)
    raw = spark.read.schema("c_custkey long, name string, segment string, _corrupt string").json(path, columnNameOfCorruptRecord="_corrupt")
    return raw.where("_corrupt is null").drop("_corrupt")


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'u' END AS url, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 15 END AS d FROM part) SELECT id, id % 2 = 0 AS ready FROM m WHERE url IS NOT NULL AND (d IS NULL OR d BETWEEN 60 AND 480)""")
def music_list(spark, sf_dir):
    """Music that films can use, and whether its file is here."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 5 != 0, "u").alias("url"), F.when(k % 3 != 0, F.col("p_size") * 15).alias("duration_s"))
    hits = archive.music_hits(m)
    return archive.music_catalogue(hits.where("id % 3 = 0"), hits.where("id % 3 = 1"), hits.where("id % 3 = 2"), m.where("id % 2 = 0")).select("id", "ready")


@query("""SELECT 8192000::BIGINT AS total, 5120000::BIGINT AS used, 2048000::BIGINT AS buff_cache, 1024000::BIGINT AS free, 102400::BIGINT AS swap_total, 61440::BIGINT AS swap_used""")
def memory_use(spark, sf_dir):
    lines = ("MemTotal: 8000 kB", "MemFree:  1000 kB", "MemAvailable: 3000 kB", "SwapTotal: 100 kB", "SwapFree: 40 kB", "junk")
    return archive.memory_info(spark.createDataFrame([(x,) for x in lines], "value string"))


@query("""SELECT 1 AS at, 30.0::DOUBLE AS user, 10.0::DOUBLE AS system, 10.0::DOUBLE AS iowait, 50.0::DOUBLE AS idle UNION ALL SELECT 2, 100.0, 0.0, 0.0, 0.0""")
def processor_use(spark, sf_dir):
    """Shares of time between samples of counters."""
    rows = [(0, "cpu  10 0 5 100 0 0 0 0"), (1, "cpu  40 0 15 150 10 0 0 0"), (2, "cpu  50 10 15 150 10 0 0 0")]
    return archive.cpu_shares(spark.createDataFrame(rows, "at int, value string"))


# ---- duplicates ----------------------------------------------------------------------------------------------------
_SAME = """s AS (SELECT o_orderkey AS key, o_custkey AS tc, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS dt, o_orderkey % 40 AS n FROM orders),
p AS (SELECT l.key AS a, r.key AS b FROM s l JOIN s r ON l.tc = r.tc AND l.key < r.key AND (l.dt = r.dt OR abs(l.n - r.n) <= 5)),
d AS (SELECT a, b FROM p WHERE (a + b) % 7 <> 0)"""


def _pairs(spark, sf_dir):
    _, s = _scenes(spark, sf_dir)
    return duplicates.same_recording(s.select(F.col("scene_id").cast("long").alias("key"), "fingerprint"))


def _dismissed(spark, sf_dir):
    return _pairs(spark, sf_dir).where("(a + b) % 7 = 0").select(F.col("b").alias("scene_a"), F.col("a").alias("scene_b"))


@query(f"WITH {_SAME} SELECT a, b FROM p")
def same_recordings(spark, sf_dir):
    """Scenes of one camera time or timecode."""
    return _pairs(spark, sf_dir)


@query(f"WITH {_SAME} SELECT a, b FROM d")
def pairs_without_dismissed(spark, sf_dir):
    return duplicates.without_dismissed(_pairs(spark, sf_dir), _dismissed(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SAME}, u AS (SELECT a, b FROM d UNION SELECT b, a FROM d), t AS (SELECT a AS v, b AS r FROM u UNION SELECT a, a FROM u UNION SELECT t.v, u.b FROM t JOIN u ON t.r = u.a), c AS (SELECT v AS key, min(r) AS g FROM t GROUP BY v)
SELECT c.key, c.g AS "group", count(*) OVER (PARTITION BY g) AS count, (row_number() OVER (PARTITION BY g ORDER BY (c.key % 3), (c.key % 1000) DESC, o_orderpriority, c.key % 500, c.key::VARCHAR))::INT AS rank FROM c JOIN orders ON o_orderkey = c.key""")
def duplicate_groups(spark, sf_dir):
    """Groups of footage captured twice, ranked, without pairs that the operator dismissed."""
    _, s = _scenes(spark, sf_dir)
    s = s.select(F.col("scene_id").cast("long").alias("key"), "tape_id", "scene_id", "scene_index", "frame_count", F.col("capture.error_score").alias("error_score"), "fingerprint")
    return duplicates.duplicate_groups(s, _dismissed(spark, sf_dir)).select("key", "group", "count", "rank")


@query("""SELECT l.c_custkey AS scene_a, r.c_custkey AS scene_b FROM customer l JOIN customer r ON l.c_custkey < r.c_custkey WHERE l.c_nationkey = 3 AND r.c_nationkey = 3""")
def dismissed_group(spark, sf_dir):
    """Every pair of a group that the operator dismissed."""
    return duplicates.dismiss_group(table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key")))


# ---- people -----------------------------------------------------------------------------------------------------------
def _people(spark, sf_dir):
    k = F.col("id")
    return _persons(spark, sf_dir).select("id", F.lit("w").alias("workspace"), "name", "hidden", "grp", F.when(k % 4 == 0, k * 10).alias("anchor"))


def _seen(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return t.select("*", F.lit("w").alias("workspace"), F.array((F.col("id") % 20).cast("int"), (F.col("id") % 7).cast("int")).alias("times"))


_T = """t AS (SELECT o_orderkey AS id, o_custkey AS person_id, o_orderstatus AS tape_id, o_orderpriority AS scene_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice / 2 END AS q FROM orders),
an AS (SELECT c_custkey AS id, coalesce((SELECT t.id FROM t WHERE t.id = c_custkey * 10 AND t.person_id = c_custkey AND c_custkey % 4 = 0), b.best) AS anchor FROM customer LEFT JOIN (SELECT person_id, first(id ORDER BY q DESC, id) AS best FROM t GROUP BY 1) b ON b.person_id = c_custkey)"""


@query(f"WITH {_T} SELECT id, anchor FROM an")
def person_anchors(spark, sf_dir):
    """The track that stands for each person."""
    return people.anchors(_people(spark, sf_dir), _tracks(spark, sf_dir))


@query(f"""WITH {_T} SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, an.anchor FROM customer JOIN an ON an.id = c_custkey WHERE c_custkey % 3 = 0 OR c_custkey % 11 = 0""")
def touched_people(spark, sf_dir):
    """People that the operator named or hid, with their anchors."""
    p = _people(spark, sf_dir).withColumn("grp", F.lit(None).cast("string"))
    return people.touched(p, _tracks(spark, sf_dir)).select("id", "name", "anchor")


_MOVED = f"""{_T}, m AS (SELECT id AS track, person_id AS "left", 1 AS joined FROM t WHERE id % 50 = 0 AND person_id <> 1), w AS (SELECT * FROM t WHERE id NOT IN (SELECT track FROM m)),
ob AS (SELECT c_custkey AS id, coalesce((SELECT w.id FROM w WHERE w.id = c_custkey * 10 AND w.person_id = c_custkey AND c_custkey % 4 = 0), b.best) AS anchor FROM customer LEFT JOIN (SELECT person_id, first(id ORDER BY q DESC, id) AS best FROM w GROUP BY 1) b ON b.person_id = c_custkey)"""


def _moves(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    asked = t.where("id % 50 = 0 and person_id <> 1").select(F.col("id").alias("track"), F.lit(1).cast("long").alias("target"))
    return people.move_tracks(_seen(spark, sf_dir), _people(spark, sf_dir), asked)


@query(f"""WITH {_MOVED} SELECT t.id, coalesce(m.joined, t.person_id)::BIGINT AS person_id FROM t LEFT JOIN m ON m.track = t.id""")
def moved_tracks(spark, sf_dir):
    """Tracks after some were moved to another person."""
    return _moves(spark, sf_dir)[0].select("id", "person_id")


@query(f"""WITH {_MOVED} SELECT 'diff' AS kind, track AS a, anchor AS b FROM m JOIN ob ON ob.id = m.left WHERE anchor IS NOT NULL UNION ALL SELECT 'same', track, anchor FROM m JOIN ob ON ob.id = 1 WHERE anchor IS NOT NULL""")
def move_rules(spark, sf_dir):
    """The rules that these moves leave."""
    return _moves(spark, sf_dir)[1]


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey = 2 THEN 4 ELSE o_custkey END::BIGINT AS person_id FROM orders""")
def merged_tracks(spark, sf_dir):
    return people.merge_people(_tracks(spark, sf_dir), _people(spark, sf_dir), 2, 4)[0].select("id", "person_id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 4 THEN (SELECT c_name FROM customer WHERE c_custkey = 3) WHEN c_custkey % 3 = 0 THEN c_name END AS name FROM customer WHERE c_custkey <> 3""")
def merged_people(spark, sf_dir):
    """People after one was merged into another, which takes the name if it had none."""
    return people.merge_people(_tracks(spark, sf_dir), _people(spark, sf_dir), 3, 4)[1].select("id", "name")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey = 4 THEN 999999 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) ELSE o_custkey END::BIGINT AS person_id FROM orders""")
def dissolved_person(spark, sf_dir):
    return people.dissolve(_tracks(spark, sf_dir), 4, 1_000_000).select("id", F.col("person_id").cast("long").alias("person_id"))


@query("""WITH t AS (SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))) SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 OR c_custkey IN (SELECT o_custkey FROM t)""")
def people_after_drop(spark, sf_dir):
    """People that stay when scenes are forgotten."""
    scenes = spark.createDataFrame([("F", "1-URGENT"), ("F", "2-HIGH")], "tape_id string, scene_id string")
    return people.drop_tracks(_tracks(spark, sf_dir), _people(spark, sf_dir), scenes)[1].select("id")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'G' ELSE o_orderstatus END AS tape_id, count(*) AS n FROM orders GROUP BY 1""")
def renamed_tapes(spark, sf_dir):
    names = spark.createDataFrame([("F", "G")], "tape_id string, new string")
    return people.rename_tape(_tracks(spark, sf_dir), names).groupBy("tape_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_T} SELECT 'diff' AS kind, x.anchor AS a, y.anchor AS b FROM an x JOIN an y ON y.id = x.id + 1 WHERE x.id % 5 = 0 AND x.anchor IS NOT NULL AND y.anchor IS NOT NULL""")
def rejected_pairs(spark, sf_dir):
    """Rules between people that the operator says are not the same."""
    p = _people(spark, sf_dir)
    return people.reject_pairs(p.where("id % 5 = 0").select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")), p, _tracks(spark, sf_dir))


@query("""SELECT DISTINCT o_orderstatus AS tape_id, o_orderpriority AS scene_id FROM orders WHERE o_orderkey % 100 <> 7""")
def scenes_to_refine(spark, sf_dir):
    t = _tracks(spark, sf_dir).withColumn("refined", F.when(F.col("id") % 100 == 7, "m1").when(F.col("id") % 2 == 0, "m0"))
    return people.to_refine(t, "m1")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS rq, CASE WHEN o_orderkey % 3 = 0 THEN 'm1' END AS refined FROM orders""")
def refined_tracks(spark, sf_dir):
    t = _tracks(spark, sf_dir).withColumns({"arc": F.lit(None).cast("array<double>"), "frontal": F.lit(0.1), "refined": F.lit(None).cast("string")})
    new = t.where("id % 3 = 0").select("id", F.array(F.lit(1.0)).alias("arc"), F.lit(0.5).alias("rq"), F.lit(0.9).alias("frontal"))
    return people.save_refined(t, new, "m1").select("id", "rq", "refined")


@query("""WITH n AS (SELECT c_custkey * 10 AS anchor, lower(c_name) AS n FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 = 0) SELECT l.anchor AS a, r.anchor AS b FROM n l JOIN n r ON l.n <> r.n AND l.anchor < r.anchor""")
def differently_named(spark, sf_dir):
    """Anchors of people with different names."""
    return people.differently_named(_people(spark, sf_dir))


@query("""SELECT 'same' AS kind, o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey + 1 IN (SELECT o_orderkey FROM orders)""")
def live_rules(spark, sf_dir):
    """Rules whose tracks still exist."""
    t = _tracks(spark, sf_dir)
    return people.live_feedback(t.select(F.lit("same").alias("kind"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")), t).select("kind", "a", "b")


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND lower(c_name) = (SELECT lower(c_name) FROM customer WHERE c_custkey = 6) AND c_custkey <> 1 ORDER BY 1 LIMIT 1""")
def same_name(spark, sf_dir):
    name = table(spark, sf_dir, "customer").where("c_custkey = 6").first()["c_name"]
    return people.same_name(_people(spark, sf_dir), name.upper(), 1).select("id")


@query("""SELECT o_orderstatus AS tape_id, o_orderpriority AS scene_id, o_custkey AS person_id, list_sort(list_distinct(flatten(list([(o_orderkey % 20)::INT, (o_orderkey % 7)::INT])))) AS times FROM orders GROUP BY ALL""")
def seconds_of_people(spark, sf_dir):
    """The seconds that each person is seen in each scene."""
    return people.scene_people(_seen(spark, sf_dir))


@query("""SELECT o_orderstatus AS tape_id, o_orderpriority AS scene_id, list_sort(list_distinct(flatten(list([(o_orderkey % 20)::INT, (o_orderkey % 7)::INT])))) AS times, min('2000-0' || substr(o_orderpriority, 1, 1)) AS date FROM orders WHERE o_custkey = 4 AND substr(o_orderpriority, 1, 1) <> '5' GROUP BY ALL""")
def scenes_of_person(spark, sf_dir):
    """A person's scenes; those gone from the catalog are left out."""
    t = _seen(spark, sf_dir)
    cat = t.select("tape_id", "scene_id").distinct().where(~F.col("scene_id").startswith("5")).withColumns({"date": F.concat(F.lit("2000-0"), F.substring("scene_id", 1, 1)), "time": F.lit(None).cast("string")})
    return people.person_scenes(t, cat, 4).select("tape_id", "scene_id", "times", "date")


@query("""SELECT o_custkey % 10 AS "group", o_custkey AS person_id, count(*) AS n FROM orders GROUP BY ALL""")
def kept_ids(spark, sf_dir):
    """How many tracks of each new group each old person had."""
    t = _tracks(spark, sf_dir)
    return people.keep_ids(t.select((F.col("person_id") % 10).alias("group"), F.col("id").alias("track")), t)


_VIEWS = f"""v AS (SELECT label, vec_id, 1 + vec_id % 5 AS q, {_UNIT} AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id % 5 DESC, vec_id) AS r FROM embeddings),
x AS (SELECT label, i, sum(q * e[i]) AS s FROM v, range(1, 65) g(i) WHERE r <= 3 GROUP BY ALL)"""


@query(f"""WITH {_VIEWS}, n AS (SELECT label, sqrt(sum(s * s)) AS l FROM x GROUP BY label) SELECT x.label, i::INT AS i, round(s / l, 8) AS v FROM x JOIN n USING (label)""")
def templates(spark, sf_dir):
    """A face's template: its three best views, weighted by quality."""
    v = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("second"), (F.col("vec_id") % 5 + 1).cast("double").alias("quality"), "embedding")
    return people.template(v, ["label"]).select("label", F.posexplode("centroid").alias("i", "v")).select("label", (F.col("i") + 1).alias("i"), F.round("v", 8).alias("v"))


_SUGGEST = f"""tr AS (SELECT vec_id AS id, vec_id % 25 AS p, {_UNIT} AS e, vec_id % 4 <> 0 AS core FROM embeddings), an AS (SELECT p, bool_or(core) AS has FROM tr GROUP BY p),
m AS (SELECT p, list(a ORDER BY i) AS e FROM (SELECT p, i, avg(e[i]) AS a FROM tr JOIN an USING (p), range(1, 65) g(i) WHERE core OR NOT has GROUP BY p, i) GROUP BY p),
s AS (SELECT u.p AS id, n.p AS suggested, y.n_name AS name, list_inner_product(u.e, n.e) AS s FROM m u JOIN nation x ON x.n_nationkey = u.p AND x.n_regionkey >= 2 JOIN m n ON true JOIN nation y ON y.n_nationkey = n.p AND y.n_regionkey < 2 WHERE u.p % 5 <> n.p % 5),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, suggested) AS r, coalesce(lead(s) OVER (PARTITION BY id ORDER BY s DESC, suggested), -1) AS second FROM s)"""


@query(f"""WITH {_SUGGEST} SELECT id, suggested, name, round_even(s, 3) AS score FROM r WHERE r = 1 AND s >= 0.002::DOUBLE AND s - second >= 0.0005::DOUBLE""")
def name_suggestions(spark, sf_dir):
    """Who unnamed people (nations) most likely are, never whom the operator said no to."""
    e = table(spark, sf_dir, "embeddings")
    t = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 25).alias("person_id"), F.transform("embedding", lambda x: x.cast("double")).alias("arc"), F.when(F.col("vec_id") % 4 == 0, 0.1).otherwise(0.8).alias("frontal"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", F.col("n_regionkey") < 2)
    n = n.toDF("id", "n_name", "named").withColumn("fifth", F.col("id") % 5)
    p = n.select("id", F.when(F.col("named"), F.col("n_name")).alias("name"), F.lit(False).alias("hidden"))
    no = n.where("not named").select(F.col("id").alias("a"), "fifth").join(n.where("named").select(F.col("id").alias("b"), "fifth"), "fifth").select(F.lit("diff").alias("kind"), "a", "b")
    return people.suggestions(t, p, no, least=0.002, margin=0.0005)


# ---- index, frames and tags -----------------------------------------------------------------------------------------
_KNOWN = """c AS (SELECT o_orderstatus AS tape_id, o_orderkey::VARCHAR AS scene_id, ['dv', 'dvd', 'video', 'photo'][1 + o_orderkey % 4] AS kind, CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 3)::VARCHAR END AS sig, o_orderkey AS k FROM orders),
k AS (SELECT tape_id, scene_id, CASE WHEN k % 5 = 0 THEN 'old' ELSE sig END AS sig, (k % 30)::INT AS frames FROM c WHERE k % 7 <> 0 AND sig IS NOT NULL UNION ALL SELECT 'gone', c_custkey::VARCHAR, 'x', 1 FROM customer)"""


def _known(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, vision.KIND_ORDER)), (_k() % 4 + 1).cast("int"))
    c = o.select(F.col("o_orderstatus").alias("tape_id"), _k().cast("string").alias("scene_id"), kind.alias("kind"), F.when(_k() % 6 != 0, _day()).alias("date"), F.when(_k() % 13 != 0, (_k() % 3).cast("string")).alias("sig"), _k().alias("k"))
    k = c.where("k % 7 <> 0 and sig is not null").select("tape_id", "scene_id", F.when(F.col("k") % 5 == 0, "old").otherwise(F.col("sig")).alias("sig"), (F.col("k") % 30).cast("int").alias("frames"))
    left = table(spark, sf_dir, "customer").select(F.lit("gone").alias("tape_id"), F.col("c_custkey").cast("string").alias("scene_id"), F.lit("x").alias("sig"), F.lit(1).alias("frames"))
    return c.drop("k"), k.unionByName(left)


@query(f"""WITH {_KNOWN} SELECT c.tape_id, c.scene_id, row_number() OVER (ORDER BY list_position(['dv', 'dvd', 'video', 'photo'], kind), coalesce(date, '9999'), c.tape_id, c.scene_id) AS rank FROM c LEFT JOIN k USING (tape_id, scene_id) WHERE c.sig IS NOT NULL AND (k.sig IS NULL OR k.sig <> c.sig)""")
def index_work(spark, sf_dir):
    """Scenes to be read into the index, in order."""
    c, k = _known(spark, sf_dir)
    return vision.index_work(c, k).select("tape_id", "scene_id", "rank")


@query(f"""WITH {_KNOWN} SELECT tape_id, scene_id FROM k ANTI JOIN c USING (tape_id, scene_id)""")
def index_gone(spark, sf_dir):
    """Scenes of the index that the catalog has no more."""
    c, k = _known(spark, sf_dir)
    return vision.gone(k, c)


@query(f"""WITH {_KNOWN} SELECT count(*) AS scenes, coalesce(sum(frames), 0)::BIGINT AS frames FROM k""")
def index_counts(spark, sf_dir):
    return vision.index_counts(_known(spark, sf_dir)[1])


@query(f"""WITH {_KNOWN} SELECT count(*) AS scenes, coalesce(sum(frames), 0)::BIGINT AS frames, 'RUNNING' AS status, 'scan' AS stage, 3 AS done, 8 AS total, 0.375::DOUBLE AS progress FROM k""")
def index_status(spark, sf_dir):
    builds = spark.createDataFrame([("v", "RUNNING", "scan", 3, 8), ("w", "READY", "x", 1, 1)], "key string, status string, stage string, done int, total int")
    return vision.status(_known(spark, sf_dir)[1], builds, "v")


@query("""SELECT o_orderstatus AS tape_id, o_orderpriority AS scene_id, count(*) AS n, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END)::BIGINT AS fresh FROM orders WHERE o_orderpriority NOT LIKE '2%' GROUP BY ALL""")
def replaced_scenes(spark, sf_dir):
    """Rows of scenes that were read again, over the old ones; other scenes of the tape stay."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tape_id"), F.col("o_orderpriority").alias("scene_id"), F.lit(0).alias("fresh"))
    new = old.where("scene_id like '1%'").withColumn("fresh", F.lit(1))
    scenes = old.where("scene_id like '1%' or scene_id like '2%'").select("tape_id", "scene_id")
    return vision.replace_scenes(old, new, scenes).groupBy("tape_id", "scene_id").agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@query("""SELECT o_custkey, min(o_orderkey) AS i, (floor(o_totalprice / 50000))::INT AS second FROM orders WHERE o_totalprice / 1000 >= 40 GROUP BY o_custkey, floor(o_totalprice / 50000)""")
def sharp_frames(spark, sf_dir):
    """The first sharp frame of each second."""
    f = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 50000).cast("int").alias("second"), _k().alias("i"), (F.col("o_totalprice") / 1000).alias("sharpness"))
    return frames.sharp_frames(f, ["o_custkey"]).select("o_custkey", "second", "i")


@query("""WITH s AS (SELECT DISTINCT c_custkey, unnest([c_custkey % 5, 7]) AS s FROM customer) SELECT c_custkey, n AS frame FROM s, range(0, 300) g(n) WHERE n >= s * 25 AND n < (s + 1) * 25 AND n % 3 = 0""")
def frames_of_seconds(spark, sf_dir):
    """Numbers of the frames of the seconds asked for."""
    s = table(spark, sf_dir, "customer").select("c_custkey", F.array((F.col("c_custkey") % 5).cast("int"), F.lit(7)).alias("times"))
    return frames.frame_numbers(s, ["c_custkey"], 25.0, 3)


@query(f"""WITH d AS (SELECT vec_id, label, vec_id % 6 AS sec, {_UNIT} AS v FROM embeddings), p AS (SELECT a.vec_id AS detection, b.vec_id AS track, list_inner_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS r
FROM d a JOIN d b ON a.label = b.label AND b.vec_id % 10 = 0 AND abs(a.sec - b.sec) <= 1 WHERE list_inner_product(a.v, b.v) >= 0.25::DOUBLE) SELECT detection, track, round(s, 6) AS similarity FROM p WHERE r = 1""")
def nearest_tracks(spark, sf_dir):
    """The most similar track seen within a second of each detection."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("t").alias("tape_id"), F.col("label").cast("string").alias("scene_id"), (F.col("vec_id") % 6).cast("int").alias("second"), "embedding")
    tracks = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("track"), "tape_id", "scene_id", F.array("second").alias("times"), "embedding")
    got = frames.nearest_track(e.withColumnRenamed("vec_id", "detection"), tracks)
    return got.select("detection", "track", F.round("similarity", 6).alias("similarity"))


@query("""SELECT c_custkey, [0]::INT[] AS times FROM customer""")
def photo_faces(spark, sf_dir):
    """Faces of photos: tracks at second 0."""
    return frames.second_zero(table(spark, sf_dir, "customer").select("c_custkey"))


@query("""WITH k AS (SELECT event_type AS cat, user_id AS id, count(*) AS count FROM events GROUP BY ALL) SELECT cat, id, count, (row_number() OVER (PARTITION BY cat ORDER BY count DESC, id))::INT AS rank FROM k""")
def tags_by_category(spark, sf_dir):
    """Tags of each category, the most frequent first."""
    return tags.tags_by_category(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cat"), F.col("user_id").alias("id")).agg(F.count("*").alias("count")))


_HITS = """h AS (SELECT user_id, event_type AS tag, floor(epoch(ts))::DOUBLE AS t, floor(epoch(ts))::DOUBLE + 60 AS t_end, value AS score FROM events WHERE value >= 10),
f AS (SELECT *, max(t_end) OVER (PARTITION BY user_id, tag ORDER BY t, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR t - reach > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, tag ORDER BY t, t_end ROWS UNBOUNDED PRECEDING) AS run FROM f)"""


@query(f"WITH {_HITS} SELECT user_id, tag, min(t) AS t, max(t_end) AS t_end, max(score) AS score FROM g GROUP BY user_id, tag, run")
def tag_runs(spark, sf_dir):
    """Runs of frames of a tag above a threshold."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    h = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"), t.alias("t"), (t + 60).alias("t_end"), F.col("value").alias("score"))
    return tags.tag_runs(h, ["user_id"], gap=7200.0, threshold=10.0)


@query("""WITH p AS (SELECT o_orderstatus AS tape_id, o_orderpriority AS scene_id, o_custkey AS person_id, sum(2) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tape_id, scene_id ORDER BY n DESC, person_id) AS r FROM p) SELECT tape_id, scene_id, list(person_id ORDER BY r) AS people FROM r WHERE r <= 8 GROUP BY ALL""")
def people_of_scenes(spark, sf_dir):
    """The eight people seen longest in each scene."""
    t = _tracks(spark, sf_dir).select("tape_id", "scene_id", "person_id", F.array(F.lit(1), F.lit(2)).alias("times"))
    return search.top_people(t.groupBy("tape_id", "scene_id", "person_id").agg(F.flatten(F.collect_list("times")).alias("times")))


@query("""WITH x AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey::VARCHAR AS scene_id, [[(k % 50)::DOUBLE, (k % 50 + 1)::DOUBLE]] AS moments FROM x WHERE o_custkey % 2 = 1 AND o_custkey % 5 <> 0""")
def search_by_people(spark, sf_dir):
    """Scenes with a person and without another, and the moments that the person is seen."""
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(F.lit("t").alias("tape_id"), F.col("o_custkey").cast("string").alias("scene_id"), "o_custkey", "k")
    x = materialise(x, "scenes")
    cat = x.select("tape_id", "scene_id", F.lit("default").alias("workspace"), F.lit("dv").alias("kind"), F.lit("2000-01-01").alias("date"), F.lit(None).cast("string").alias("time"), F.lit(99.0).alias("duration"))
    who = x.select("tape_id", "scene_id", (F.col("o_custkey") % 2).alias("person_id"), F.array((F.col("k") % 50).cast("int")).alias("times"))
    who = who.unionByName(x.where("o_custkey % 5 = 0").select("tape_id", "scene_id", F.lit(9).cast("long").alias("person_id"), F.array(F.lit(1)).alias("times")))
    no = spark.createDataFrame([], "tape_id string, scene_id string, t double, t_end double, emb array<float>")
    none = spark.createDataFrame([], "tape_id string, scene_id string, tag string, t0 double, t1 double, score double")
    q = search.Query(with_people=frozenset({1}), without_people=frozenset({9}), limit=1_000_000)
    return search.search(cat, no, none, who, q).select("scene_id", "moments")


@query("""SELECT o_orderkey FROM orders WHERE false""")
def search_for_nothing(spark, sf_dir):
    """A search that asks nothing lists nothing."""
    cat = _orders(spark, sf_dir, F.lit("t").alias("tape_id"), _k().cast("string").alias("scene_id"), F.lit("default").alias("workspace"), F.lit("dv").alias("kind"), F.lit("2000-01-01").alias("date"), F.lit(None).cast("string").alias("time"), F.lit(9.0).alias("duration"))
    no = spark.createDataFrame([], "tape_id string, scene_id string, t double, t_end double, emb array<float>")
    none = spark.createDataFrame([], "tape_id string, scene_id string, tag string, t0 double, t1 double, score double")
    who = spark.createDataFrame([], "tape_id string, scene_id string, person_id long, times array<int>")
    return search.search(cat, no, none, who, search.Query()).select("o_orderkey")


# ---- state ------------------------------------------------------------------------------------------------------------
def _jobs(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "RUNNING", "READY", "ERROR", "CAPTURING"))), (k % 5 + 1).cast("int"))
    return e.select(k.cast("string").alias("tape_id"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), k.alias("k"))


_JOBS = """j AS (SELECT event_id::VARCHAR AS tape_id, ['QUEUED', 'RUNNING', 'READY', 'ERROR', 'CAPTURING'][1 + event_id % 5] AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS updated_at, event_id AS k FROM events)"""


@query(f"WITH {_JOBS} SELECT tape_id FROM j ORDER BY status IN ('CAPTURING') DESC, updated_at DESC, tape_id LIMIT 1")
def current_job(spark, sf_dir):
    return state.current_job(_jobs(spark, sf_dir), ["CAPTURING"]).select("tape_id")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS tape_id, floor(epoch(ts))::BIGINT AS ms, event_type IN ('view', 'error', 'click') AS blank FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY tape_id ORDER BY ms, blank) AS k FROM e),
s AS (SELECT tape_id, k, ms AS start, ms AS last, ms AS content, 1 AS frames, blank::INT AS blanks, 0 AS run FROM r WHERE k = 1
  UNION ALL SELECT tape_id, rk, CASE WHEN o THEN ms ELSE start END, ms, CASE WHEN o OR NOT blank THEN ms ELSE content END, CASE WHEN o THEN 1 ELSE frames + 1 END, CASE WHEN o THEN blank::INT ELSE blanks + blank::INT END, run + o::INT
  FROM (SELECT s.*, r.ms, r.blank, r.k AS rk, r.ms > least(start + 600000, last + 45000, content + 120000) AS o FROM s JOIN r ON r.tape_id = s.tape_id AND r.k = s.k + 1) r),
f AS (SELECT tape_id, run, arg_max({'a': start, 'l': last, 'c': content, 'f': frames, 'b': blanks}, k) AS v FROM s GROUP BY ALL)
SELECT tape_id, v.a AS start_ms, least(v.a + 600000, v.l + 45000, v.c + 120000) AS end_ms, v.f::BIGINT AS frames, v.b::BIGINT AS blank,
  CASE least(v.a + 600000, v.l + 45000, v.c + 120000) WHEN v.a + 600000 THEN 'longest' WHEN v.l + 45000 THEN 'no signal' ELSE 'blank' END AS reason FROM f""")
def ended_captures(spark, sf_dir):
    """Captures of each user's events as signal, a thousand times as fast, ended by silence, blank frames or length; a
    last row of another tape moves the watermark past all of them."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("tape_id"), F.timestamp_millis(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("ts"), F.col("event_type").isin("view", "error", "click").alias("blank"))
    last = spark.range(1).select(F.lit("~").alias("tape_id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(False).alias("blank"))
    folder, own = new_folder(spark, "captures"), captures.stateful(spark)
    rows.unionByName(last).write.parquet(f"{folder}/in")
    stream, shards = own.readStream.schema(rows.schema).parquet(f"{folder}/in"), 1 + e.count() // 20_000
    captures.drained(captures.captures(stream, rules=captures.EndRules(longest=600), shards=shards), folder)
    out = spark.read.schema(captures.ENDED).parquet(f"{folder}/out")
    return out.select("tape_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "frames", "blank", "reason")


@query(None)
def streamed_people(spark, sf_dir):
    """The people of assigned_people from a stream of three batches."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("workspace"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    folder, own = new_folder(spark, "people"), captures.stateful(spark)
    cuts = [0, *e.approxQuantile("id", [0.3, 0.6], 0.01), float("inf")]
    for lo, hi in zip(cuts, cuts[1:]):
        e.where((F.col("id") >= lo) & (F.col("id") < hi)).write.mode("append").parquet(f"{folder}/in")
        captures.drained(jobs.assign_stream(own.readStream.schema(e.schema).parquet(f"{folder}/in"), 0.25), folder)
    return spark.read.schema("workspace string, id long, person int").parquet(f"{folder}/out")


@query("""WITH r AS (SELECT event_id::VARCHAR AS key, event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id::VARCHAR) AS k FROM events)
SELECT key, kind, CASE WHEN k > 2 THEN 'QUEUED' WHEN k = 2 THEN 'READY' ELSE 'RUNNING' END AS status, CASE k WHEN 1 THEN 'c' WHEN 2 THEN 'b' END AS owner, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INT AS attempt FROM r""")
def claimed_jobs(spark, sf_dir):
    """A queue of events: of each kind worker a takes the first and lets it run out, b takes the second and ends it, and
    c takes over the first; a's late end is refused."""
    e = table(spark, sf_dir, "events")
    jobs = commits.jobs_table(spark, new_folder(spark, "jobs"))
    rows = e.select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("kind"), F.lit("QUEUED").alias("status"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("queued_at"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("expires"), F.lit(0).alias("attempt"))
    jobs.commit(jobs.snapshot(), rows)
    for kind in sorted(r.kind for r in rows.select("kind").distinct().collect()):  # a few kinds
        first = commits.claim(jobs, kind, "a", 0, 10)
        commits.finish(jobs, commits.claim(jobs, kind, "b", 5, 10), "b")
        commits.claim(jobs, kind, "c", 20, 10)
        commits.finish(jobs, first, "a")
    return jobs.rows().select("key", "kind", "status", "owner", "attempt")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE o_custkey + 2 END WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END AS person_id FROM orders""")
def reassigned_after_edit(spark, sf_dir):
    """Tracks (orders) that a bulk assignment wants to move: refused when the operator edited people since it was worked
    out, applied when it was worked out anew."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.lit("s").alias("scene"), F.col("o_custkey").cast("long").alias("person_id"))
    t = commits.CommitLog(spark, new_folder(spark, "tracks"), "id long, scene string, person_id long", ["id"])
    t.commit(t.snapshot(), o)
    seen = t.snapshot().marks.get("people", 0)
    t.change(lambda rows, _: rows.where("id % 5 = 0").withColumn("person_id", F.lit(0).cast("long")), bump="people")
    moved = lambda k, n: t.rows().where(F.col("id") % k == 0).withColumn("person_id", F.col("person_id") + n)
    commits.apply_if_unedited(t, "people", seen, moved(3, 1))
    commits.apply_if_unedited(t, "people", seen + 1, moved(7, 2))
    return t.rows().select("id", "person_id")


@query(f"WITH {_JOBS} SELECT tape_id FROM j WHERE status IN ('QUEUED', 'RUNNING', 'CAPTURING')")
def busy_tapes(spark, sf_dir):
    """Tapes that a job is at work on."""
    j = _jobs(spark, sf_dir)
    return state.busy(j.select("tape_id"), j, j.where("false"))


@query(f"WITH {_JOBS} SELECT tape_id, CASE WHEN status IN ('RUNNING', 'CAPTURING') THEN 'INTERRUPTED' ELSE status END AS status FROM j")
def recovered_jobs(spark, sf_dir):
    """Jobs after a crash."""
    return state.recover(_jobs(spark, sf_dir), ["RUNNING", "CAPTURING"]).select("tape_id", "status")


@query(f"WITH {_JOBS} SELECT tape_id FROM j WHERE status IN ('READY', 'ERROR') AND updated_at < '2024-01-10'")
def aged_jobs(spark, sf_dir):
    """Finished jobs older than a day."""
    return state.older_than(_jobs(spark, sf_dir), "2024-01-10").select("tape_id")


@query(f"WITH {_JOBS} SELECT tape_id FROM j WHERE NOT (k % 2 = 0 AND status <> 'RUNNING')")
def guarded_delete(spark, sf_dir):
    """Jobs after half were deleted; running ones stay."""
    j = _jobs(spark, sf_dir)
    return state.without_running(j, j.where("k % 2 = 0"), "tape_id").select("tape_id")


@query(f"""WITH {_JOBS} SELECT tape_id AS key, CASE WHEN k % 3 = 0 THEN 'READY' ELSE 'RUNNING' END AS status, k % 4 = 0 AND k % 3 <> 0 AS cancel FROM j WHERE k % 2 = 0 UNION ALL SELECT tape_id, 'OLD', k % 4 = 0 FROM j WHERE k % 2 <> 0""")
def merged_builds(spark, sf_dir):
    """Builds written again; a cancellation asked for meanwhile stays while they are active."""
    j, k = _jobs(spark, sf_dir), F.col("k")
    old = j.select(F.col("tape_id").alias("key"), F.lit("OLD").alias("status"), (k % 4 == 0).alias("cancel"))
    new = j.where("k % 2 = 0").select(F.col("tape_id").alias("key"), F.when(k % 3 == 0, "READY").otherwise("RUNNING").alias("status"), F.lit(False).alias("cancel"))
    return state.merge_builds(old, new)


@query("""SELECT user_id::VARCHAR AS tape_id, last(event_type ORDER BY ts, event_id) AS state, count(*) AS steps FROM events GROUP BY 1""")
def job_states(spark, sf_dir):
    """Each job's last event and the length of its history."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("tape_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit("x").alias("log"))
    return state.job_state(e).select("tape_id", "state", "steps")


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0""")
def inserted_rows(spark, sf_dir):
    """Rows added where their key was missing."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    old = c.where("c_custkey % 3 = 0")
    return old.unionByName(state.insert_missing(old, c.where("c_custkey % 2 = 0").unionByName(c.where("c_custkey % 4 = 0")), ["c_custkey"]))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_custkey % 5 <> 0""")
def upserted_rows(spark, sf_dir):
    """A table after rows were written over and others deleted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    log = c.select("k", F.lit("old").alias("v"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
    log = state.upsert(log, c.where("k % 2 = 0").withColumn("v", F.lit("new")), 2)
    return state.latest(state.delete(log, c.where("k % 5 = 0"), 3), ["k"]).select("k", "v")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v, 'kept' AS run FROM customer UNION ALL SELECT c_custkey, 'old', 'refused' FROM customer""")
def guarded_writes(spark, sf_dir):
    """Rows written if nothing was edited since they were planned, and refused if so."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    marks = spark.createDataFrame([("gen", "4"), ("x", "1")], "k string, v string")
    new = c.where("k % 2 = 0").withColumn("v", F.lit("new"))
    good, bad = (state.replace_if(c, new, ["k"], marks, "gen", seen) for seen in (4, 3))
    return good.withColumn("run", F.lit("kept")).unionByName(bad.withColumn("run", F.lit("refused")))


@query("""SELECT 'gen' AS k, '5' AS v""")
def bumped_counter(spark, sf_dir):
    return state.bump(spark.createDataFrame([("gen", "4"), ("x", "1")], "k string, v string"), "gen")


@query("""SELECT 'default' AS name UNION ALL SELECT DISTINCT c_mktsegment FROM customer""")
def workspace_names(spark, sf_dir):
    """Workspaces, the implicit one among them."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(spark.range(1).select(F.lit("default").alias("name")))
    return state.workspaces(stored)


@query("""SELECT max(regexp_extract(c_name, '(\\d+)$', 1)::BIGINT) + 1 AS next FROM customer""")
def next_suffixes(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(state.next_suffix(F.col("c_name")).alias("next"))


@query(f"""WITH {_FILES}, a AS (SELECT id FROM f WHERE id % 10 = 0) SELECT id FROM a UNION SELECT id FROM f WHERE parent_id IN (SELECT id FROM a)""")
def files_with_clips(spark, sf_dir):
    """Files and the clips cut from them."""
    m = _files(spark, sf_dir)
    return state.with_children(m.where("id % 10 = 0").select("id"), m)


@query(f"""WITH {_FILES}, u AS (SELECT id FROM f WHERE album = (SELECT min(source) FROM documents) AND taken IS NULL AND NOT hidden_date AND parent_id IS NULL)
SELECT id, CASE WHEN id IN (SELECT id FROM u) OR parent_id IN (SELECT id FROM u) THEN '1999' WHEN hidden_date THEN 'unknown' END AS date_fix FROM f""")
def album_dates(spark, sf_dir):
    """The operator's date for an album's undated files and their clips."""
    m = _files(spark, sf_dir)
    return state.set_album_date(m, m.agg(F.min("album")).first()[0], "1999").select("id", "date_fix")


@query("""SELECT doc_id AS path FROM documents WHERE doc_id % 10 = 1 OR doc_id % 7 = 0 OR (doc_id % 5 = 0)""")
def files_seen_again(spark, sf_dir):
    """Files to read anew: new, of another size, or touched."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k.alias("path"), F.col("n_chars").cast("long").alias("size"), (k * 10).cast("double").alias("mtime"))
    known = d.where("path % 10 <> 1").withColumns({"size": F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")), "mtime": F.when(F.col("path") % 5 == 0, F.col("mtime") - 3).otherwise(F.col("mtime") + 0.5)})
    return state.seen_again(d, known).select("path")


@query("""SELECT c_custkey AS k, 'a' AS run FROM customer""")
def imported_once(spark, sf_dir):
    """Rows of an import, and none where it was marked before."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    marks = spark.createDataFrame([("b", "1")], "k string, v string")
    return state.import_once(c, marks, "a").withColumn("run", F.lit("a")).unionByName(state.import_once(c, marks, "b").withColumn("run", F.lit("b")))


# ---- films and basket -----------------------------------------------------------------------------------------------
@query("""SELECT user_id AS id, count(*) AS n, round(sum(value / 100 + 2) + 4.0::DOUBLE - 0.6::DOUBLE * count(*), 6) AS length FROM events GROUP BY 1""")
def film_lengths(spark, sf_dir):
    """Lengths of films: pieces, cross-fades and the end card."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("value") / 100 + 2).alias("d"))
    return e.groupBy("id").agg(F.count("*").alias("n"), F.round(films.total_length(), 6).alias("length"))


@query("""SELECT DISTINCT user_id AS tape_id, event_type AS scene_id, floor(value / 5)::BIGINT AS bucket FROM events""")
def used_moments(spark, sf_dir):
    """What earlier films used, in steps of five seconds."""
    return films.used_moments(table(spark, sf_dir, "events").select(F.col("user_id").alias("tape_id"), F.col("event_type").alias("scene_id"), F.col("value").alias("start")))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT year(o_orderdate)) > 1 THEN 4 WHEN count(DISTINCT strftime(o_orderdate, '%Y-%m')) > 1 THEN 7 ELSE 10 END::INT AS size FROM orders GROUP BY 1""")
def film_periods(spark, sf_dir):
    """What a film's dates are parted by: years, months or days."""
    o = table(spark, sf_dir, "orders").select("o_custkey", _day().alias("date"))
    return o.groupBy("o_custkey").agg(films.period_length(F.col("date")).alias("size"))


_MOMENTS = """q AS (SELECT o_orderstatus AS tape_id, max(o_totalprice) AS q FROM orders GROUP BY 1), s AS (SELECT e.event_id, e.event_id % 3 = 0 AS photo, ['F', 'O', 'P', 'X'][1 + e.event_id % 4] AS tape_id, 5.0::DOUBLE + e.event_id % 60 AS dur, e.event_id % 40 AS a, e.event_id % 40 + e.event_id % 5 AS b FROM events e)"""


@query(f"""WITH {_MOMENTS}, m AS (SELECT event_id, photo, dur, coalesce(q, 0) AS q, a, b, CASE WHEN NOT photo THEN least(7.5::DOUBLE, greatest(3.5::DOUBLE, b - a + 3.0::DOUBLE), dur) ELSE 3.2::DOUBLE END AS length FROM s LEFT JOIN q USING (tape_id) WHERE photo OR dur >= 2.6)
SELECT event_id::VARCHAR AS scene_id, CASE WHEN photo THEN 0.0::DOUBLE ELSE round_even(least(greatest(0.0::DOUBLE, (a + b + 1) / 2 - length / 2), greatest(0.0::DOUBLE, dur - length)), 2) END AS start, CASE WHEN photo THEN length ELSE round_even(length, 2) END AS length,
round(q * CASE WHEN photo THEN 0.85::DOUBLE ELSE sqrt(least(1.0::DOUBLE, (b - a + 1) / 4.0::DOUBLE)) END, 6) AS score FROM m""")
def film_candidates(spark, sf_dir):
    """Moments that a person's film can use."""
    k = F.col("event_id")
    tape = F.element_at(F.array(*map(F.lit, "FOPX")), (k % 4 + 1).cast("int"))
    a = (k % 40).cast("int")
    s = table(spark, sf_dir, "events").select(
        tape.alias("tape_id"), k.cast("string").alias("scene_id"), F.when(k % 3 == 0, "photo").otherwise("dv").alias("kind"), F.lit("2001-01-01").alias("date"), F.lit(None).cast("string").alias("time"),
        F.lit("/p").alias("path"), (F.lit(5.0) + k % 60).alias("duration"), F.array(F.array(a, a + (k % 5).cast("int"))).alias("segments"),
    )
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("tape_id")).agg(F.max("o_totalprice").alias("quality"))
    q = s.select("tape_id", "scene_id").distinct().join(best, "tape_id")
    return films.candidates(s, q).select("scene_id", "start", "length", F.round("score", 6).alias("score"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id % 5 > 1 THEN 'QUEUED' ELSE ['QUEUED', 'RUNNING', 'READY', 'ERROR', 'CAPTURING'][1 + event_id % 5] END AS status, CASE WHEN event_id % 3 = 0 AND event_id % 5 > 1 THEN 'new' ELSE 'old' END AS music, CASE WHEN event_id % 3 = 0 AND event_id % 5 > 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS progress FROM events""")
def films_with_music(spark, sf_dir):
    """Films given other music; those being made are left alone."""
    j = _jobs(spark, sf_dir).select(F.col("k").alias("id"), "status", F.lit("old").alias("music"), F.lit(1.0).alias("progress"), F.lit(None).cast("string").alias("error"))
    return films.with_music(j, j.where("id % 3 = 0").select("id", F.lit("new").alias("track"))).select("id", "status", "music", "progress")


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END::INT AS pieces FROM events WHERE user_id = (SELECT min(user_id) FROM events)""")
def films_of_person(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("person_id"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("plan"), F.lit("/p").alias("path"))
    return films.films_of(stored, e.agg(F.min("user_id")).first()[0]).select("id", "pieces")


@query("""SELECT event_id AS id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 = 0)""")
def basket_removed(spark, sf_dir):
    """The baskets after moments of one were removed."""
    k = F.col("event_id")
    b = table(spark, sf_dir, "events").select(F.when(k % 2 == 0, "w").otherwise("x").alias("workspace"), k.alias("id"))
    return intervals.remove_from_basket(b, "w", b.where("id % 3 = 0").select("id")).select("id")


@query("""SELECT event_id AS id FROM events WHERE event_id % 2 = 0""")
def basket_of_workspace(spark, sf_dir):
    k = F.col("event_id")
    return intervals.basket(table(spark, sf_dir, "events").select(F.when(k % 2 == 0, "w").otherwise("x").alias("workspace"), k.alias("id")), "w").select("id")


@query("""WITH b AS (SELECT event_id AS id, event_id % 300 AS scene, event_id % 20 AS s, event_id % 20 + 3 AS e FROM events),
c AS (SELECT o_custkey AS scene, strftime(min(o_orderdate), '%Y-%m-%d') AS date, max(o_orderkey % 20)::DOUBLE AS length FROM orders GROUP BY 1), w AS (SELECT c_custkey AS scene, c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT b.id, c.scene IS NULL AS missing, coalesce(c.date, '') AS data, greatest(0, s - 1)::DOUBLE AS lo, CASE WHEN c.length > 0 THEN least(c.length, e + 1) ELSE e + 1 END::DOUBLE AS hi, w.name FROM b LEFT JOIN c USING (scene) LEFT JOIN w ON w.scene = c.scene)
SELECT id, missing, data, printf('%.1f', lo) AS "od [s]", printf('%.1f', hi) AS "do [s]", CASE WHEN lo <= 5 AND hi >= 5 THEN coalesce(name, '') ELSE '' END AS osoby FROM m""")
def basket_rows(spark, sf_dir):
    """The basket's list: moments (events) widened, with who is seen; scenes (customers' orders) that have gone are marked."""
    k = F.col("event_id")
    b = table(spark, sf_dir, "events").select(F.lit("w").alias("workspace"), F.lit("t").alias("tape_id"), (k % 300).cast("string").alias("scene_id"), k.alias("id"), (k % 20).cast("double").alias("start"), (k % 20 + 3).cast("double").alias("end"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("scene_id")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date"), F.max(F.col("o_orderkey") % 20).cast("double").alias("duration"))
    cat = o.select(F.lit("t").alias("tape_id"), "scene_id", F.lit("dv").alias("kind"), "date", F.lit("10:00:00").alias("time"), F.lit("l").alias("label"), F.lit(None).cast("string").alias("name"), "duration")
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("scene_id"), F.col("c_mktsegment").alias("name"))
    who = c.join(o, "scene_id", "left_semi").select(F.lit("t").alias("tape_id"), "scene_id", "name", F.array(F.lit(5)).alias("times"))
    none = spark.createDataFrame([], "tape_id string, scene_id string, tag string, t0 double, t1 double")
    return sinks.basket_list(b, cat, who, none).select("id", "missing", "data", "od [s]", "do [s]", "osoby")


# ---- dating ------------------------------------------------------------------------------------------------------------
@query(f"""WITH {_FILES} SELECT id, CASE WHEN id % 4 = 1 THEN '1985-07-08' END AS taken, CASE WHEN id % 4 = 1 THEN 'name' ELSE 'scan' END AS date_source FROM f WHERE status = 'ready' AND parent_id IS NULL AND NOT hidden_date AND id % 4 IN (1, 3)""")
def redated_scans(spark, sf_dir):
    """Scans whose date should come from their name, not the scanner's clock."""
    kind = F.col("id") % 4
    path = F.when(kind == 1, "/m/skany/1985-07-08.jpg").when(kind == 3, "/m/scan/x.jpg").otherwise("/m/a/x.jpg")
    m = _files(spark, sf_dir).withColumns({"path": path, "taken": F.lit("2010-01-02T03:04:05"), "date_source": F.lit("exif")})
    return dating.redate_scans(materialise(m, "scans"), 2026).select("id", "taken", "date_source")


# ---- streams ------------------------------------------------------------------------------------------------------------
def _streamed(spark, sf_dir, change, name: str, mode: str = "complete"):
    """A stream over the events until all that is there is done, its last result read back."""
    stored = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parquet*")
    root = new_folder(spark, name)
    out = change(stream)

    def save(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/rows")

    run = out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def streamed_hours(spark, sf_dir):
    """Events of each type and hour, counted as a stream."""
    def change(s):
        return jobs.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "event_type")

    return _streamed(spark, sf_dir, change, "hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH d AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p, event_id % 7 = 0 AS blank FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 45 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT user_id::VARCHAR AS tape_id, min(ts) AS start, max(ts) + INTERVAL 45 MINUTE AS "end", count(*) AS frames, count(*) FILTER (blank) AS blank FROM g GROUP BY user_id, run""")
def streamed_sessions(spark, sf_dir):
    """Captures that end when nothing comes for a while, as a stream."""
    def change(s):
        signal = s.select(F.col("user_id").cast("string").alias("tape_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7 == 0).alias("blank"))
        return jobs.capture_sessions(signal, "45 minutes")

    out = _streamed(spark, sf_dir, change, "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""SELECT event_id FROM events WHERE event_id % 3 <> 0""")
def streamed_files(spark, sf_dir):
    """Files that have settled, as a stream."""
    def change(s):
        fresh = F.unix_timestamp(F.current_timestamp()) + 1_000_000
        return jobs.settled_files(s.select("event_id", F.when(F.col("event_id") % 3 == 0, fresh).otherwise(0).alias("mtime"))).select("event_id")

    return _streamed(spark, sf_dir, change, "files", "append")


@query(None)
def scene_tracks(spark, sf_dir):
    """Tracks of each scene, built face by face; each label is a scene."""
    e = table(spark, sf_dir, "embeddings")
    f = e.select(F.lit("t").alias("tape_id"), F.col("label").cast("string").alias("scene_id"), F.floor(F.col("vec_id") / 2).cast("int").alias("second"), (F.col("vec_id") % 2).cast("int").alias("detection"), F.col("embedding"), F.lit(1.0).alias("quality"))
    return clustering.scene_tracks(f, 0.3).select("tape_id", "scene_id", "track", "times", "quality")


# ---- logs and sound ----------------------------------------------------------------------------------------------
@query("""WITH l AS (SELECT user_id, event_id, event_type, abs(value)::DECIMAL(18, 2)::DOUBLE AS x FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL),
p AS (SELECT user_id, event_type, x, lag(event_type) OVER w AS before, lag(x) OVER w AS t FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, t, x AS strength FROM p WHERE event_type = 'click' AND before = 'view'""")
def logged_cuts(spark, sf_dir):
    """Cuts from a detector's log: views stand in for lines with a time, clicks for scores, other events for other lines."""
    x = F.abs("value").cast("decimal(18,2)").cast("string")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("frame:7 pts:9 pts_time:"), x)).when(F.col("event_type") == "click", F.concat(F.lit("lavfi.scene_score="), x)).otherwise(F.concat(F.lit("size="), x))
    return films.shot_cuts(table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")), "user_id", "line", "event_id")


@query("""WITH w AS (SELECT vec_id, vec_id / 10.0::DOUBLE AS near, list_transform(range(0, len(embedding) // 4), lambda i: list_sum(list_transform(embedding[i * 4 + 1 : i * 4 + 4], lambda x: x::DOUBLE * x::DOUBLE))) AS p FROM embeddings)
SELECT vec_id, CASE WHEN len(p) < 3 THEN near ELSE round(greatest(0::DOUBLE, near - 0.8::DOUBLE) + (list_position(p, list_min(p)) - 1) * 0.04::DOUBLE, 3) END AS quiet FROM w""")
def quiet_starts(spark, sf_dir):
    """Where sound is quietest near a cut: vectors stand in for samples, a hundred a second."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", films.quiet_start(F.col("embedding"), F.col("vec_id") / F.lit(10.0), 0.8, 100).alias("quiet"))
