"""Queries over the driver's tables: each applies an operator to a stand-in for the archive's tables, with SQL beside it.

Orders stand in for dated scenes, events for seconds and spans, customers for people, documents for albums of files and
embeddings for frame vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.functions import dates, numbers, text
from reelgrid.operators import catalog, clustering, dating, duplicates, films, intervals, people, search, state, tags, timeline, vector_blocks
from reelgrid.operators.components import connected_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- timeline ------------------------------------------------------------------------------------------------------
def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", date.alias("date"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("thumb"), F.col("o_orderkey").alias("ord"))


_ORDERS = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS thumb FROM orders)"""


@query(f"""WITH {_ORDERS}, m AS (SELECT substr(date,1,4)::INT AS year, substr(date,6,2)::INT AS month, count(*) AS count, min(thumb) AS thumb
  FROM o WHERE date IS NOT NULL GROUP BY ALL)
SELECT year, month, count, thumb FROM m UNION ALL SELECT year, NULL, sum(count)::BIGINT, min(thumb) FROM m GROUP BY year""")
def timeline_year_month(spark, sf_dir):
    """Years and months with counts and the first thumbnail."""
    return timeline.timeline(_dated_orders(spark, sf_dir))


@query(f"WITH {_ORDERS} SELECT count(*) FILTER (date IS NULL) AS undated FROM o")
def timeline_undated(spark, sf_dir):
    return timeline.undated(_dated_orders(spark, sf_dir))


def _month_items(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    scenes = o.select(F.lit("A").alias("tape_id"), F.col("o_orderkey").cast("string").alias("scene_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("time"), (F.col("o_orderkey") % 50).cast("int").alias("scene_index"))
    media = e.select(F.lit("@media").alias("tape_id"), F.col("event_id").cast("string").alias("scene_id"), F.concat(F.lit("1995-03-"), F.date_format("ts", "dd")).alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"))
    return scenes.unionByName(media, allowMissingColumns=True)


@query("""WITH i AS (SELECT 'A' AS tape_id, o_orderkey::VARCHAR AS scene_id, strftime(o_orderdate,'%Y-%m-%d') AS date, NULL::VARCHAR AS time, (o_orderkey % 50)::INT AS scene_index FROM orders
  UNION ALL SELECT '@media', event_id::VARCHAR, '1995-03-' || strftime(ts,'%d'), strftime(ts,'%H:%M:%S'), NULL FROM events)
SELECT *, row_number() OVER (ORDER BY date, coalesce(time,'99:99:99'), tape_id, coalesce(scene_index,0), scene_id) AS rank FROM i WHERE substr(date,1,7) = '1995-03'""")
def month_view(spark, sf_dir):
    """The scenes and files of one month, interleaved in time; ranked within days so that no task sorts a month."""
    m = timeline.month_items(_month_items(spark, sf_dir), 1995, 3)
    days = m.groupBy("date").agg(F.count("*").alias("n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # at most 31 rows
    days = days.select("date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = timeline.with_rank(m, ("date",), timeline.month_order())
    return ranked.join(F.broadcast(days), "date").select("tape_id", "scene_id", "date", "time", "scene_index", (F.col("rank") + F.col("before")).alias("rank"))


# ---- dates ---------------------------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN '2001-02' WHEN 2 THEN '' END AS fix, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate,'%Y-%m-%d') ELSE strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S') END AS taken FROM orders)
SELECT o_orderkey, CASE WHEN fix = 'unknown' THEN NULL WHEN fix <> '' THEN substr(fix,1,10) ELSE substr(taken,1,10) END AS date, CASE WHEN coalesce(fix,'') = '' AND length(taken) >= 19 THEN substr(taken,12,8) END AS time FROM m""")
def effective_dates(spark, sf_dir):
    """The date and time shown, with the operator's fixes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fix = F.when(k % 7 == 0, "unknown").when(k % 7 == 1, "2001-02").when(k % 7 == 2, "")
    taken = F.when(k % 5 == 0, None).when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    m = o.select("o_orderkey", fix.alias("fix"), taken.alias("taken"))
    return m.select("o_orderkey", dates.effective_date("fix", "taken").alias("date"), dates.effective_time("fix", "taken").alias("time"))


@query(f"WITH {_ORDERS} SELECT o_orderkey, date FROM o WHERE date IS NOT NULL AND date >= '1994' AND substr(date,1,7) <= '1996-06'")
def date_prefix_range(spark, sf_dir):
    """A period with partial bounds."""
    return _dated_orders(spark, sf_dir).where(dates.within("date", "1994", "1996-06")).select("o_orderkey", "date")


@query(f"WITH {_ORDERS} SELECT o_orderkey, date FROM o WHERE coalesce(date,'') >= '1997' UNION ALL SELECT o_orderkey, date FROM o WHERE substr(coalesce(date,'9999'),1,4) <= '1992'")
def film_period(spark, sf_dir):
    """Film periods: open above, then open below."""
    d = _dated_orders(spark, sf_dir).select("o_orderkey", "date")
    return d.where(dates.within_film("date", "1997")).unionByName(d.where(dates.within_film("date", None, "1992")))


@query("""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'IMG_' || strftime(o_orderdate,'%Y%m%d_%H%M%S') || '.jpg' WHEN 1 THEN 'VID-' || strftime(o_orderdate,'%Y%m%d') || '-WA0001.mp4'
    WHEN 2 THEN 'DSC0' || (o_orderkey % 10000)::VARCHAR || '.JPG' WHEN 3 THEN 'Wesele ' || strftime(o_orderdate,'%d.%m.%Y') ELSE 'IMG_19800101_000012.jpg' END AS name FROM orders)
SELECT o_orderkey, name, CASE o_orderkey % 5 WHEN 0 THEN regexp_replace(name, '^IMG_(....)(..)(..)_(..)(..)(..).*$', '\\1-\\2-\\3T\\4:\\5:\\6')
    WHEN 1 THEN regexp_replace(name, '^VID-(....)(..)(..).*$', '\\1-\\2-\\3') WHEN 3 THEN regexp_replace(name, '^Wesele (..).(..).(....)$', '\\3-\\2-\\1') END AS date FROM n""")
def date_from_name(spark, sf_dir):
    """Dates read from file names; a clock-reset default is none."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("IMG_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(k % 5 == 1, F.concat(F.lit("VID-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-WA0001.mp4")))
        .when(k % 5 == 2, F.concat(F.lit("DSC0"), (k % 10000).cast("string"), F.lit(".JPG")))
        .when(k % 5 == 3, F.concat(F.lit("Wesele "), F.date_format("o_orderdate", "dd.MM.yyyy")))
        .otherwise("IMG_19800101_000012.jpg")
    )
    return o.select("o_orderkey", name.alias("name")).withColumn("date", dates.date_from_name("name", 2026))


@query("""SELECT o_orderkey, (1900 + o_orderkey % 100)::VARCHAR || '-06-07' AS raw, CASE WHEN o_orderkey % 100 <= 27 THEN (2000 + o_orderkey % 100)::VARCHAR || '-06-07' ELSE (1900 + o_orderkey % 100)::VARCHAR || '-06-07' END AS date FROM orders""")
def century_fix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((1900 + F.col("o_orderkey") % 100).cast("string"), F.lit("-06-07")).alias("raw"))
    return o.withColumn("date", dates.fix_century("raw", 2026))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate,'%Y') WHEN 1 THEN strftime(o_orderdate,'%Y-%m') WHEN 2 THEN strftime(o_orderdate,'%Y-%m-%d') ELSE 'unknown' END AS date, o_orderdate AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date WHEN 1 THEN strftime(t,'%B %Y') WHEN 2 THEN strftime(t,'%B ') || day(t)::VARCHAR || strftime(t,', %Y') END AS caption FROM d""")
def captions(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    part = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown")
    return o.select("o_orderkey", text.caption(part).alias("caption"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate,'%Y-%m-%d') ELSE strftime(o_orderdate + to_seconds((o_orderkey % 1000)::INT), '%Y-%m-%dT%H:%M:%S') END AS taken FROM orders""")
def shifted_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    taken = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", dates.shift(taken, F.col("o_orderkey") % 1000).alias("taken"))


# ---- numbers and text ----------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_quantity / (30000.0::DOUBLE / 1001) ELSE l_quantity / 25.0::DOUBLE END AS seconds FROM lineitem")
def scene_duration(spark, sf_dir):
    standard = F.when(F.col("l_returnflag") == "N", "NTSC").otherwise("PAL")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.duration(F.col("l_quantity"), standard).alias("seconds"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 25.0::DOUBLE WHEN p_size % 4 = 1 THEN 29.97::DOUBLE WHEN p_size % 4 = 2 THEN NULL ELSE 50.0::DOUBLE END AS fps FROM part""")
def frame_rates(spark, sf_dir):
    rate = F.when(F.col("p_size") % 4 == 0, "25").when(F.col("p_size") % 4 == 1, "30000/1001").when(F.col("p_size") % 4 == 2, "0/0").otherwise("50/1")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.frame_rate(rate, F.when(F.col("p_size") % 4 == 2, "90000/1")).alias("fps"))


@query("""WITH s AS (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock FROM s""")
def clocks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.floor(F.col("value") * 100)).alias("clock"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" -- "), "p_type")).alias("slug"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS prompt FROM benchmark""")
def canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.canonical("text").alias("prompt"))


@query("SELECT o_orderkey, substr(sha1(o_orderstatus || chr(10) || o_orderpriority), 1, 12) AS token FROM orders")
def selection_tokens(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.token(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("token"))


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events""")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT c_custkey, list_sort(list_distinct([greatest(0, least(20, x)) FOR x IN [c_custkey % 9 - 4, c_custkey % 30, 7 + c_custkey % 3]]))::INT[] AS times FROM customer""")
def shifted_times(spark, sf_dir):
    k = F.col("c_custkey")
    times = F.array((k % 9 - 3).cast("int"), (k % 30 + 1).cast("int"), (8 + k % 3).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.shift_times(times, F.lit(-1), F.lit(20.7)).alias("times"))


@query("""SELECT c_custkey, coalesce(list_max([x FOR x IN [1.5::DOUBLE, 2.0, 4.25, 9.0] IF x <= (c_custkey % 10)::DOUBLE + 0.005]), 0.0)::DOUBLE AS start FROM customer""")
def keyframes(spark, sf_dir):
    frames = F.array(*map(F.lit, (1.5, 2.0, 4.25, 9.0)))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.keyframe_at(frames, (F.col("c_custkey") % 10).cast("double")).alias("start"))


@query("SELECT event_id, least(11, greatest(0, floor(value * 12 / 500.0::DOUBLE)))::INT AS slot FROM events")
def timeline_slots(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.slot(F.col("value"), F.lit(500.0), 12).alias("slot"))


# ---- people --------------------------------------------------------------------------------------------------------
def _persons(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), (F.col("c_custkey") % 11 == 0).alias("hidden"), F.col("c_mktsegment").alias("grp"))


def _tracks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("tape_id"), F.col("o_orderpriority").alias("scene_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("rq"), (F.col("o_totalprice") / 2).alias("quality"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice / 2 END AS q FROM orders),
s AS (SELECT o_custkey, count(*) AS tracks, count(DISTINCT o_orderstatus || '/' || o_orderpriority) AS scenes, first(o_orderkey ORDER BY q DESC, o_orderkey) AS cover FROM t GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, c_custkey % 11 = 0 AS hidden, c_mktsegment AS "group", coalesce(tracks,0) AS tracks, coalesce(scenes,0) AS scenes, cover,
CASE WHEN c_custkey % 11 = 0 THEN 'hidden' WHEN c_custkey % 3 = 0 THEN 'named' WHEN coalesce(scenes,0) >= 2 THEN 'often' ELSE 'rare' END AS class FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def person_summary(spark, sf_dir):
    """People with tracks, scenes, cover and class."""
    return people.person_summary(_persons(spark, sf_dir), _tracks(spark, sf_dir)).withColumn("class", people.person_class())


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def people_without_tracks(spark, sf_dir):
    return people.without_tracks(_persons(spark, sf_dir), _tracks(spark, sf_dir)).select("id")


@query("""WITH t AS (SELECT DISTINCT event_id AS id, user_id, strftime(ts,'%Y-%m-%d %H') AS hour FROM events)
SELECT DISTINCT l.id AS a, r.id AS b FROM t l JOIN t r ON l.user_id = r.user_id AND l.hour = r.hour AND l.id < r.id""")
def cannot_links(spark, sf_dir):
    """Tracks of a scene that share a second: events of a user in one hour."""
    e = table(spark, sf_dir, "events")
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)).cast("int")
    return people.cannot_links(e.select(F.lit("t").alias("tape_id"), F.col("user_id").cast("string").alias("scene_id"), F.col("event_id").alias("id"), F.array(hour, hour).alias("times")))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""WITH e AS (SELECT label, unnest({_UNIT}) AS v, unnest(range(64)) AS i FROM embeddings), s AS (SELECT label, i, sum(v) AS s FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(s * s)) AS l FROM s GROUP BY label) SELECT s.label, s.i::INT AS i, round(s / l, 9) AS v FROM s JOIN n USING (label)""")
def centroids(spark, sf_dir):
    """The mean direction of each label."""
    c = people.centroids(table(spark, sf_dir, "embeddings"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("i", "v")).withColumn("v", F.round("v", 9))


_CENTRE = f"""e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), c AS (SELECT vec_id AS centre, v AS w FROM e WHERE vec_id < 8),
s AS (SELECT vec_id, centre, list_inner_product(v, w) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(v, w) DESC, centre) AS r FROM e CROSS JOIN c),
b AS (SELECT vec_id, max(centre) FILTER (r = 1) AS centre, max(s) FILTER (r = 1) AS best, max(s) FILTER (r = 2) AS second FROM s GROUP BY vec_id)"""


def _nearest(spark, sf_dir, threshold: float, margin: float | None):
    e = table(spark, sf_dir, "embeddings")
    centres = e.where("vec_id < 8").select(F.col("vec_id").alias("centre"), F.col("embedding").alias("centroid"))
    n = people.nearest(e, centres, "vec_id", "centre", threshold, margin)
    return n.select("vec_id", "centre", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"))


@query(f"WITH {_CENTRE} SELECT vec_id, centre, round(best, 6) AS best, round(second, 6) AS second FROM b WHERE best >= 0.1")
def nearest_centroid(spark, sf_dir):
    return _nearest(spark, sf_dir, 0.1, None)


@query(f"WITH {_CENTRE} SELECT vec_id, centre, round(best, 6) AS best, round(second, 6) AS second FROM b WHERE best >= 0.1 AND best - second >= 0.05")
def top_two_margin(spark, sf_dir):
    return _nearest(spark, sf_dir, 0.1, 0.05)


# ---- albums and media ----------------------------------------------------------------------------------------------
def _media(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    taken = F.when(k % 6 != 0, F.concat((2000 + k % 9).cast("string"), F.lit("-05-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:"), F.lpad((k % 60).cast("string"), 2, "0")))
    return d.select(
        k.alias("id"), F.col("source").alias("album"), F.when(F.col("lang") == "en", "photo").otherwise("video").alias("kind"), F.when(k % 13 == 0, "new").when(k % 29 == 0, "error").otherwise("ready").alias("status"),
        taken.alias("taken"), F.when(k % 50 == 0, "unknown").alias("date_fix"), F.lit("default").alias("workspace"), F.when(k % 31 == 0, 1).alias("split"), (k % 2).cast("int").alias("playable"), (k % 3).cast("int").alias("proxy"),
    )


_MEDIA = """m AS (SELECT doc_id AS id, source AS album, CASE WHEN lang = 'en' THEN 'photo' ELSE 'video' END AS kind, CASE WHEN doc_id % 13 = 0 THEN 'new' WHEN doc_id % 29 = 0 THEN 'error' ELSE 'ready' END AS status,
  CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 6 <> 0 THEN (2000 + doc_id % 9)::VARCHAR || '-05-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date, (doc_id % 2)::INT AS playable, (doc_id % 3)::INT AS proxy FROM documents WHERE doc_id % 31 <> 0)"""


@query(f"""WITH {_MEDIA} SELECT album, count(*) AS count, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind <> 'photo') AS videos, min(date) AS date_min, max(date) AS date_max, list_slice(list_sort(list(id)), 1, 4) AS cover FROM m WHERE status = 'ready' GROUP BY album""")
def album_summary(spark, sf_dir):
    return catalog.albums(_media(spark, sf_dir))


@query(f"""WITH {_MEDIA} SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'ready' AND kind = 'photo') AS photos,
count(*) FILTER (status = 'ready' AND kind <> 'photo') AS videos, count(*) FILTER (status = 'ready' AND kind = 'video' AND playable = 0 AND proxy = 0) AS proxies_pending FROM m""")
def media_counts(spark, sf_dir):
    return catalog.media_counts(_media(spark, sf_dir))


# ---- search --------------------------------------------------------------------------------------------------------

def _days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")



@query("""WITH f AS (SELECT DISTINCT user_id, strftime(ts,'%Y-%m-%d') AS day, event_type FROM events), w AS (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2)
SELECT user_id, day FROM f SEMI JOIN w USING (event_type) GROUP BY ALL HAVING count(*) = 2""")
def all_of_tags(spark, sf_dir):
    """Scenes (a user's days) that have both wanted tags."""
    d = _days(spark, sf_dir)
    two = frozenset(r[0] for r in d.select("event_type").distinct().orderBy("event_type").limit(2).collect())
    return search.having_all(d.select("user_id", "day").distinct(), d, ["user_id", "day"], "event_type", two)


@query("""WITH f AS (SELECT DISTINCT user_id, strftime(ts,'%Y-%m-%d') AS day, event_type FROM events), w AS (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2)
SELECT DISTINCT user_id, day FROM f WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM f SEMI JOIN w USING (event_type))""")
def none_of_tags(spark, sf_dir):
    d = _days(spark, sf_dir)
    two = frozenset(r[0] for r in d.select("event_type").distinct().orderBy("event_type").limit(2).collect())
    return search.having_none(d.select("user_id", "day").distinct(), d, ["user_id", "day"], "event_type", two)


@query(f"""WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), s AS (SELECT q.vec_id AS asked, e.vec_id, list_inner_product(q.v, e.v) AS s FROM e JOIN e q ON q.vec_id % 20 = 0),
b AS (SELECT asked, max(s) AS best FROM s GROUP BY asked) SELECT asked, vec_id, round(s, 6) AS score FROM s JOIN b USING (asked) WHERE s >= greatest(0.075::DOUBLE, best - 0.035::DOUBLE)""")
def vector_search_band(spark, sf_dir):
    """Vectors within the band of the best, for every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("asked"), F.col("embedding").alias("v"))
    return search.bands_of(asked, e, "asked", "v", "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"""WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings) SELECT q.vec_id AS asked, e.vec_id, round(list_inner_product(q.v, e.v), 6) AS score FROM e JOIN e q ON q.vec_id % 20 = 0 WHERE list_inner_product(q.v, e.v) >= 0.35::DOUBLE""")
def vectors_above(spark, sf_dir):
    """All pairs of an asked vector and a vector at a threshold, from blocks of vectors that can reach it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vector_blocks.build(e, ["vec_id"], "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("asked"), F.col("embedding").alias("v"))
    found, _ = vector_blocks.above(index, asked, "asked", "v", 0.35)
    return found.select("asked", "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), s AS (SELECT e.vec_id, list_inner_product(q.v, e.v) AS s FROM e JOIN e q ON q.vec_id = (SELECT min(vec_id) FROM e))
SELECT vec_id, round(s, 6) AS score FROM s WHERE s >= greatest(0.075::DOUBLE, (SELECT max(s) FROM s) - 0.8::DOUBLE)""")
def vector_band_of_blocks(spark, sf_dir):
    """Vectors within the band of the best for one vector, without the blocks that can't come near it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.select(F.min_by("embedding", "vec_id")).first()[0]
    found, _ = vector_blocks.in_band(vector_blocks.build(e, ["vec_id"], "embedding"), list(q), 0.075, 0.8)
    return found.select("vec_id", F.round("score", 6).alias("score"))


def _catalog(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("tape_id"), F.col("o_orderkey").cast("string").alias("scene_id"), F.lit("default").alias("workspace"), F.when(F.col("o_orderkey") % 2 == 0, "dv").otherwise("photo").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("time"), F.lit(20.0).alias("duration"))


def _tag_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.select(F.col("o_orderstatus").alias("tape_id"), F.col("o_orderkey").cast("string").alias("scene_id"), F.col("l_returnflag").alias("tag"), F.col("l_linenumber").cast("double").alias("t0"), (F.col("l_linenumber") + 0.5).alias("t1"), F.col("l_discount").alias("score"))


_SEARCH = """f AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate,'%Y-%m-%d') AS date FROM orders WHERE strftime(o_orderdate,'%Y-%m-%d') >= '1995' AND strftime(o_orderdate,'%Y') <= '1995'),
k AS (SELECT DISTINCT l_orderkey, l_returnflag AS tag FROM lineitem)"""


@query(f"""WITH {_SEARCH}, h AS (SELECT * FROM f WHERE o_orderkey IN (SELECT l_orderkey FROM k WHERE tag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM k WHERE tag = 'N'))
SELECT o_orderstatus AS tape_id, o_orderkey::VARCHAR AS scene_id, date, 0.0::DOUBLE AS score, (SELECT count(*) FROM h) AS total, (SELECT list(tag ORDER BY tag) FROM k WHERE l_orderkey = o_orderkey) AS tags FROM h ORDER BY date, tape_id, scene_id LIMIT 300""")
def search_by_tags(spark, sf_dir):
    """Scenes of a year that have a tag and lack another, first 300, with the total."""
    q = search.Query(tags=frozenset({"R"}), not_tags=frozenset({"N"}), date_from="1995", date_to="1995")
    no_people = spark.createDataFrame([], "tape_id string, scene_id string, person_id long, times array<int>")
    no_frames = spark.createDataFrame([], "tape_id string, scene_id string, t double, t_end double, emb array<float>")
    found = search.search(_catalog(spark, sf_dir), no_frames, _tag_rows(spark, sf_dir), no_people, q)
    return found.select("tape_id", "scene_id", "date", "score", "total", "tags")


@query("""WITH v AS (SELECT unnest(['A','N','R','X']) AS id), k AS (SELECT DISTINCT l_orderkey, l_returnflag AS tag FROM lineitem) SELECT id, count(l_orderkey) AS count FROM v LEFT JOIN k ON tag = id GROUP BY id""")
def tag_counts(spark, sf_dir):
    """Scenes of each tag, 0 where none has it."""
    vocabulary = spark.createDataFrame([(x,) for x in "ANRX"], "id string")
    return tags.tag_counts(vocabulary, _tag_rows(spark, sf_dir), _catalog(spark, sf_dir), "default")


# ---- tags ----------------------------------------------------------------------------------------------------------
def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id < 12").select((F.col("vec_id") % 4).cast("string").alias("tag"), F.when(F.col("vec_id") < 8, "own").otherwise("rival").alias("role"), F.col("embedding").alias("vector"))
    frames = e.withColumnRenamed("embedding", "emb")
    s = tags.score_tags(frames, prompts, ["vec_id", "label"]).groupBy("vec_id", "label", "tag").agg(F.max(F.when(F.col("role") == "own", F.col("score"))).alias("score"), F.max(F.when(F.col("role") == "rival", F.col("score"))).alias("rival"))
    return s.withColumn("scene", F.floor(F.col("vec_id") / 5))


_SCORES = f"""e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), s AS (SELECT e.vec_id, e.label, (p.vec_id % 4)::VARCHAR AS tag, max(list_inner_product(e.v, p.v)) FILTER (p.vec_id < 8) AS score, max(list_inner_product(e.v, p.v)) FILTER (p.vec_id >= 8) AS rival
  FROM e JOIN e p ON p.vec_id < 12 GROUP BY ALL)"""


@query(f"WITH {_SCORES} SELECT vec_id, tag, round(score, 6) AS score, round(rival, 6) AS rival FROM s")
def tags_over_prompts(spark, sf_dir):
    """Best similarity of each frame with each tag's prompts and with its rivals."""
    return _scores(spark, sf_dir).select("vec_id", "tag", F.round("score", 6).alias("score"), F.round("rival", 6).alias("rival"))


@query(f"""WITH {_SCORES}, k AS (SELECT *, vec_id // 5 AS scene, (score >= 0.105::DOUBLE AND score - rival >= 0.005::DOUBLE)::INT AS ok FROM s)
SELECT vec_id, tag, (ok = 1 AND (score >= 0.2::DOUBLE OR sum(ok) OVER (PARTITION BY scene, tag) - ok >= 1 OR sum(ok) OVER (PARTITION BY label, tag) - ok >= 12)) AS keep FROM k""")
def distilled_tags(spark, sf_dir):
    """Which hits stay: strong ones, and those that their scene or event agrees with."""
    return tags.distill(_scores(spark, sf_dir), "scene", "label", strong=0.2, support=12).select("vec_id", "tag", "keep")


# ---- intervals -----------------------------------------------------------------------------------------------------
def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return e.select("user_id", "event_type", t.alias("t0"), (t + F.floor("value") * 60).alias("t1"), "value")


_SPANS = """s AS (SELECT user_id, event_type, floor(epoch(ts))::DOUBLE AS t0, floor(epoch(ts))::DOUBLE + floor(value) * 60 AS t1, value FROM events),
f AS (SELECT *, max(t1) OVER w AS reach FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM f),
i AS (SELECT user_id, event_type, min(t0) AS t0, max(t1) AS t1, max(value) AS value FROM g GROUP BY user_id, event_type, run)"""


def _islands(spark, sf_dir):
    return intervals.islands(_spans(spark, sf_dir), ["user_id", "event_type"], gap=3600.0, score="value", width=86400.0)


@query(f"WITH {_SPANS} SELECT * FROM i")
def islands_by_user(spark, sf_dir):
    """Spans of one user and type that overlap or nearly do."""
    return _islands(spark, sf_dir)


@query("""WITH h AS (SELECT DISTINCT user_id, (floor(epoch(ts) / 3600))::BIGINT - 460000 AS t FROM events), l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM h),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR t > p + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT user_id, min(t)::INT AS first, max(t)::INT AS last FROM g GROUP BY user_id, run""")
def second_segments(spark, sf_dir):
    """Stretches of whole numbers with pauses of up to two."""
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - 460000).cast("int")
    times = table(spark, sf_dir, "events").select("user_id", hour.alias("t")).groupBy("user_id").agg(F.collect_set("t").alias("times"))
    s = times.select("user_id", F.explode(intervals.segments(F.col("times"))).alias("s"))
    return s.select("user_id", F.element_at("s", 1).alias("first"), F.element_at("s", 2).alias("last"))


_OVERLAP = f"""WITH {_SPANS}, a AS (SELECT user_id, t0 AS a0, t1 AS a1 FROM i WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, t0 AS b0, t1 AS b1 FROM i WHERE event_type = (SELECT max(event_type) FROM events))
SELECT user_id, a0, a1, b0, b1 FROM a JOIN b USING (user_id) WHERE a0 <= b1 AND a1 >= b0"""


def _two_kinds(spark, sf_dir):
    i = _islands(spark, sf_dir)
    lo, hi = i.agg(F.min("event_type"), F.max("event_type")).first()
    return (i.where(F.col("event_type") == k).select("user_id", F.col("t0").alias(f"{n}0"), F.col("t1").alias(f"{n}1")) for k, n in ((lo, "a"), (hi, "b")))


@query(_OVERLAP)
def interval_overlap(spark, sf_dir):
    a, b = _two_kinds(spark, sf_dir)
    return intervals.overlapping(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"))


@query(_OVERLAP)
def interval_overlap_binned(spark, sf_dir):
    """The same for keys with very many intervals."""
    a, b = _two_kinds(spark, sf_dir)
    return intervals.overlapping_binned(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 6 * 3600.0)


@query(_OVERLAP)
def interval_overlap_levels(spark, sf_dir):
    """The same without a width to choose."""
    a, b = _two_kinds(spark, sf_dir)
    return intervals.overlapping_levels(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"))


@query(f"""WITH {_SPANS}, p AS (SELECT user_id, list(floor(epoch(ts))::DOUBLE) AS times FROM events GROUP BY 1) SELECT i.user_id, event_type, t0, t1 FROM i JOIN p USING (user_id) WHERE len(list_filter(times, lambda x: x BETWEEN t0 AND t1)) > 0""")
def point_in_interval(spark, sf_dir):
    t = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(t).alias("times"))
    return _islands(spark, sf_dir).join(p, "user_id").where(intervals.seen_within(F.col("times"), F.col("t0"), F.col("t1"))).select("user_id", "event_type", "t0", "t1")


@query("""SELECT user_id, event_id, coalesce(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame FROM events""")
def cumulative_offset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("frames"))
    return intervals.offsets(e, ["user_id"], "event_id", "frames", width=4096).select("user_id", "event_id", "start_frame")


@query("""WITH d AS (SELECT user_id, event_id, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, event_id, (sum(CASE WHEN t < p OR t - p > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM d""")
def recording_sessions(spark, sf_dir):
    """Recordings: a new one where time runs back or jumps."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    e = e.withColumn("tc", F.col("u") / 1e6).withColumn("fresh", F.lit(False))
    return intervals.timecode_breaks(e, ["user_id"], "event_id", "tc", "fresh", 86400.0).select("user_id", "event_id", "session")


# ---- order, dating and state ---------------------------------------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, (row_number() OVER w)::INT AS rank, row_number() OVER w = 1 AS best FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.01::DOUBLE THEN l_tax END NULLS LAST, l_quantity DESC, l_returnflag, l_linenumber)""")
def best_of_group(spark, sf_dir):
    """The best of each group: fewest errors, unknown last, then longest."""
    l = table(spark, sf_dir, "lineitem")
    m = l.select(F.col("l_orderkey").alias("group"), "l_linenumber", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("error_score"), F.col("l_quantity").alias("frame_count"), F.col("l_returnflag").alias("tape_id"), F.col("l_linenumber").alias("scene_index"), F.lit("").alias("scene_id"))
    return duplicates.rank_group(m).select(F.col("group").alias("l_orderkey"), "l_linenumber", "rank", "best")


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) SELECT o_orderkey FROM r WHERE r <= 200 OR o_orderstatus <> 'F'""")
def keep_newest(spark, sf_dir):
    """Jobs without old finished ones."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "READY").otherwise("RUNNING").alias("status"), "o_orderdate")
    return state.keep_newest(o, 200, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def next_in_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return state.next_in_queue(o, ["O"], "o_orderdate", "o_orderkey").select("o_orderkey")


@query("""SELECT user_id, last(event_type ORDER BY event_id) AS event_type, max(event_id) AS version FROM events GROUP BY user_id HAVING last(event_id ORDER BY event_id) % 4 <> 0""")
def latest_rows(spark, sf_dir):
    """What holds now, from a log with tombstones."""
    log = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("version"), (F.col("event_id") % 4 == 0).alias("deleted"))
    return state.latest(log, ["user_id"])


@query("""WITH n AS (SELECT doc_id, n_chars AS s FROM documents WHERE doc_id % 10 <> 1), k AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS s, doc_id % 11 <> 1 AS live FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(n.doc_id, k.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM n FULL JOIN k USING (doc_id) WHERE k.doc_id IS NULL OR (n.doc_id IS NULL AND live) OR n.s <> k.s""")
def changed_files(spark, sf_dir):
    """New, changed and gone files; folders that are away keep theirs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"))
    known = d.where("doc_id % 10 <> 2").withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return state.changed(d.where("doc_id % 10 <> 1"), known, "doc_id", F.col("size"), F.col("doc_id") % 11 != 1)


def _numbered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("album"), F.floor(F.col("event_id") / 4).alias("n"), (F.col("event_id") % 3 == 0).alias("known"), s.alias("s"))


_AROUND = """p AS (SELECT event_id, user_id AS album, event_id // 4 AS n, event_id % 3 = 0 AS known, floor(epoch(ts))::BIGINT AS s FROM events),
a AS (SELECT event_id, album, (SELECT max(k.s) FROM p k WHERE k.known AND k.album = p.album AND k.n = (SELECT max(x.n) FROM p x WHERE x.known AND x.album = p.album AND x.n < p.n AND p.n - x.n <= 60)) AS before,
  (SELECT min(k.s) FROM p k WHERE k.known AND k.album = p.album AND k.n = (SELECT min(x.n) FROM p x WHERE x.known AND x.album = p.album AND x.n > p.n AND x.n - p.n <= 60)) AS after FROM p)"""


@query(f"WITH {_AROUND} SELECT event_id, before, after FROM a")
def neighbours_both_sides(spark, sf_dir):
    """The nearest known value before and after, at most 60 places away."""
    return dating.neighbours(_numbered(spark, sf_dir), ("album",), "n", "known", "s", 60, width=256).select("event_id", "before", "after")


@query(f"WITH {_AROUND} SELECT event_id, strftime(make_timestamp(((before + after) // 2) * 1000000), '%Y-%m-%dT%H:%M:%S') AS taken FROM a WHERE abs(after - before) <= 36 * 3600")
def neighbour_midpoint(spark, sf_dir):
    """The middle between neighbours that are close in time."""
    p = dating.neighbours(_numbered(spark, sf_dir), ("album",), "n", "known", "s", 60, width=256)
    middle = F.floor((F.col("before") + F.col("after")) / 2).cast("long")
    return p.where(F.abs(F.col("after") - F.col("before")) <= 36 * 3600).select("event_id", F.date_format(F.timestamp_seconds(middle), "yyyy-MM-dd'T'HH:mm:ss").alias("taken"))


@query("""WITH m AS (SELECT event_id, user_id AS album, floor(epoch(ts))::BIGINT AS t, floor(epoch(ts))::BIGINT + CASE WHEN event_id % 5 < 2 THEN 20000 ELSE 60 END AS shot, event_type = (SELECT min(event_type) FROM events) AS ref FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY t, event_id) AS r, count(*) OVER (PARTITION BY album) AS n FROM m), d AS (SELECT album, t AS mid FROM r WHERE r = n // 2 + 1),
v AS (SELECT album, count(*) FILTER (ref) AS refs, count(*) FILTER (ref AND abs(t - shot) <= 5400) AS agree, count(*) AS n, count(*) FILTER (abs(t - mid) <= 600) AS near FROM m JOIN d USING (album) GROUP BY album)
SELECT album, refs, agree, round(near / n, 9) AS near_share, CASE WHEN refs >= 3 THEN agree / refs >= 0.7 ELSE n < 3 OR near / n <= 0.5 END AS trusted FROM v""")
def album_trust(spark, sf_dir):
    """Whether file times can be believed, album by album."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).first()[0]
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    shot = F.date_format(F.timestamp_seconds(t + F.when(F.col("event_id") % 5 < 2, 20000).otherwise(60)), "yyyy-MM-dd'T'HH:mm:ss")
    m = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("album"), t.alias("mtime"), shot.alias("taken"), F.when(F.col("event_type") == first, "exif").otherwise("none").alias("date_source"))
    return dating.album_trust(m).withColumn("near_share", F.round("near_share", 9))


# ---- duplicates ----------------------------------------------------------------------------------------------------
def _hashes(spark, sf_dir):
    """Hashes of the vectors' signs, and copies with up to five bits flipped for every third."""
    e = table(spark, sf_dir, "embeddings")
    mean = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x) / 64
    h = e.select("vec_id", numbers.hash_bits(numbers.bits_hash(F.col("embedding"), mean)).alias("bits"))
    flips = F.expr("aggregate(sequence(0, int(vec_id % 7)), bigint(0), (a, i) -> a | shiftleft(1L, int((vec_id * 11 + i * 9) % 64)))")
    copies = h.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.col("bits").bitwiseXOR(flips).alias("bits"))
    both = h.unionByName(copies)
    other = both.select(F.col("vec_id").alias("key"), F.lit(1).alias("position"), F.col("bits").bitwiseXOR(F.lit(0x5555)).alias("bits"))
    return both.select(F.col("vec_id").alias("key"), F.lit(0).alias("position"), "bits").unionByName(other)


_HASHES = f"""e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), m AS (SELECT vec_id, v, list_sum(v) / 64 AS mean FROM e),
h AS (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(v, lambda x: CASE WHEN x >= mean THEN 1 ELSE 0 END::HUGEINT)), lambda a, b: a * 2 + b)::UBIGINT AS bits FROM m),
c AS (SELECT vec_id, bits FROM h UNION ALL SELECT vec_id + 1000000, xor(bits, list_reduce(list_transform(range(0, vec_id % 7 + 1), lambda i: (1::UBIGINT << ((vec_id * 11 + i * 9) % 64)::UBIGINT)), lambda a, b: a | b)) FROM h WHERE vec_id % 3 = 0),
p AS (SELECT l.vec_id AS a, r.vec_id AS b FROM c l JOIN c r ON l.vec_id < r.vec_id AND bit_count(xor(l.bits, r.bits)) <= 5)"""


@query(f"WITH {_HASHES} SELECT vec_id, printf('%016x', bits) AS hash FROM h")
def average_hashes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x) / 64
    return e.select("vec_id", numbers.bits_hash(F.col("embedding"), mean).alias("hash"))


@query(f"WITH {_HASHES} SELECT a, b FROM p")
def hamming_pairs(spark, sf_dir):
    """Pairs whose hashes differ by five bits at most at both positions."""
    return duplicates.hamming_pairs(_hashes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_HASHES}, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), t AS (SELECT a AS vertex, b AS reach FROM u UNION SELECT a, a FROM u UNION SELECT t.vertex, u.b FROM t JOIN u ON t.reach = u.a)
SELECT vertex, min(reach) AS component FROM t GROUP BY vertex""")
def duplicate_components(spark, sf_dir):
    return connected_components(duplicates.hamming_edges(_hashes(spark, sf_dir)))


# ---- films ---------------------------------------------------------------------------------------------------------
def _pieces(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("film"), F.col("event_id").alias("pos"), (F.col("value") / 100 + 2).alias("d"), F.col("value").alias("score"), F.col("event_type").alias("caption"))


@query("""WITH p AS (SELECT user_id AS film, event_id AS pos, value / 100 + 2 AS d, value AS score FROM events), s AS (SELECT *, sum(d - 0.6::DOUBLE) OVER (PARTITION BY film ORDER BY score DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS t FROM p)
SELECT film, pos FROM s WHERE t + 4.0::DOUBLE <= 60""")
def budget_trim(spark, sf_dir):
    """A film without the lowest scores until it fits."""
    return films.trim_to_budget(_pieces(spark, sf_dir), ["film"], F.lit(60.0)).select("film", "pos")


@query("""WITH p AS (SELECT l_orderkey AS film, l_linenumber AS pos, l_quantity / 10 + 2 AS length, CASE WHEN l_returnflag = 'A' THEN 'photo' ELSE 'video' END AS kind, l_tax * 100 + 3 AS duration FROM lineitem),
d AS (SELECT *, greatest(2, round_even((length - 0.6::DOUBLE) / 0.5::DOUBLE, 0), 4) * 0.5::DOUBLE + 0.6::DOUBLE AS b FROM p), e AS (SELECT *, CASE WHEN kind = 'video' THEN least(b, duration) ELSE b END AS d FROM d)
SELECT film, pos, round(d, 3) AS d FROM e WHERE kind = 'photo' OR d >= 2.6::DOUBLE""")
def beat_lengths(spark, sf_dir):
    """Pieces in whole beats."""
    l = table(spark, sf_dir, "lineitem")
    p = l.select(F.col("l_orderkey").alias("film"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") / 10 + 2).alias("length"), F.when(F.col("l_returnflag") == "A", "photo").otherwise("video").alias("kind"), (F.col("l_tax") * 100 + 3).alias("duration"), F.lit(0.0).alias("start"))
    return films.fit_to_beats(p, F.lit(0.5)).select("film", "pos", F.round("d", 3).alias("d"))


@query("""SELECT user_id AS film, event_id AS pos, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN event_type END AS shown FROM events""")
def changed_captions(spark, sf_dir):
    return films.changed_captions(_pieces(spark, sf_dir), ["film"]).select("film", "pos", "shown")


@query("""WITH RECURSIVE c AS (SELECT user_id AS id, (floor(epoch(ts))::BIGINT % 20000)::DOUBLE AS t, value AS s FROM events), v AS (SELECT DISTINCT id FROM c),
b AS (SELECT id, 0 AS n, 0.0::DOUBLE AS pos FROM v UNION ALL SELECT b.id, b.n + 1, coalesce(-max({'s': c.s, 'back': -c.t}).back, b.pos + 300) FROM b LEFT JOIN c ON c.id = b.id AND c.t BETWEEN b.pos + 45 AND b.pos + 300 WHERE 20000 - b.pos > 300 GROUP BY b.id, b.n, b.pos),
k AS (SELECT id, pos FROM b WHERE n = 0 OR 20000 - pos >= 45)
SELECT id, pos AS clip_start, lead(pos, 1, 20000.0::DOUBLE) OVER (PARTITION BY id ORDER BY pos) AS clip_end FROM k""")
def planned_clips(spark, sf_dir):
    """Clips of long videos, a user's events standing for the cuts of one."""
    t = (F.unix_timestamp(F.col("ts").cast("timestamp")) % 20_000).cast("double")
    cuts = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), t.alias("t"), F.col("value").alias("strength"))
    return films.plan_clips(cuts.select("id").distinct().withColumn("duration", F.lit(20_000.0)), cuts)


@query(None)
def film_picks(spark, sf_dir):
    """Varied moments of each user's events."""
    e = table(spark, sf_dir, "events")
    m = e.select(F.col("user_id").alias("person"), F.lit("t").alias("tape_id"), (F.col("event_id") % 40).cast("string").alias("scene_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.when(F.col("event_id") % 3 == 0, "photo").otherwise("video").alias("kind"), (F.col("event_id") % 97).cast("double").alias("start"), F.lit(4.0).alias("length"), (F.col("value") / 100).alias("score"))
    return films.pick_films(m, ["person"], 50.0, seed=7)


@query(None)
def basket_moments(spark, sf_dir):
    """Moments added one by one to each user's basket."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_timestamp(F.col("ts").cast("timestamp")) % 3600).cast("double")
    return intervals.add_to_basket(e.select(F.lit("").alias("workspace"), F.col("user_id").cast("string").alias("tape_id"), F.col("event_type").alias("scene_id"), F.col("event_id").alias("seq"), start.alias("start"), (start + F.col("value")).alias("end")))


@query(None)
def assigned_people(spark, sf_dir):
    """Vectors assigned one by one to running centroids; each label is a workspace."""
    e = table(spark, sf_dir, "embeddings")
    return clustering.assign_people(e.select(F.col("label").cast("string").alias("workspace"), F.col("vec_id").alias("id"), F.col("embedding")), 0.25)


@query(None)
def clustered_tracks(spark, sf_dir):
    """Constrained clustering of each label's vectors, with rules."""
    e = table(spark, sf_dir, "embeddings")
    t = e.select(F.col("label").cast("string").alias("workspace"), F.col("vec_id").alias("id"), (F.col("vec_id") % 9).alias("person_id"), F.lit("t").alias("tape_id"), (F.col("vec_id") % 50).cast("string").alias("scene_id"), F.array((F.col("vec_id") % 7).cast("int")).alias("times"), F.col("embedding").alias("arc"), F.when(F.col("vec_id") % 4 == 0, 0.1).otherwise(0.8).alias("frontal"), F.lit(1.0).alias("rq"))
    who = e.where("vec_id < 20").select(F.col("label").cast("string").alias("workspace"), F.col("vec_id").alias("id"), F.concat(F.lit("p"), "vec_id").alias("name"), F.col("vec_id").alias("anchor"))
    said = e.where("vec_id % 10 = 0").select(F.col("label").cast("string").alias("workspace"), F.lit("same").alias("kind"), F.col("vec_id").alias("a"), (F.col("vec_id") + 10).alias("b"))
    return clustering.cluster_workspaces(t, who, said, cluster=0.15, attach=0.2)


