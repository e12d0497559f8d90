"""Scalar functions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import dates, numbers, text


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "string", list: None}
    schema = ", ".join(f"{k} {kinds[type(v)]}" if type(v) is not list else f"{k} array<{'double' if any(isinstance(x, float) for x in v) else 'int'}>" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("IMG_20190704_123456.jpg", "2019-07-04T12:34:56"), ("VID-20190704-WA0001.mp4", "2019-07-04"), ("DSC01234.JPG", None), ("IMG_20670215_000000.jpg", None),
        ("IMG_19800101_000012.jpg", None), ("Wesele 15.08.2024", "2024-08-15"), ("PXL_20210102_235959123.jpg", "2021-01-02T23:59:59"), ("", None), (None, None),
    ],
)
def test_date_from_name(spark, name, want):
    assert one(spark, dates.date_from_name("n", 2026), n=name) == want


def test_scene_date(spark):
    def of(own=None, override=None, recorded="2004-01-02T10:00:00", valid=True, scene="0001_2004-07-11_17-42-44", fallback=None):
        cols = [F.lit(v).cast("string") for v in (own, override, recorded)]
        return one(spark, dates.scene_date(*cols, F.lit(valid), F.lit(scene), F.lit(fallback).cast("string"), 2026))

    assert of(override="2005-06-07") == "2005-06-07"
    assert of() == "2004-01-02"
    assert of(recorded="2067-02-15T22:26:25", valid=False) == "2004-07-11"
    assert of(recorded="", valid=False, scene="0001_UNKNOWN-DATE") is None
    assert of(recorded="", valid=False, scene="0001_UNKNOWN-DATE", fallback="2003-03-03") == "2003-03-03"
    assert of(own="unknown") is None and of(own="1999-09-09", override="2005-06-07") == "1999-09-09"
    assert of(recorded="1926-06-07T10:00:00", valid=False) == "2026-06-07"


@pytest.mark.parametrize(("raw", "want"), [("1926-06-07", "2026-06-07"), ("1930-01-01", "1930-01-01"), ("1985-01-01", "1985-01-01"), ("", ""), ("19x6", "19x6")])
def test_fix_century(spark, raw, want):
    assert one(spark, dates.fix_century("d", 2026), d=raw) == want


def test_scene_time(spark):
    assert one(spark, dates.scene_time(F.lit("2004-01-02T10:11:12"), F.lit(True), F.lit("x"))) == "10:11:12"
    assert one(spark, dates.scene_time(F.lit(""), F.lit(False), F.lit("0014_2004-07-11_17-42-44"))) == "17:42:44"


def test_effective(spark):
    assert one(spark, dates.effective_date("f", "t"), f="unknown", t="2004-01-02T10:11:12") is None
    assert one(spark, dates.effective_date("f", "t"), f=None, t="2004-01-02T10:11:12") == "2004-01-02"
    assert one(spark, dates.effective_time("f", "t"), f="2001-01-01", t="2004-01-02T10:11:12") is None
    assert one(spark, dates.effective_time("f", "t"), f="", t="2004-01-02T10:11:12") == "10:11:12"


def test_exif_and_container(spark):
    assert one(spark, dates.exif_date("v", 2026), v="2019:07:04 12:34:56") == "2019-07-04T12:34:56"
    assert one(spark, dates.exif_date("v", 2026), v="1980:01:01 00:00:00") is None and one(spark, dates.exif_date("v", 2026), v=None) is None
    tags = F.create_map(F.lit("Creation_Time"), F.lit("2019-07-04T10:00:00.000000Z"))
    assert one(spark, dates.container_date(tags, "Europe/Warsaw", 2026)) == "2019-07-04T12:00:00"
    own = F.create_map(F.lit("com.apple.quicktime.creationdate"), F.lit("2019-07-04 09:08:07+0200"))
    assert one(spark, dates.container_date(own, "Europe/Warsaw", 2026)) == "2019-07-04T09:08:07"


def test_utc(spark):
    assert one(spark, dates.local_to_utc("v", "Europe/Warsaw"), v="2004-07-11T17:42:44") == "2004-07-11T15:42:44.000000Z"
    assert one(spark, dates.local_to_utc("v", "No/Where"), v="2004-07-11T17:42:44") == "2004-07-11T17:42:44.000000Z"


def test_analog_and_picked(spark):
    p = "/a/Wesele 25.04.1987/skany/Skanuj0001.jpg"
    assert one(spark, dates.analog_origin("p"), p=p) and not one(spark, dates.analog_origin("p"), p="/a/b/DSC01234.JPG")
    assert one(spark, dates.analog_origin("p", F.lit("EPSON Perfection")), p="/a/b/c.jpg")
    got = one(spark, dates.pick_date(F.col("p"), F.lit("2010-01-01T00:00:00"), F.lit("exif"), F.lit(True), 2026), p="/x/Wesele 25.04.1987/skany/Skanuj0001.jpg")
    assert (got.taken, got.date_source) == ("1987-04-25", "folder")
    got = one(spark, dates.pick_date(F.col("p"), F.lit("2010-06-08T00:00:00"), F.lit("exif"), F.lit(True), 2026), p="/x/2010-06-08 Skany/a/Skanuj0001.jpg")
    assert (got.taken, got.date_source) == (None, "scan")


def test_shift_counter_bounds(spark):
    assert one(spark, dates.shift("t", F.lit(90)), t="2004-07-11T23:59:00") == "2004-07-12T00:00:30" and one(spark, dates.shift("t", F.lit(90)), t="2004-07-11") == "2004-07-11"
    assert [one(spark, dates.file_counter("n"), n=n) for n in ("DSC07359.JPG", "MOV07362.MPG", "a.jpg")] == [7359, 7362, None]
    assert [one(spark, dates.valid_bound("b"), b=b) for b in ("2006", "2006-07", "2006-07-08", "06", "2006-7")] == [True, True, True, False, False]
    assert one(spark, dates.within("d", "2006", "2006-07"), d="2006-07-31") and not one(spark, dates.within("d", "", "2006"), d=None)


def test_text(spark):
    assert one(spark, text.canonical("s"), s="  A  Dog, (running)!  ") == "a dog running"
    assert one(spark, text.slug("s"), s="Ąb c--D!") == "b-c-d"
    assert [one(spark, text.clock("s"), s=s) for s in (5, 65, 3725)] == ["0:05", "1:05", "1:02:05"]
    assert [one(spark, text.clock("s", "-", True), s=s) for s in (5, 3725)] == ["00-05", "1-02-05"]
    assert [one(spark, text.caption("d", "en"), d=d) for d in ("2006-07-08", "2006-07", "2006", "unknown", None)] == ["July 8, 2006", "July 2006", "2006", None, None]
    assert one(spark, text.caption("d", "pl"), d="2006-07-08") == "8 lipca 2006"
    assert one(spark, text.file_label("s"), s="***") == "x"
    assert text.source_kinds("dv,photo") == {"dv", "photo"} and text.source_kinds("?") == {"dv", "video", "photo"} and text.source_kinds("media") == {"video", "photo"}


def test_numbers(spark):
    assert one(spark, numbers.duration("f", "s"), f=250, s="PAL") == 10 and abs(one(spark, numbers.duration("f", "s"), f=30000, s="NTSC") - 1001) < 1e-9
    assert one(spark, numbers.frame_rate(F.lit("0/0"), F.lit("30000/1001"))) == 29.97 and one(spark, numbers.frame_rate(F.lit("90000/1"))) is None
    assert one(spark, numbers.display_width(F.lit(720), F.lit("16:15"))) == 768
    assert one(spark, numbers.keyframe_at(F.col("k"), F.lit(4.25)), k=[0.5, 4.25, 9.0]) == 4.25 and one(spark, numbers.keyframe_at(F.col("k"), F.lit(0.1)), k=[0.5]) == 0
    assert one(spark, numbers.shift_times(F.col("t"), F.lit(-2), F.lit(8.9)), t=[1, 3, 30]) == [0, 1, 8]
    assert one(spark, numbers.spread_sample(F.col("t"), 3), t=[1, 2, 3, 4, 9]) == [1, 3, 9] and one(spark, numbers.spread_sample(F.col("t"), 3), t=[2, 1]) == [1, 2]
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    assert one(spark, numbers.frontal(point(0.0, 0.0), point(42.0, 0.0), point(21.0, 9.0), F.lit(100.0))) == 1.0
    assert one(spark, numbers.error_score(F.lit(2), F.array(F.lit("a")), F.lit(None).cast("int"))) == 3
    assert [one(spark, numbers.slot(F.lit(t), F.lit(100.0), 10)) for t in (0.0, 99.9, 100.0)] == [0, 9, 9]
    assert one(spark, numbers.dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11 and one(spark, numbers.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]


def test_average_hash(spark):
    grey = [0] * 128 + [255] * 128
    assert one(spark, numbers.average_hash(F.col("g")), g=grey) == "00000000ffffffff" and one(spark, numbers.average_hash(F.col("g")), g=[7] * 256) == ""
    assert one(spark, numbers.hash_bits(F.lit("ffffffffffffffff"))) == -1 and one(spark, numbers.hash_bits(F.lit("xyz"))) is None
