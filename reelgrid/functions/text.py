"""Labels, slugs and clock formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of captions.
MONTHS_EN = "January February March April May June July August September October November December".split()
MONTHS_PL = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()
MONTHS_PL_NOM = "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(text: Column | str) -> Column:
    """Lower case without ASCII punctuation, white space squeezed."""
    bare = F.regexp_replace(F.lower(_col(text)), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def slug(text: Column | str) -> Column:
    """a-z and 0-9, everything else a single hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def file_label(text: Column | str, most: int = 40) -> Column:
    """A name that files can have, cut to most characters; "x" if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)[^\w.-]+", " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.trim(F.substring(clean, 1, most)), F.lit("")), F.lit("x"))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def clock(seconds: Column | str, mark: str = ":", pad: bool = False) -> Column:
    """m:ss or h:mm:ss; pad: mm for the minutes too. mark stands between."""
    s = _col(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    minutes = F.floor(s / 60).cast("long")
    short = F.concat(_two(minutes) if pad else minutes.cast("string"), F.lit(mark), _two(r))
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit(mark), _two(m), F.lit(mark), _two(r))).otherwise(short)


def caption(date: Column | str, lang: str = "en") -> Column:
    """A date for people, as much of it as is known; none for null and "unknown"."""
    date = _col(date)
    y, m, d = F.substring(date, 1, 4), F.substring(date, 6, 2).try_cast("int"), F.substring(date, 9, 2).try_cast("int").cast("string")

    def month(names: list[str]) -> Column:
        return F.try_element_at(F.array(*map(F.lit, names)), m)

    if lang == "pl":
        day, mon = F.concat(d, F.lit(" "), month(MONTHS_PL), F.lit(" "), y), F.concat(month(MONTHS_PL_NOM), F.lit(" "), y)
    else:
        day, mon = F.concat(month(MONTHS_EN), F.lit(" "), d, F.lit(", "), y), F.concat(month(MONTHS_EN), F.lit(" "), y)
    known = date.isNotNull() & (date != "unknown") & (date != "")
    return F.when(known & (F.length(date) >= 10), day).when(known & (F.length(date) >= 7), mon).when(known, y)


def date_range_label(first: Column, last: Column) -> Column:
    """One date, or first and last with a dash."""
    return F.when(first.isNull(), last).when(last.isNull() | (first == last), first).otherwise(F.concat(first, F.lit(" – "), last))


def scene_title(tape_id: Column, index: Column) -> Column:
    return F.concat(tape_id, F.lit(" · scena "), F.lpad(index.cast("string"), 2, "0"))


def scene_comment(tape_id: Column, index: Column, start: Column, end: Column, recorded: Column, source: Column) -> Column:
    """What a proxy's comment tag says about its scene."""
    base = F.concat(F.lit("MiniDV "), tape_id, F.lit(" · scena "), index.cast("string"), F.lit(" · TC "), F.coalesce(F.nullif(start, F.lit("")), F.lit("?")), F.lit("-"), F.coalesce(F.nullif(end, F.lit("")), F.lit("?")))
    when = F.concat(F.lit(" · nagrano "), F.replace(recorded, F.lit("T"), F.lit(" ")), F.lit(" ("), source, F.lit(")"))
    return F.concat(base, F.when(F.length(recorded) > 0, when).otherwise(""))


def token(*parts: Column) -> Column:
    """The first 12 hex digits of a hash of the joined parts."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts).cast("binary")), 1, 12)


def source_kinds(value: str | None) -> frozenset[str]:
    """'dv,photo' as a set; nothing known means all."""
    every = frozenset({"dv", "video", "photo"})
    v = (value or "all").strip().lower()
    if v == "media":
        return every - {"dv"}
    return every if v == "all" else frozenset(v.split(",")) & every or every
