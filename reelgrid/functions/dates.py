"""Recording dates and times as Column expressions. Dates stay text: a date may be partial ("2006")."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the archive's formats.
SANE_DATE = r"^(19[89]\d|20[0-2]\d)-\d\d-\d\d$"
SANE_TIME = r"^\d\d-\d\d-\d\d$"
NAME_YMD = (
    r"(?<!\d)((?:19|20)\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])"
    r"(?:[ _T-]?([01]\d|2[0-3])[-_.:h]?([0-5]\d)(?:[-_.:m]?([0-5]\d)\d{0,3})?)?(?!\d)"
)
NAME_DMY = r"(?<!\d)(0[1-9]|[12]\d|3[01])[.\-_](0[1-9]|1[0-2])[.\-_]((?:19|20)\d{2})(?!\d)"
CLOCK_RESETS = ("1970-01-01", "1980-01-01", "1904-01-01")
ANALOG_WORDS = (
    "skan skany skanow skanów skanowane skanowanie zeskanowane scan scans scanned scanning vhs svhs hi8 video8 8mm super8 betamax grab graby "
    "digitalizacja zdigitalizowane negatyw negatywy negative negatives slajd slajdy slide slides odbitki kaseta kasety vhsrip"
).split()
ANALOG_NAME = r"(?i)^(scan|skan|skanuj|scanimage|scanned|img_scan)[\W_]*\d*$"
SCANNER = r"(?i)scan|canoscan|perfection|coolscan|plustek|reflecta|photomyne|vuescan|silverfast|pic ?scanner|photoscan|epson"
BOUND = r"^\d{4}(-\d{2}(-\d{2})?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f names it: plans stay as small as they are written."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _year(iso: Column) -> Column:
    """The first four characters as a number; null unless all are digits."""
    return F.when(iso.rlike(r"^\d{4}"), F.substring(iso, 1, 4).cast("int"))


def plausible_year(now_year: int | None = None) -> Column:
    """The last year that a recording may have: next year, to be slack with clocks ahead."""
    return (F.lit(now_year) if now_year else F.year(F.current_date())) + 1


def fix_century(date: Column | str, now_year: int | None = None) -> Column:
    """A year from 1900 to 1979 of a two-digit clock is a century later, where that is plausible."""
    date = _col(date)
    later = _year(date) + 100
    fits = _year(date).between(1900, 1979) & (later <= plausible_year(now_year))
    return F.when(fits, F.concat(later.cast("string"), F.substring(date, 5, 1 << 20))).otherwise(date)


def sane_date(date: Column) -> Column:
    return F.when(date.rlike(SANE_DATE), date)


def scene_date(own: Column, override: Column, recorded: Column, valid: Column, scene_id: Column, fallback: Column, now_year: int | None = None) -> Column:
    """A scene's date: the operator's for it ("unknown" hides it), the tape's, the camera's, that in the scene id, the
    tape's for undatable scenes."""
    raw = F.coalesce(F.substring(recorded, 1, 10), F.lit(""))
    fixed = fix_century(raw, now_year)
    camera = F.when(F.coalesce(valid, F.lit(False)) | (fixed != raw), sane_date(fixed))
    named = sane_date(fix_century(F.substring(F.coalesce(scene_id, F.lit("")), 6, 10), now_year))
    found = F.coalesce(sane_date(own), sane_date(override), camera, named, sane_date(fallback))
    return F.when(own.eqNullSafe(F.lit("unknown")), F.lit(None).cast("string")).otherwise(found)


def scene_time(recorded: Column, valid: Column, scene_id: Column) -> Column:
    """A scene's time of day: the camera's, else that in the scene id."""
    stamp = F.substring(scene_id, 17, 8)
    camera = F.when(F.coalesce(valid, F.lit(False)) & (F.length(recorded) >= 19), F.substring(recorded, 12, 8))
    return F.coalesce(camera, F.when(stamp.rlike(SANE_TIME), F.translate(stamp, "-", ":")))


def sane(iso: Column | str, least: int = 1990, now_year: int | None = None) -> Column:
    """A device's date, unless its clock was reset or runs ahead."""
    iso = _col(iso)
    return F.when((F.length(iso) >= 10) & _year(iso).between(F.lit(least), plausible_year(now_year)), iso)


def sane_name(iso: Column, now_year: int | None = None) -> Column:
    """A date that somebody gave in a name; it can be old, but not the default of a dead clock."""
    return _bound(iso, lambda d: F.when(~F.substring(d, 1, 10).isin(*CLOCK_RESETS), sane(d, 1900, now_year)))


def date_from_name(name: Column | str, now_year: int | None = None) -> Column:
    """YYYY-MM-DD or YYYY-MM-DDTHH:MM:SS read from a name; year first beats day first."""
    name = _col(name)
    y, mo, d, h, mi, s = (F.regexp_extract(name, NAME_YMD, k) for k in range(1, 7))
    clock = F.when(h != "", F.concat(F.lit("T"), h, F.lit(":"), mi, F.lit(":"), F.when(s != "", s).otherwise("00"))).otherwise("")
    first = F.concat(y, F.lit("-"), mo, F.lit("-"), d, clock)
    d2, m2, y2 = (F.regexp_extract(name, NAME_DMY, k) for k in (1, 2, 3))
    return F.when(y != "", sane_name(first, now_year)).when(y2 != "", sane_name(F.concat_ws("-", y2, m2, d2), now_year))


def _part(path: Column, from_end: int) -> Column:
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.lit(-from_end))


def date_from_folders(path: Column | str, now_year: int | None = None) -> Column:
    """A date in the names of the two folders above a file, the nearer first."""
    path = _col(path)
    return F.coalesce(date_from_name(_part(path, 2), now_year), date_from_name(_part(path, 3), now_year))


def exif_date(value: Column | str, now_year: int | None = None) -> Column:
    """YYYY:MM:DD HH:MM:SS of a camera as ISO text."""
    v = F.trim(F.replace(_col(value), F.lit("\x00"), F.lit("")))
    iso = F.regexp_replace(F.regexp_extract(v, r"^\d{4}[:-]\d{2}[:-]\d{2}[ T]\d{2}:\d{2}:\d{2}", 0), r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T]", "$1-$2-$3T")
    return F.when(iso != "", sane(iso, now_year=now_year))


def container_date(tags: Column, zone: str, now_year: int | None = None) -> Column:
    """Local recording time from a video's tags (map): the maker's own local date beats creation_time, which is UTC."""
    low = F.map_from_entries(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    own, utc = F.try_element_at(low, F.lit("com.apple.quicktime.creationdate")), F.try_element_at(low, F.lit("creation_time"))
    local = F.date_format(F.from_utc_timestamp(F.try_to_timestamp(F.regexp_replace(utc, r"(\.\d+)?Z$", "")), zone), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.length(own) >= 19, sane(F.replace(F.substring(own, 1, 19), F.lit(" "), F.lit("T")), now_year=now_year)).otherwise(sane(local, now_year=now_year))


def effective_date(date_fix: Column | str, taken: Column | str) -> Column:
    """The date shown: the operator's ("unknown": none), else that of taken."""
    fix, taken = F.nullif(_col(date_fix), F.lit("")), F.nullif(_col(taken), F.lit(""))
    return F.when(fix.eqNullSafe(F.lit("unknown")), F.lit(None).cast("string")).otherwise(F.substring(F.coalesce(fix, taken), 1, 10))


def effective_time(date_fix: Column | str, taken: Column | str) -> Column:
    """The time shown: that of taken, unless the operator set the date."""
    fix, taken = F.nullif(_col(date_fix), F.lit("")), _col(taken)
    return F.when(fix.isNull() & (F.length(taken) >= 19), F.substring(taken, 12, 8))


def analog_origin(path: Column | str, *maker: Column) -> Column:
    """True for a scan or a tape transfer, by the maker, the file's name or words in the last four parts of the path."""
    path = _col(path)
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.split(path, "/")
    last = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 3), F.lit(4)), "/")
    words = F.split(F.lower(last), r"(?U)[\W_]+")
    out = stem.rlike(ANALOG_NAME) | F.arrays_overlap(words, F.array(*map(F.lit, ANALOG_WORDS)))
    for m in maker:
        out = out | F.coalesce(m.cast("string").rlike(SCANNER), F.lit(False))
    return out


def pick_date(path: Column, device: Column, device_source: Column, analog: Column, now_year: int | None = None) -> Column:
    """struct(taken, date_source): a camera's clock, else a date in the name; for scans a date in the name or folder
    that is more than a year older than the scanner's clock."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.struct(date_from_name(name, now_year).alias("named"), date_from_folders(path, now_year).alias("folder"), device.cast("string").alias("device"), device_source.cast("string").alias("source"), analog.alias("analog"))

    def pair(taken: Column, source: Column) -> Column:
        return F.struct(taken.alias("taken"), source.alias("date_source"))

    def pick(x: Column) -> Column:
        device, none = x["device"], F.lit(None).cast("string")

        def older(d: Column) -> Column:
            before = (_year(d) < _year(device) - 1) | ((_year(d) == _year(device) - 1) & (F.substring(d, 6, 5) < F.substring(device, 6, 5)))
            return d.isNotNull() & (device.isNull() | before)

        scanned = F.when(older(x["named"]), pair(x["named"], F.lit("name"))).when(older(x["folder"]), pair(x["folder"], F.lit("folder"))).otherwise(pair(none, F.when(device.isNotNull(), F.lit("scan"))))
        return F.when(x["analog"], scanned).when(device.isNotNull(), pair(device, x["source"])).otherwise(pair(x["named"], F.when(x["named"].isNotNull(), F.lit("name"))))

    return _bound(found, pick)


def shift(taken: Column | str, seconds: Column) -> Column:
    """taken moved by whole seconds; dates without a time stay."""
    taken = _col(taken)
    moved = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.try_to_timestamp(taken)) + seconds.cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.length(taken) >= 19, moved).otherwise(taken)


def file_counter(name: Column | str) -> Column:
    """A camera's file number: the last run of three digits or more of the stem."""
    stem = F.regexp_replace(_col(name), r"(?<=.)\.[^.]*$", "")
    return F.regexp_extract(stem, r"(\d{3,})\D*$", 1).try_cast("long")


def local_to_utc(naive: Column | str, zone: str) -> Column:
    """A camera's wall clock as a UTC instant in text; an unknown zone or clock keeps the clock as it is."""
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    naive = _col(naive)
    plain = F.concat(naive, F.lit(".000000Z"))
    try:
        ZoneInfo(zone)
    except (ValueError, ZoneInfoNotFoundError):
        return plain
    utc = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(naive), zone), "yyyy-MM-dd'T'HH:mm:ss'.000000Z'")
    return F.coalesce(utc, plain)


def within(date: Column | str, date_from: str = "", date_to: str = "") -> Column:
    """Search period: undated rows are out if either bound is set; the upper bound compares its own length only."""
    date = _col(date)
    if not date_from and not date_to:
        return F.lit(True)
    out = date.isNotNull() & (date != "") & (date >= F.lit(date_from))
    return out & (F.substring(date, 1, len(date_to)) <= F.lit(date_to)) if date_to else out


def within_film(date: Column | str, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Film period: as within(), but an undated row counts as "" for the lower and "9999" for the upper bound."""
    date, out = _col(date), F.lit(True)
    if date_from:
        out = out & (F.coalesce(date, F.lit("")) >= date_from)
    if date_to:
        out = out & (F.substring(F.coalesce(date, F.lit("9999")), 1, len(date_to)) <= date_to)
    return out


def valid_bound(text: Column | str) -> Column:
    """True for YYYY, YYYY-MM and YYYY-MM-DD."""
    return _col(text).rlike(BOUND)


def recorded_in(text: Column | str) -> Column:
    """The recording time that a probe's output names, as ISO text."""
    stamp = r"(\d{4})[.-](\d{2})[.-](\d{2})[_ ](\d{2})[-:](\d{2})[-:](\d{2})"
    y, mo, d, h, mi, s = (F.regexp_extract(_col(text), stamp, k) for k in range(1, 7))
    return F.when(y != "", F.concat(F.concat_ws("-", y, mo, d), F.lit("T"), F.concat_ws(":", h, mi, s)))


def camera_zone(zone: str | None, fallback: str = "Europe/Warsaw") -> str:
    """The zone of a camera's clock: a bare UTC is what a container has by default, never where the camera was."""
    return fallback if not zone or zone.upper() in ("UTC", "GMT", "ETC/UTC") else zone


def due(at: Column, last: Column, start: str, zone: str, hours: int = 6) -> Column:
    """True where a daily job that starts at HH:MM local time should run at the instant `at`: within `hours` of the start
    and not yet on that local day (last: the local date of the last run). A start that can't be read is never due."""
    h, _, m = start.partition(":")
    if not (h.strip().isdigit() and m.strip().isdigit()):
        return F.lit(False)
    local = F.from_utc_timestamp(at, zone)
    past = F.hour(local) * 60 + F.minute(local) - (int(h) * 60 + int(m))
    return (past >= 0) & (past < hours * 60) & ~F.coalesce(last == F.date_format(local, "yyyy-MM-dd"), F.lit(False))
