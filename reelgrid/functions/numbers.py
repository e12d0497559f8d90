"""Durations, rates, qualities and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration(frames: Column | str, standard: Column | str) -> Column:
    """Seconds of a scene: 30000/1001 frames a second for NTSC, else 25."""
    return F.coalesce(_col(frames), F.lit(0)) / F.when(_col(standard) == "NTSC", 30000.0 / 1001).otherwise(25.0)


def frame_rate(*rates: Column) -> Column:
    """The first of num/den rates that lies within 1 and 240, to three places."""
    def one(r: Column) -> Column:
        parts = F.split(r, "/")
        den = F.coalesce(F.nullif(F.try_element_at(parts, F.lit(2)), F.lit("")), F.lit("1")).try_cast("double")
        v = F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), den)
        return F.when(v.between(1, 240), F.bround(v, 3))

    return F.coalesce(*(one(r) for r in rates))


def display_width(width: Column, aspect: Column) -> Column:
    """Width with the pixel aspect applied, even and 2 at least."""
    parts = F.split(F.coalesce(aspect, F.lit("1:1")), ":")
    num, den = (F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2))
    ratio = F.when((num != 0) & (den != 0), num / den).otherwise(1.0)
    return F.greatest(F.lit(2), (F.rint(width * F.coalesce(ratio, F.lit(1.0)) / 2) * 2).cast("int"))


def share_bitrate(seconds: Column, most_mb: float) -> Column:
    """Video bits a second that fit a file of most_mb, within 0.5 and 4 million."""
    bits = F.lit(most_mb * 1024 * 1024 * 8 * 0.93) / F.greatest(F.lit(1.0), seconds) - 128_000
    return F.least(F.lit(4_000_000.0), F.greatest(F.lit(500_000.0), bits)).cast("int")


def free_hours(free_bytes: Column, reserve: Column) -> Column:
    """Hours of tape that fit: 3.6 MB a second."""
    return F.greatest(F.lit(0.0), (free_bytes - reserve) / (3.6e6 * 3600))


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; none before anything is done."""
    return F.when((done > 0) & (total > 0), elapsed / done * (total - done))


def error_score(dropped: Column, breaks: Column, decode: Column) -> Column:
    """Dropped frames, source discontinuities (an array) and decode errors, missing ones 0."""
    return F.coalesce(dropped, F.lit(0)) + F.coalesce(F.size(breaks), F.lit(0)) * F.when(breaks.isNull(), 0).otherwise(1) + F.coalesce(decode, F.lit(0))


def keyframe_at(keyframes: Column, t: Column) -> Column:
    """The last keyframe at or before t, 5 ms of slack; 0 if none."""
    return F.coalesce(F.array_max(F.filter(keyframes, lambda k: k <= t + 0.005)), F.lit(0.0))


def shift_times(times: Column, delta: Column, seconds: Column) -> Column:
    """Whole seconds moved by delta, held within the file, sorted, each once."""
    top = F.when(seconds > 0, seconds.cast("int"))
    moved = F.transform(times, lambda t: F.greatest(F.lit(0), F.rint(t + delta).cast("int")))
    return F.array_sort(F.array_distinct(F.transform(moved, lambda t: F.coalesce(F.least(top, t), t))))


def spread_sample(times: Column, k: int) -> Column:
    """k evenly spaced elements of the sorted distinct times; all if there are no more."""
    ts = F.array_sort(F.array_distinct(times))
    if k < 2:
        return F.slice(ts, 1, k)
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(ts, (F.rint(i * (F.size(ts) - 1) / (k - 1)) + 1).cast("int")))
    return F.when(F.size(ts) <= k, ts).otherwise(F.array_distinct(picked))


def frontal(eye_l: Column, eye_r: Column, nose: Column, width: Column) -> Column:
    """0 for a profile, 1 for a face towards the camera; points are structs of x and y."""
    apart = F.sqrt(F.pow(eye_r["x"] - eye_l["x"], 2) + F.pow(eye_r["y"] - eye_l["y"], 2))
    yaw = F.abs(nose["x"] - (eye_l["x"] + eye_r["x"]) / 2) / apart
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), apart / (0.42 * width))) * F.greatest(F.lit(0.0), 1 - 2 * yaw)
    return F.when(apart < 1, 0.0).otherwise(score)


def view_quality(confidence: Column, width: Column, height: Column, sharpness: Column, facing: Column) -> Column:
    """How well a detected face can be recognised."""
    size = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least(width, height) - 20) / 60))
    return confidence * size * F.least(F.lit(1.0), sharpness / 80) * (0.2 + 0.8 * facing)


def usable_frame(mean: Column, deviation: Column) -> Column:
    """Neither blank nor burnt out."""
    return (deviation >= 6) & mean.between(18, 240)


def slot(t: Column, total: Column, slots: int) -> Column:
    """Which of equal slots of [0, total) holds t; the end belongs to the last."""
    return F.least(F.lit(slots - 1), F.greatest(F.lit(0), F.floor(F.try_divide(t * slots, total)))).cast("int")


def average_hash(grey: Column) -> Column:
    """64 bits of a 16 x 16 grey image (array): 2 x 2 blocks at or above the mean, first block highest, as 16 hex
    digits; empty if the blocks differ by less than 16."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: sum((F.element_at(grey, (F.floor(b / 8) * 32 + dy * 16 + (b % 8) * 2 + dx + 1).cast("int")).cast("double") for dy in (0, 1) for dx in (0, 1)), F.lit(0.0)) / 4,
    )
    mean = F.aggregate(blocks, F.lit(0.0), lambda a, v: a + v) / 64
    return F.when(F.array_max(blocks) - F.array_min(blocks) < 16, "").otherwise(bits_hash(blocks, mean))


def bits_hash(values: Column, floor: Column) -> Column:
    """64 bits, one for each value at or above floor, the first the highest, as 16 hex digits."""
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda n: F.conv(F.aggregate(F.slice(values, n * 4 + 1, F.lit(4)), F.lit(0), lambda a, v: a * 2 + F.when(v >= floor, 1).otherwise(0)).cast("string"), 10, 16),
    )
    return F.lower(F.array_join(digits, ""))


def hash_bits(digits: Column | str) -> Column:
    """A hash of 16 lower-case hex digits as a long; null for any other text."""
    h = _col(digits)
    return F.when(h.rlike("^[0-9a-f]{16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """v divided by its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))
