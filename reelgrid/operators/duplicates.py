"""Footage that was captured twice: candidate pairs by equi-joins, exact rules, components, the best of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.config import DEFAULTS
from reelgrid.functions.dates import SANE_DATE
from reelgrid.functions.numbers import hamming, hash_bits
from reelgrid.operators.components import connected_components
from reelgrid.operators.pair_tiles import ordered_pairs
from reelgrid.operators.vector_blocks import spread
from reelgrid.plans.scratch import materialise


def bands(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest bands of 64 bits of which one has at most one of that many flipped bits."""
    n, at, out = bits // 2 + 1, 0, []
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        out.append((at, width))
        at += width
    return out


def _lists(hashes: DataFrame, key: str) -> DataFrame:
    """(k, all): the hashes of each key, in order of position."""
    return hashes.where("bits is not null").groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct("position", "bits"))).alias("all"))


def _near(lists: DataFrame, bits: int, least: int) -> DataFrame:
    """(a, b), a < b, of rows (k, all) whose hashes are near. Only a key and one hash travel to where bands meet, and are
    compared there; the lists are looked up for the pairs that are left."""
    each = lists.select("k", F.explode("all").alias("h")).select("k", F.col("h.position").alias("p"), F.col("h.bits").alias("h"))

    def value(shift: int, width: int) -> Column:
        return F.shiftrightunsigned("h", shift).bitwiseAND((1 << width) - 1)

    def around(i: int, shift: int, width: int) -> Column:
        masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(width)))
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("band"), value(shift, width).bitwiseXOR(m).alias("v")))

    own = [F.struct(F.lit(i).alias("band"), value(s, w).alias("v")) for i, (s, w) in enumerate(bands(bits))]
    near = [around(i, s, w) for i, (s, w) in enumerate(bands(bits))]
    l = each.select(F.col("k").alias("a"), F.col("h").alias("x"), "p", F.explode(F.flatten(F.array(*near))).alias("c")).select("a", "x", "p", "c.*")
    r = each.select(F.col("k").alias("b"), F.col("h").alias("y"), "p", F.explode(F.array(*own)).alias("c")).select("b", "y", "p", "c.*")
    met = l.join(r, ["p", "band", "v"]).where((F.col("a") < F.col("b")) & (hamming(F.col("x"), F.col("y")) <= bits)).select("a", "b").distinct()
    met = met.join(lists.select(F.col("k").alias("a"), F.col("all").alias("x")), "a").join(lists.select(F.col("k").alias("b"), F.col("all").alias("y")), "b")
    both = F.filter("x", lambda i: F.exists("y", lambda j: j["position"] == i["position"]))
    alike = F.forall("x", lambda i: F.forall("y", lambda j: (i["position"] != j["position"]) | (hamming(i["bits"], j["bits"]) <= bits)))
    return met.where(alike & (F.size(both) >= least)).select("a", "b")


def hamming_pairs(hashes: DataFrame, key: str = "key", bits: int = DEFAULTS.hamming_bits, least: int = DEFAULTS.least_positions) -> DataFrame:
    """(a, b), a < b: keys whose hashes differ by at most `bits` bits at every position that both have, and `least` have.

    hashes: (key, position, bits as long). Positions meet by wide bands: one side stands under the value of each band,
    the other under it and its neighbours of one bit, so keys meet about as rarely as long hashes agree by chance. These
    are all pairs; where many keys have equal hashes, hamming_edges says the same in as many rows as there are keys.
    """
    return _near(materialise(_lists(hashes, key), "lists"), bits, least)


def _classes(rows: DataFrame, by: list[str], touched: DataFrame | None) -> DataFrame:
    """rows (k, *by) with rep, the smallest k of those that are alike in `by`; a touched k (column k) stands alone."""
    rows = rows.withColumn("__own", F.lit(None).cast(rows.schema["k"].dataType))
    if touched is not None:
        mark = touched.select("k", F.col("k").alias("__t")).distinct()
        rows = rows.drop("__own").join(mark, "k", "left").withColumnRenamed("__t", "__own")
    least = rows.groupBy(*by, "__own").agg(F.min("k").alias("rep")).select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__own").alias("__o"), "rep")
    same = F.col("__own").eqNullSafe(F.col("__o"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(least, same).select("k", *by, "rep")


def hamming_edges(hashes: DataFrame, key: str = "key", bits: int = DEFAULTS.hamming_bits, least: int = DEFAULTS.least_positions, touched: DataFrame | None = None) -> DataFrame:
    """(a, b) with the components of hamming_pairs: keys with equal hashes are a class, joined to its smallest key, and
    only these keys are paired. A blank picture of a million scenes is a million edges. touched: keys (column k) that
    must keep all their own pairs, as the operator told some of them apart; they stand outside the classes. Lists and
    classes are written, as bands and stars read them several times."""
    lists = materialise(_classes(materialise(_lists(hashes, key), "lists"), ["all"], touched), "classes")
    stars = lists.where((F.col("k") != F.col("rep")) & (F.size("all") >= least)).select(F.col("rep").alias("a"), F.col("k").alias("b"))
    return stars.unionByName(_near(lists.where("k = rep").select("k", "all"), bits, least))


def same_recording(scenes: DataFrame, bits: int = DEFAULTS.hamming_bits, slack: int = DEFAULTS.frame_slack) -> DataFrame:
    """(a, b) of scenes (key, fingerprint) that are very likely the same footage: by hashes at every position; by camera
    time and start timecode; or by timecodes and a nearly equal number of frames."""
    fp = F.col("fingerprint")
    hashes = scenes.select("key", F.posexplode("fingerprint.frame_hashes").alias("position", "digits")).select("key", "position", hash_bits("digits").alias("bits"))
    s = scenes.select("key", F.nullif(fp["datetime"], F.lit("")).alias("dt"), F.nullif(fp["tc_start"], F.lit("")).alias("tc"), fp["tc_end"].alias("te"), F.coalesce(fp["frame_count"], F.lit(0)).alias("n"))
    s = s.where("tc is not null")
    l, r = s.alias("l"), s.alias("r")
    both = (F.col("l.tc") == F.col("r.tc")) & (F.col("l.key") < F.col("r.key"))
    timed = both & (F.col("l.dt") == F.col("r.dt")) & F.substring("l.dt", 1, 10).rlike(SANE_DATE)
    framed = both & F.col("l.te").eqNullSafe(F.col("r.te")) & (F.abs(F.col("l.n") - F.col("r.n")) <= slack)
    ends = [F.col("l.key").alias("a"), F.col("r.key").alias("b")]
    return hamming_pairs(hashes, bits=bits).unionByName(l.join(r, timed).select(*ends)).unionByName(l.join(r, framed).select(*ends)).distinct()


def recording_edges(scenes: DataFrame, bits: int = DEFAULTS.hamming_bits, slack: int = DEFAULTS.frame_slack, touched: DataFrame | None = None) -> DataFrame:
    """(a, b) with the components of same_recording, in about as many rows as scenes: those alike in a rule's fields are
    a class, joined to its smallest key; among classes of equal timecodes only neighbours by number of frames meet. All
    pairs of touched scenes (column k) are kept. Classes are written, as stars, chains and touched scenes read them."""
    fp = F.col("fingerprint")
    hashes = scenes.select("key", F.posexplode("fingerprint.frame_hashes").alias("position", "digits")).select("key", "position", hash_bits("digits").alias("bits"))
    s = scenes.select(F.col("key").alias("k"), F.nullif(fp["datetime"], F.lit("")).alias("dt"), F.nullif(fp["tc_start"], F.lit("")).alias("tc"), fp["tc_end"].alias("te"), F.coalesce(fp["frame_count"], F.lit(0)).alias("n")).where("tc is not null")
    s = materialise(s, "timecodes")
    timed = _classes(s.where(F.substring("dt", 1, 10).rlike(SANE_DATE)).select("k", "tc", "dt"), ["tc", "dt"], touched)
    framed = _classes(s.select("k", "tc", "te", "n"), ["tc", "te", "n"], touched)
    timed, framed = materialise(timed, "timed"), materialise(framed, "framed")
    stars = [c.where("k != rep").select(F.col("rep").alias("a"), F.col("k").alias("b")) for c in (timed, framed)]
    out = hamming_edges(hashes, bits=bits, touched=touched).unionByName(stars[0]).unionByName(stars[1])
    by = Window.partitionBy("tc", "te").orderBy("n", "k")
    chain = framed.where("k = rep")
    if touched is not None:
        marks = touched.select("k").distinct()
        lone, chain = chain.join(marks, "k", "left_semi"), chain.join(marks, "k", "left_anti")
        lone_timed = timed.where("k = rep").join(marks, "k", "left_semi")
        for one, rest, cols, near in ((lone_timed, timed.where("k = rep"), ["tc", "dt"], F.lit(True)), (lone, framed.where("k = rep"), ["tc", "te"], F.abs(F.col("l.n") - F.col("r.n")) <= slack)):
            same = F.col("l.k") != F.col("r.k")
            for c in cols:
                same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
            out = out.unionByName(one.alias("l").join(rest.alias("r"), same & near).select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b")))
    links = chain.select("k", (F.col("n") - F.lag("n").over(by)).alias("gap"), F.lag("k").over(by).alias("p")).where(F.col("gap") <= slack)
    return out.unionByName(links.select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b"))).distinct()


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """pairs (a < b) that the operator has not marked as different; dismissed: (scene_a, scene_b) in any order."""
    no = dismissed.select(F.least("scene_a", "scene_b").alias("a"), F.greatest("scene_a", "scene_b").alias("b"))
    return pairs.join(no, ["a", "b"], "left_anti")


def dismiss_group(members: DataFrame) -> DataFrame:
    """Every pair of the keys of a group, to be dismissed. Tiles of pairs are dealt out, so that a task has 2 ** 28
    comparisons at most about, however few files the keys come from."""
    keys = materialise(members.select("key"), "members")
    return ordered_pairs(keys, "key", spread(keys.sparkSession, keys.count() ** 2, 1 << 28)).toDF("scene_a", "scene_b")


def duplicate_groups(scenes: DataFrame, dismissed: DataFrame | None = None, bits: int = DEFAULTS.hamming_bits) -> DataFrame:
    """scenes in groups of two or more with group, count, rank and best: fewest errors (unknown last), then longest.

    scenes: key, tape_id, scene_id, scene_index, frame_count, error_score, fingerprint. Filter by workspace before, so
    that footage of different people is never compared.
    """
    fp = F.col("fingerprint")
    probed = scenes.where((F.size(F.coalesce(fp["frame_hashes"], F.array().cast("array<string>"))) > 0) | (F.length(fp["tc_start"]) > 0) | (F.length(fp["datetime"]) > 0))
    touched = None
    if dismissed is not None:  # written: its own pairs are worked out once, not at each use
        dismissed = materialise(dismissed.select("scene_a", "scene_b"), "dismissed")
        touched = materialise(dismissed.select(F.explode(F.array("scene_a", "scene_b")).alias("k")).distinct(), "touched")
    pairs = recording_edges(probed, bits, touched=touched)
    if dismissed is not None:
        pairs = without_dismissed(pairs, dismissed)
    comp = connected_components(pairs)
    return rank_group(probed.drop("fingerprint").join(comp.select(F.col("vertex").alias("key"), F.col("component").alias("group")), "key"))


def rank_group(members: DataFrame) -> DataFrame:
    each = Window.partitionBy("group")
    best_first = each.orderBy(F.asc_nulls_last("error_score"), F.coalesce("frame_count", F.lit(0)).desc(), "tape_id", F.coalesce("scene_index", F.lit(0)), "scene_id")
    out = members.withColumn("count", F.count("*").over(each)).withColumn("rank", F.row_number().over(best_first))
    return out.withColumn("best", F.col("rank") == 1)
