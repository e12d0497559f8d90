"""People: summaries, where they are seen, centroids, nearest and second nearest, suggestions, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.config import DEFAULTS
from reelgrid.functions.numbers import dot
from reelgrid.operators.pair_tiles import ordered_pairs
from reelgrid.operators.scans import ranked
from reelgrid.operators.vector_blocks import spread
from reelgrid.plans.scratch import materialise


def centroids(vectors: DataFrame, keys: list[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """keys, centroid (the mean vector of length 1), n. Components are summed by position with map-side combine."""
    w = F.lit(1.0) if weight is None else weight
    each = vectors.where(F.col(vector).isNotNull()).select(*keys, w.alias("__w"), F.posexplode(vector).alias("__i", "__v"))
    sums = each.groupBy(*keys, "__i").agg(F.sum(F.col("__v").cast("double") * F.col("__w")).alias("__s"), F.count("*").alias("__n"))
    out = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__s"))).alias("__c"), F.max("__n").alias("n"), F.sqrt(F.sum(F.col("__s") * F.col("__s"))).alias("__l"))
    length = F.when(F.col("__l") > 0, F.col("__l")).otherwise(1.0)
    return out.select(*keys, F.transform("__c", lambda x: x["__s"] / length).alias("centroid"), "n")


def template(views: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """A track's template: its best views by quality, weighted by it."""
    best = Window.partitionBy(*keys).orderBy(F.desc("quality"), "second")
    top = views.where("quality > 0").withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= most)
    return centroids(top, keys, "embedding", F.col("quality"))


def nearest(vectors: DataFrame, centres: DataFrame, id_col: str, centre_col: str, threshold: float = -1.0, margin: float | None = None, block: int = 4096) -> DataFrame:
    """(id, centre, best, second): the most similar centre of each vector at the threshold, `margin` above the second.

    Centres (centre_col, centroid) are counted and broadcast in blocks of about `block` rows; each block leaves a
    vector's two best, which an aggregation merges. Ties: the smallest centre.
    """
    blocks, out = -(-centres.count() // block) or 1, None
    for k in range(blocks):
        some = centres.select(centre_col, "centroid").where(F.pmod(F.xxhash64(centre_col), F.lit(blocks)) == k)
        pairs = vectors.join(F.broadcast(some), F.lit(True))
        scored = pairs.select(F.col(id_col), F.col(centre_col), dot(F.col("embedding"), F.col("centroid")).alias("s"))
        top = scored if blocks == 1 else _two(scored, id_col, centre_col).drop("__r")
        out = top if out is None else out.unionByName(top)
    return best_two(out, id_col, centre_col, threshold, margin)


def _two(scored: DataFrame, id_col: str, centre_col: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("s"), centre_col))
    return scored.withColumn("__r", r).where(F.col("__r") <= 2)


def best_two(scored: DataFrame, id_col: str, centre_col: str, threshold: float, margin: float | None) -> DataFrame:
    top = _two(scored, id_col, centre_col)
    out = top.groupBy(id_col).agg(
        F.min(F.when(F.col("__r") == 1, F.col(centre_col))).alias(centre_col), F.max(F.when(F.col("__r") == 1, F.col("s"))).alias("best"), F.coalesce(F.max(F.when(F.col("__r") == 2, F.col("s"))), F.lit(-1.0)).alias("second")
    )
    keep = F.col("best") >= threshold
    return out.where(keep if margin is None else keep & (F.col("best") - F.col("second") >= margin))


def person_summary(persons: DataFrame, tracks: DataFrame) -> DataFrame:
    """persons with tracks, scenes, cover (the best view's track): named first, then by name, scenes, tracks."""
    t = tracks.select("person_id", F.col("id").alias("track"), "tape_id", "scene_id", F.coalesce("rq", "quality").alias("__q"))
    sums = t.groupBy("person_id").agg(F.count("*").alias("tracks"), F.countDistinct("tape_id", "scene_id").alias("scenes"), F.max(F.struct(F.coalesce("__q", F.lit(-1.0)).alias("q"), (-F.col("track")).alias("t"))).alias("__c"))
    out = persons.join(sums, F.col("id") == F.col("person_id"), "left")
    out = out.select("id", "name", "hidden", F.col("grp").alias("group"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tracks", "scenes")), (-F.col("__c.t")).alias("cover"))
    return out.orderBy(F.col("name").isNull(), F.lower(F.coalesce("name", F.lit(""))), F.desc("scenes"), F.desc("tracks"), "id")


def person_class() -> Column:
    """How a person is listed."""
    return F.when(F.coalesce("hidden", F.lit(False)), "hidden").when(F.col("name").isNotNull(), "named").when(F.col("scenes") >= 2, "often").otherwise("rare")


def scene_people(tracks: DataFrame) -> DataFrame:
    """(tape_id, scene_id, person_id, times): the seconds that each person is seen in a scene, sorted, each once."""
    s = tracks.select("tape_id", "scene_id", "person_id", F.explode_outer("times").alias("t"))
    return s.groupBy("tape_id", "scene_id", "person_id").agg(F.array_sort(F.collect_set("t")).alias("times"))


def person_scenes(tracks: DataFrame, catalog: DataFrame, person: int) -> DataFrame:
    """A person's scenes with date, time and label; scenes gone from the catalog are left out."""
    own = scene_people(tracks.where(F.col("person_id") == person))
    return own.join(catalog, ["tape_id", "scene_id"]).orderBy(F.coalesce("date", F.lit("9999")), F.coalesce("time", F.lit("")), "tape_id", "scene_id")


def cannot_links(tracks: DataFrame) -> DataFrame:
    """(a, b): tracks of one scene that share a second. They meet by second, so only those that do are paired."""
    s = tracks.select("tape_id", "scene_id", "id", F.explode(F.array_distinct("times")).alias("t"))
    l, r = s.alias("l"), s.alias("r")
    same = (F.col("l.tape_id") == F.col("r.tape_id")) & (F.col("l.scene_id") == F.col("r.scene_id")) & (F.col("l.t") == F.col("r.t")) & (F.col("l.id") < F.col("r.id"))
    return l.join(r, same).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def differently_named(persons: DataFrame) -> DataFrame:
    """(a, b): anchors of people with different names. All pairs are asked for. A number stands for each name, so
    that a pair is two numbers on each side; tiles of pairs are dealt out, 2 ** 28 comparisons a task at most about."""
    n = persons.where(F.col("name").isNotNull() & F.col("anchor").isNotNull()).select("anchor", F.lower("name").alias("name"))
    n = n.join(n.select("name").distinct().withColumn("n", F.monotonically_increasing_id()), "name").select("anchor", "n")
    n = materialise(n, "named")
    return ordered_pairs(n, "anchor", spread(n.sparkSession, n.count() ** 2, 1 << 28), "n")


def live_feedback(feedback: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rules whose two tracks still exist."""
    ids = tracks.select("id")
    return feedback.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")


def suggestions(
    tracks: DataFrame, persons: DataFrame, feedback: DataFrame, core_frontal: float = DEFAULTS.core_frontal, least: float = DEFAULTS.suggest_threshold, margin: float = DEFAULTS.suggest_margin
) -> DataFrame:
    """(id, suggested, name, score) for unnamed visible people: the named person they most likely are, never one that
    the operator said no to. Similarity of the means of the frontal views, or of all where there is none."""
    views = tracks.where(F.col("arc").isNotNull()).withColumn("__core", F.col("frontal") >= core_frontal)
    some = views.groupBy("person_id").agg(F.max("__core").alias("__any"))
    used = views.join(some, "person_id").where(F.col("__core") | ~F.col("__any"))
    each = used.select("person_id", F.posexplode("arc").alias("i", "v")).groupBy("person_id", "i").agg(F.avg("v").alias("m"))
    centre = each.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("embedding"))
    shown = persons.where(~F.coalesce("hidden", F.lit(False))).join(centre, F.col("id") == F.col("person_id")).select("id", "name", "embedding")
    named = shown.where("name is not null").select(F.col("id").alias("suggested"), F.col("name"), F.col("embedding").alias("centroid"))
    owner = tracks.select(F.col("id").alias("t"), "person_id")
    no = feedback.where("kind = 'diff'").join(owner.select(F.col("t").alias("a"), F.col("person_id").alias("pa")), "a").join(owner.select(F.col("t").alias("b"), F.col("person_id").alias("pb")), "b")
    no = no.select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y")).distinct()
    pairs = shown.where("name is null").drop("name").join(named, F.lit(True))  # Spark broadcasts the named while they are small
    pairs = pairs.withColumn("x", F.least("id", "suggested")).withColumn("y", F.greatest("id", "suggested")).join(no, ["x", "y"], "left_anti")
    scored = pairs.select("id", "suggested", dot(F.col("embedding"), F.col("centroid")).alias("s"))
    best = best_two(scored, "id", "suggested", least, margin)
    return best.join(named.select("suggested", "name"), "suggested").select("id", "suggested", "name", F.bround("best", 3).alias("score"))


def merge_people(tracks: DataFrame, persons: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """(tracks, persons) after source's tracks moved to target; target's name stays, or takes the source's if it has none."""
    moved = tracks.withColumn("person_id", F.when(F.col("person_id") == source, target).otherwise(F.col("person_id")))
    name = persons.where(F.col("id") == source).select(F.col("name").alias("__n"))
    kept = persons.where(F.col("id") != source).join(F.broadcast(name), F.col("id") == target, "left")
    return moved, kept.withColumn("name", F.coalesce("name", "__n")).drop("__n")


def same_name(persons: DataFrame, name: str, but: int) -> DataFrame:
    """Other people of that name; a rename to it merges with the first."""
    return persons.where((F.lower("name") == name.lower()) & (F.col("id") != but)).orderBy("id").limit(1)


def without_tracks(persons: DataFrame, tracks: DataFrame) -> DataFrame:
    """Unnamed people that no track is left of: they can go."""
    return persons.where("name is null").join(tracks.select(F.col("person_id").alias("id")), "id", "left_anti")


def dissolve(tracks: DataFrame, person: int, next_id: int) -> DataFrame:
    """tracks with a person of their own each, for those of person."""
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy("id"))
    return tracks.withColumn("person_id", F.when(F.col("person_id") == person, F.lit(next_id - 1) + rank).otherwise(F.col("person_id")))


def keep_ids(groups: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group, person_id, n): how many tracks of each group each old person had, for stable ids."""
    return groups.join(tracks.select(F.col("id").alias("track"), "person_id"), "track").groupBy("group", "person_id").agg(F.count("*").alias("n"))


def anchors(persons: DataFrame, tracks: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(id, anchor): the track that stands for each person: the one chosen before if it is still the person's, else the
    best by quality (the smallest id of equals). without: (anchor) tracks that may not stand for any."""
    own = tracks if without is None else tracks.join(without.select(F.col("anchor").alias("id")), "id", "left_anti")
    best = own.groupBy(F.col("person_id").alias("id")).agg(F.max_by("id", F.struct(F.coalesce("rq", "quality"), -F.col("id"))).alias("__best"))
    held = own.select(F.col("id").alias("anchor"), F.col("person_id").alias("id"), F.lit(True).alias("__held"))
    out = persons.select("id", "anchor").join(held, ["id", "anchor"], "left").join(best, "id", "left")
    return out.select("id", F.when(F.col("__held"), F.col("anchor")).otherwise(F.col("__best")).alias("anchor"))


def move_tracks(tracks: DataFrame, persons: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, rules) after moves (track, target): "diff" rules between a moved track and the anchor of the person that
    it left, "same" rules with that of the person that it joined. Targets of other workspaces, and missing ones, are
    refused: their tracks stay. target null: the track becomes a person of its own, whose id follows the greatest."""
    space = persons.select(F.col("id").alias("target"), F.col("workspace").alias("__of"))
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    asked = moves.join(tracks.select(F.col("id").alias("track"), F.col("person_id").alias("left"), "workspace"), "track").join(space, "target", "left")
    fine = asked.where(F.col("target").isNull() | (F.col("__of") == F.col("workspace"))).join(F.broadcast(top))
    cols = ["track", "left", "joined", "target"]
    alone = ranked(fine.where("target is null").select("track", "left", "target", "__top"), ["track"], "__rank").withColumn("joined", F.col("__top") + F.col("__rank"))
    moved = fine.where("target is not null").withColumn("joined", F.col("target")).select(*cols).unionByName(alone.select(*cols))
    by = anchors(persons, tracks, moved.select(F.col("track").alias("anchor")))
    diff = moved.join(by, F.col("left") == F.col("id")).select(F.lit("diff").alias("kind"), F.col("track").alias("a"), F.col("anchor").alias("b"))
    same = moved.where("target is not null").join(by, F.col("target") == F.col("id")).select(F.lit("same").alias("kind"), F.col("track").alias("a"), F.col("anchor").alias("b"))
    rules = diff.unionByName(same).where("b is not null and a != b")
    to = moved.select(F.col("track").alias("id"), "joined")
    return tracks.join(to, "id", "left").withColumn("person_id", F.coalesce("joined", "person_id")).drop("joined"), rules


def drop_tracks(tracks: DataFrame, persons: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, persons, affected) after the tracks of scenes (tape_id, scene_id) were forgotten: unnamed people that none
    is left of go too; affected: (person_id) of the forgotten."""
    keys = ["tape_id", "scene_id"]
    lost = tracks.join(scenes.select(*keys).distinct(), keys, "left_semi")
    left = tracks.join(scenes.select(*keys).distinct(), keys, "left_anti")
    return left, persons.join(without_tracks(persons, left).select("id"), "id", "left_anti"), lost.select("person_id").distinct()


def rename_tape(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the new names of their tapes; names: (tape_id, new)."""
    return rows.join(names, "tape_id", "left").withColumn("tape_id", F.coalesce("new", "tape_id")).drop("new")


def touched(persons: DataFrame, tracks: DataFrame) -> DataFrame:
    """People that the operator named, hid or put in a group, with their anchors."""
    own = persons.where(F.col("name").isNotNull() | F.coalesce("hidden", F.lit(False)) | F.col("grp").isNotNull())
    return own.select("id", "workspace", "name", "hidden", "grp").join(anchors(persons, tracks), "id", "left")


def to_refine(tracks: DataFrame, model: str) -> DataFrame:
    """(tape_id, scene_id) with tracks that the model has not refined."""
    return tracks.where(~F.col("refined").eqNullSafe(F.lit(model))).select("tape_id", "scene_id").distinct()


def save_refined(tracks: DataFrame, refined: DataFrame, model: str) -> DataFrame:
    """tracks with the refined (id, arc, rq, frontal) over their own, marked with the model."""
    new = refined.select("id", *(F.col(c).alias(f"__{c}") for c in ("arc", "rq", "frontal")), F.lit(model).alias("__refined"))
    both = tracks.join(new, "id", "left")
    for c in ("arc", "rq", "frontal", "refined"):
        both = both.withColumn(c, F.when(F.col("__refined").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)))
    return both.drop("__arc", "__rq", "__frontal", "__refined")


def reject_pairs(pairs: DataFrame, persons: DataFrame, tracks: DataFrame) -> DataFrame:
    """("diff", a, b) rules between the anchors of people (x, y) that the operator says are not the same."""
    by = anchors(persons, tracks)
    out = pairs.join(by.select(F.col("id").alias("x"), F.col("anchor").alias("a")), "x").join(by.select(F.col("id").alias("y"), F.col("anchor").alias("b")), "y")
    return out.where("a is not null and b is not null and a != b").select(F.lit("diff").alias("kind"), "a", "b")
