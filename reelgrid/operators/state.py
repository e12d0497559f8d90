"""State as a change log: rows are only appended; views say what holds now. Queues, pruning, compare and swap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States that a job does not leave.
TERMINAL = ("READY", "ERROR", "CANCELLED", "INTERRUPTED")


def latest(log: DataFrame, keys: Sequence[str], version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The last row of each key, unless it is a tombstone. One aggregation, combined on the map side, of whole rows."""
    rest = [c for c in log.columns if c not in keys]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__row")).select(*keys, "__row.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted in log.columns else out


def upsert(log: DataFrame, rows: DataFrame, version: int) -> DataFrame:
    """log and rows as its newest version."""
    new = rows.withColumn("version", F.lit(version).cast("long"))
    return log.unionByName(new.withColumn("deleted", F.lit(False)) if "deleted" in log.columns else new, allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """log with tombstones for keys."""
    return log.unionByName(keys.withColumn("version", F.lit(version).cast("long")).withColumn("deleted", F.lit(True)), allowMissingColumns=True)


def insert_missing(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    return rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")


def keep_newest(jobs: DataFrame, keep: int, at: str = "updated_at", key: str = "tape_id", status: str = "status") -> DataFrame:
    """Jobs without those beyond the newest `keep` that are over. The queue's names and times only are ranked, and the
    rank is taken from the top: `keep` rows come from a distributed top-k, no task sorts all."""
    top = jobs.select(key, at).orderBy(F.desc(at), key).limit(keep).select(key)
    old = jobs.join(F.broadcast(top) if keep <= 10_000 else top, key, "left_anti")
    return jobs.join(old.where(F.col(status).isin(*TERMINAL)).select(key), key, "left_anti")


def older_than(rows: DataFrame, cutoff: str, at: str = "updated_at", status: str = "status") -> DataFrame:
    """Finished rows older than the cutoff."""
    return rows.where(F.col(status).isin(*TERMINAL) & (F.col(at) < cutoff))


def next_in_queue(jobs: DataFrame, waiting: Sequence[str], at: str = "updated_at", key: str = "tape_id") -> DataFrame:
    """The job that waits longest; ties by key."""
    return jobs.where(F.col("status").isin(*waiting)).orderBy(at, key).limit(1)


def current_job(jobs: DataFrame, active: Sequence[str], at: str = "updated_at", key: str = "tape_id") -> DataFrame:
    """The newest active job, else the newest of all."""
    return jobs.orderBy(F.col("status").isin(*active).desc(), F.desc(at), key).limit(1)


def busy(ids: DataFrame, jobs: DataFrame, builds: DataFrame, key: str = "tape_id") -> DataFrame:
    """ids that a job or a build is at work on."""
    at_work = jobs.where(~F.col("status").isin(*TERMINAL)).select(key).unionByName(builds.where(F.col("status").isin("QUEUED", "RUNNING")).select(key))
    return ids.join(at_work, key, "left_semi")


def merge_builds(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """new over old; a cancellation asked for meanwhile stays while the build is active."""
    kept = old.select(key, F.col("cancel").alias("__c"))
    out = new.join(kept, key, "left").withColumn("cancel", F.col("cancel") | (F.coalesce("__c", F.lit(False)) & F.col("status").isin("QUEUED", "RUNNING")))
    return out.drop("__c").unionByName(old.join(new.select(key), key, "left_anti"))


def bump(meta: DataFrame, name: str) -> DataFrame:
    """(k, v): the counter of that name, one higher."""
    n = meta.where(F.col("k") == name).agg((F.coalesce(F.max(F.col("v").try_cast("long")), F.lit(0)) + 1).cast("string").alias("v"))
    return n.select(F.lit(name).alias("k"), "v")


def next_suffix(names: Column) -> Column:
    """The greatest number that a name ends in, and one more; for use in agg()."""
    return F.coalesce(F.max(F.regexp_extract(names, r"(\d+)$", 1).try_cast("long")), F.lit(0)) + 1


def change_token(rows: DataFrame, order: Sequence[str], *columns: str) -> DataFrame:
    """One row: a hash that changes with any of the columns. Row hashes are summed, so no task sees all rows and their
    order does not matter; order names the key that is part of each."""
    h = F.xxhash64(*order, *columns)
    return rows.agg(F.sha1(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum((h % F.lit(1_000_003)).cast("decimal(38,0)"))).cast("binary")).alias("token"))


def changed(listing: DataFrame, known: DataFrame, key: str, signature: Column, live: Column | None = None) -> DataFrame:
    """(key, change): "new", "changed" or "gone"; unchanged rows are left out. signature is computed on both sides;
    only rows where `live` holds can be gone, so that a folder that is away keeps its files."""
    l = listing.select(F.col(key), signature.alias("__l"))
    k = known.select(F.col(key), signature.alias("__k"), (F.lit(True) if live is None else live).alias("__live"))
    both = l.join(k, key, "full")
    state = F.when(F.col("__k").isNull(), "new").when(F.col("__l").isNull() & F.col("__live"), "gone").when(F.col("__l") != F.col("__k"), "changed")
    return both.select(key, state.alias("change")).where("change is not null")


def seen_again(listing: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Files to read anew: not known, another size, or a time that differs by a second or more."""
    k = known.select(F.col(key), F.col("size").alias("__s"), F.col("mtime").alias("__m"))
    return listing.join(k, key, "left").where(F.col("__s").isNull() | (F.col("__s") != F.col("size")) | (F.abs(F.col("__m") - F.col("mtime")) >= 1)).drop("__s", "__m")


def job_state(events: DataFrame, key: str = "tape_id") -> DataFrame:
    """Each job's last event, its history's length and the tail of its log."""
    each = Window.partitionBy(key)
    last = events.withColumn("__r", F.row_number().over(each.orderBy(F.desc("at"), F.desc("seq")))).withColumn("steps", F.count("*").over(each))
    return last.where("__r = 1").drop("__r").withColumn("log", F.expr("right(log, 20000)"))


def recover(jobs: DataFrame, owned: Sequence[str]) -> DataFrame:
    """Jobs after a crash: those in stages that this process owned are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*owned), "INTERRUPTED").otherwise(F.col("status")))


def with_children(ids: DataFrame, media: DataFrame) -> DataFrame:
    """(id) of rows and of the clips cut from them."""
    clips = media.where("parent_id is not null").select(F.col("id"), F.col("parent_id").alias("__p"))
    return ids.select("id").unionByName(clips.join(ids.select(F.col("id").alias("__p")), "__p").select("id")).distinct()


def set_album_date(media: DataFrame, album: str, date: str) -> DataFrame:
    """media with the operator's date on an album's undated originals and their clips."""
    undated = (F.col("album") == album) & F.col("taken").isNull() & (F.coalesce("date_fix", F.lit("")) == "")
    own = media.where(undated & F.col("parent_id").isNull()).select("id")
    marked = with_children(own, media).withColumn("__fix", F.lit(date))
    return media.join(marked, "id", "left").withColumn("date_fix", F.coalesce("__fix", "date_fix")).drop("__fix")


def import_once(rows: DataFrame, marker: DataFrame, name: str) -> DataFrame:
    """rows, or none if an import of that name was marked before."""
    return rows.join(marker.where(F.col("k") == name).select(F.lit(True).alias("__done")).limit(1), F.lit(True), "left_anti")


def workspaces(stored: DataFrame) -> DataFrame:
    """(name): the implicit default first."""
    default = stored.sparkSession.range(1).select(F.lit("default").alias("name"))
    rest = stored.select("name").where("name <> 'default'").distinct()
    return default.unionByName(rest).orderBy((F.col("name") != "default").cast("int"), "name")


def replace_if(table: DataFrame, rows: DataFrame, keys: Sequence[str], marks: DataFrame, name: str, seen: int) -> DataFrame:
    """table with rows over those of equal keys, unless the counter `name` of marks (k, v) moved since it was `seen`:
    the counter is read by the job that makes the rows. What happens until they are written, it can't see; a table that
    several writers change takes commits.apply_if_unedited, whose check and write are one."""
    now = marks.where(F.col("k") == name).agg((F.coalesce(F.max(F.col("v").try_cast("long")), F.lit(0)) == seen).alias("__same"))
    fresh = rows.join(F.broadcast(now)).where("__same").drop("__same")
    return table.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_running(jobs: DataFrame, ids: DataFrame, key: str, guarded: Sequence[str] = ("RUNNING",)) -> DataFrame:
    """jobs without those of ids, but those in a guarded state stay."""
    gone = jobs.join(ids.select(key), key, "left_semi").where(~F.col("status").isin(*guarded)).select(key)
    return jobs.join(gone, key, "left_anti")
