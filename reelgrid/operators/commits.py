"""A table that several writers change at once: a log of commits, each put only if nobody has put its number.

A commit is one small file `_log/<version>` that names the folders of rows that are live from then on. It is created only
if it is absent, so of two writers that read the same version one is refused. Readers take the last commit and see all of
it or nothing. Rows go to a folder of their own before, so a writer that dies leaves folders that no commit names.

The folder must be in a store whose create-if-absent is atomic (HDFS, a local disk, object stores with conditional puts).
A commit file that is not whole yet counts as not there for readers, while writers already meet it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Somebody else committed since the version that a change was made from."""


@dataclass
class Snapshot:
    version: int
    folders: list[str] = field(default_factory=list)
    marks: dict[str, int] = field(default_factory=dict)
    """Counters that go up with edits of one kind, such as those of people by the operator."""


class CommitLog:
    """A table of one schema in a folder.

    Rows of a later commit replace those of equal keys; `deleted` true removes a key. A commit writes only its own rows;
    when more than `most` folders are live, the next one writes the table anew as one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], most: int = 20):
        self.spark, self.path, self.keys, self.most = spark, path.rstrip("/"), keys, most
        self.schema = f"{schema}, deleted boolean, version long"
        self.columns = [c for c in spark.createDataFrame([], schema).columns]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _files(self):
        return self._at("_log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last whole commit, or that of a version; version 0 is the empty table."""
        files, log = self._files, self._at("_log")
        if version is None:
            found = [int(f.getPath().getName()) for f in files.listStatus(log) if f.getPath().getName().isdigit()] if files.exists(log) else []
            last = max(found, default=0)
            return self._entry(last) or self._entry(last - 1) or Snapshot(0)
        return self._entry(version) or Snapshot(0)

    def _entry(self, version: int) -> Snapshot | None:
        """The commit of a version; None while its writer is at it."""
        if version <= 0:
            return None
        files = self._files
        stream = files.open(self._at(f"_log/{version:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(version, **json.loads(text)) if text.endswith("}") else None

    def rows(self, at: Snapshot | None = None) -> DataFrame:
        """The live rows of a snapshot."""
        at = at or self.snapshot()
        if not at.folders:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        log = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in at.folders))
        rest = [c for c in log.columns if c not in self.keys]
        last = log.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "version").alias("__row")).select(*self.keys, "__row.*")
        return last.where(~F.coalesce("deleted", F.lit(False))).select(*self.columns)

    def commit(self, base: Snapshot, changes: DataFrame, bump: str | None = None) -> Snapshot:
        """Put changes (the columns, and perhaps deleted) as the version after base; Conflict if that is taken.

        bump: a mark that goes up with this commit. Rows are written before the version is put.
        """
        version, folder = base.version + 1, f"rows-{base.version + 1:020d}-{uuid.uuid4().hex}"
        new = changes if "deleted" in changes.columns else changes.withColumn("deleted", F.lit(False))
        new = new.select(*self.columns, F.coalesce("deleted", F.lit(False)).alias("deleted")).withColumn("version", F.lit(version).cast("long"))
        folders = [*base.folders, folder]
        if len(folders) > self.most:
            kept = self.rows(base).join(new.select(*self.keys), self.keys, "left_anti")
            new = kept.withColumn("deleted", F.lit(False)).withColumn("version", F.lit(version).cast("long")).unionByName(new.where("not deleted"))
            folders = [folder]
        new.write.parquet(f"{self.path}/{folder}")
        marks = base.marks | ({bump: base.marks.get(bump, 0) + 1} if bump else {})
        self._put(version, {"folders": folders, "marks": marks})
        return Snapshot(version, folders, marks)

    def _put(self, version: int, entry: dict) -> None:
        """Create the file of a version, whole, if there is none."""
        files, final = self._files, self._at(f"_log/{version:020d}")
        try:
            out = files.create(final, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def change(self, make: Callable[[DataFrame, Snapshot], DataFrame | None], bump: str | None = None, attempts: int = 20) -> Snapshot | None:
        """Commit what make(rows, snapshot) returns; made anew from the new rows whenever another writer was faster.

        make returns None to leave the table as it is (refused); so does change.
        """
        for _ in range(attempts):
            base = self.snapshot()
            rows = make(self.rows(base), base)
            if rows is None:
                return None
            try:
                return self.commit(base, rows, bump)
            except Conflict:
                time.sleep(0.05)
        raise Conflict(f"{attempts} attempts on {self.path} met other writers")


def apply_if_unedited(table: CommitLog, mark: str, seen: int, rows: DataFrame) -> bool:
    """Commit rows (bulk reassignments) only if the mark still is what it was when they were worked out.

    The check and the commit are one: an edit in between takes the version, and the next attempt sees its mark.
    """
    return table.change(lambda _, at: rows if at.marks.get(mark, 0) == seen else None) is not None


def replace_scene(table: CommitLog, scene: dict[str, str], rows: DataFrame, people: Callable[[], DataFrame], person: str = "person_id") -> bool:
    """Replace all rows of a scene in one commit, unless a person that they name is gone; people: (id) as it is now.

    scene: column and value that name it. Rows of before that are not in the new ones are deleted with it.
    """

    def make(now: DataFrame, at: Snapshot) -> DataFrame | None:
        named = rows.where(F.col(person).isNotNull()).select(F.col(person).alias("id"))
        if not named.join(people(), "id", "left_anti").isEmpty():
            return None
        here = now
        for column, value in scene.items():
            here = here.where(F.col(column) == value)
        gone = here.join(rows.select(*table.keys), table.keys, "left_anti").withColumn("deleted", F.lit(True))
        return rows.select(*table.columns).withColumn("deleted", F.lit(False)).unionByName(gone)

    return table.change(make) is not None


# ---- queues ------------------------------------------------------------------------------------------------------------
JOBS = "key string, kind string, status string, queued_at long, owner string, expires long, attempt int"
LIVE = ("QUEUED", "RUNNING")


def jobs_table(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, JOBS, ["key"])


def _single(table: CommitLog, row: dict) -> DataFrame:
    return table.spark.createDataFrame([tuple(row[c] for c in table.columns)], JOBS)


def enqueue(table: CommitLog, key: str, kind: str, now: int, singleton: bool = False) -> bool:
    """Queue a job; refused if it is live already, or, for a singleton, if any of its kind is."""

    def make(rows: DataFrame, at: Snapshot) -> DataFrame | None:
        live = rows.where(F.col("status").isin(*LIVE) & ((F.col("kind") == kind) if singleton else (F.col("key") == key)))
        return None if not live.isEmpty() else _single(table, {"key": key, "kind": kind, "status": "QUEUED", "queued_at": now, "owner": None, "expires": None, "attempt": 0})

    return table.change(make) is not None


def claim(table: CommitLog, kind: str, owner: str, now: int, lease: int) -> str | None:
    """Take the job of a kind that waits longest, or one whose holder let its lease run out; its key, or None.

    Of workers that choose the same job one commits; the others choose again from what is left. A worker holds a job for
    `lease` seconds and can renew it.
    """
    taken: list[str] = []

    def make(rows: DataFrame, at: Snapshot) -> DataFrame | None:
        taken.clear()
        free = (F.col("status") == "QUEUED") | ((F.col("status") == "RUNNING") & (F.col("expires") <= now))
        first = rows.where((F.col("kind") == kind) & free).orderBy("queued_at", "key").limit(1).collect()
        if not first:
            return None
        taken.append(first[0].key)
        return _single(table, first[0].asDict() | {"status": "RUNNING", "owner": owner, "expires": now + lease, "attempt": first[0].attempt + 1})

    return taken[0] if table.change(make) else None


def _held(table: CommitLog, key: str, owner: str, new: Callable[[dict], dict]) -> bool:
    def make(rows: DataFrame, at: Snapshot) -> DataFrame | None:
        own = rows.where((F.col("key") == key) & (F.col("status") == "RUNNING") & (F.col("owner") == owner)).collect()
        return _single(table, own[0].asDict() | new(own[0].asDict())) if own else None

    return table.change(make) is not None


def renew(table: CommitLog, key: str, owner: str, now: int, lease: int) -> bool:
    """A longer lease, for as long as the job is still this owner's."""
    return _held(table, key, owner, lambda _: {"expires": now + lease})


def finish(table: CommitLog, key: str, owner: str, status: str = "READY") -> bool:
    """The job's end; refused if another worker took it over meanwhile."""
    return _held(table, key, owner, lambda _: {"status": status, "expires": None})
