"""Streams: folders that fill, tapes that end, frames that are held, people that are assigned as they appear."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelgrid.config import DEFAULTS
from reelgrid.operators.clustering import People


def watch(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """New JSON documents of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("multiLine", True).json(path)


def refresh(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs update(batch, number) on what is new: once over all that waits, or every so often. The checkpoint holds what
    was done, so a restart goes on after the last committed batch; update must bear a batch twice."""
    w = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def capture_sessions(signal: DataFrame, quiet: str = "45 seconds", late: str = "10 minutes") -> DataFrame:
    """A session for each run of signal of a tape: (tape_id, start, end, frames, blank); it ends when nothing came for
    `quiet`. signal: tape_id, ts, blank. Rows later than `late` are left out."""
    s = signal.withWatermark("ts", late).groupBy("tape_id", F.session_window("ts", quiet).alias("w"))
    return s.agg(F.count("*").alias("frames"), F.count_if(F.col("blank")).alias("blank")).select("tape_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "blank")


def settled_files(stream: DataFrame, delay_s: int = DEFAULTS.settle_s) -> DataFrame:
    """Files that were not touched for a while when their batch runs."""
    return stream.where(F.unix_timestamp(F.current_timestamp()) - F.col("mtime") >= delay_s)


def windowed_counts(events: DataFrame, key: str, at: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n) in tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


HELD = "scene string, t double, t_end double"


def hold_frames(frames: DataFrame, step: float = DEFAULTS.vision_step, most_gap: float = 10.0, change: float = 10.0) -> DataFrame:
    """(scene, t, t_end) of pictures, each when it ends: it changed, went blank, or was held for most_gap. frames: scene,
    i, usable, thumb, last. The state of a scene is one picture; it goes with its last frame."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        out, over = [], False
        for f in pd.concat(list(batches)).sort_values("i").itertuples():
            t, x = f.i * step, np.asarray(f.thumb, float)
            over |= bool(f.last)
            if held and f.usable and np.abs(x - np.asarray(held[2])).mean() <= change and t - held[0] < most_gap:
                held[1] = t + step
                continue
            if held:
                out.append((key[0], held[0], held[1]))
            held = [t, t + step, x.tolist()] if f.usable else None
        if over:
            out += [(key[0], held[0], held[1])] if held else []
            held = None
        if held:
            state.update((held[0], held[1], held[2]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["scene", "t", "t_end"])

    return frames.groupBy("scene").applyInPandasWithState(follow, HELD, "t double, t_end double, thumb array<double>", "append", GroupStateTimeout.NoTimeout)


class AssignPeople(StatefulProcessor):
    """People of one workspace as they appear: one map entry a person, of which a batch rewrites those that it changed."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.people = handle.getMapState("people", "person int", "centre array<double>, size int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = sorted(((k[0], v) for k, v in self.people.iterator()), key=lambda x: x[0])
        people = People(self.threshold, [list(v[0]) for _, v in known], [v[1] for _, v in known])
        changed = set()
        for r in sorted(rows, key=lambda r: r.id):
            person = people.assign(np.asarray(r.embedding, float))
            changed.add(person)
            yield Row(workspace=key[0], id=r.id, person=person)
        for person in changed:
            self.people.updateValue((person,), (people.centres[person].tolist(), people.sizes[person]))

    def close(self) -> None:
        pass


def assign_stream(tracks: DataFrame, threshold: float = DEFAULTS.match_threshold) -> DataFrame:
    """(workspace, id, person): tracks assigned to running centroids as they come, by id within a batch. The state is a
    row a person. The session needs the RocksDB state store (captures.stateful)."""
    rows = tracks.select("workspace", "id", "embedding")
    return rows.groupBy("workspace").transformWithState(AssignPeople(threshold), "workspace string, id long, person int", "append", "None")
