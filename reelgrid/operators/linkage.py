"""Average linkage of any number of vectors: rounds over a table of clusters, no similarity matrix.

The mean similarity of two clusters is the product of their sum vectors over the product of their sizes, so a cluster is
a row (sum, size) and stays one. A round finds each cluster's nearest in blocks and merges all that are each other's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.components import connected_components
from reelgrid.plans.scratch import materialise, release

BLOCK = 8192  # clusters that one side of a block pair holds, about
STRIP = 256  # rows of a block that are compared at once
PAIRS = 1 << 22  # pairs that one cell bars at once, about
_BEST = "workspace string, cluster long, near long, sim double"


def ties(ids: np.ndarray) -> np.ndarray:
    """Numbers whose products, by WOBBLE, tell equal similarities apart: a pair has the same from both sides, and where
    many clusters are equally near, half of them are each other's nearest instead of all looking at one."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


WOBBLE = 1e-12 / 2**32  # below what the rounding of a mean similarity leaves open


def barred_pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two sides (row, cell) that share a cell, in pieces."""
    row, cell = left
    order = np.argsort(right[1], kind="stable")
    other, cells = right[0][order], right[1][order]
    lo, hi = np.searchsorted(cells, cell, "left"), np.searchsorted(cells, cell, "right")
    upto = np.concatenate(([0], np.cumsum(hi - lo)))
    i = 0
    while i < len(cell):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
        size = hi[i:j] - lo[i:j]
        at = np.arange(int(size.sum())) + np.repeat(lo[i:j] - (upto[i:j] - upto[i]), size)
        yield np.repeat(row[i:j], size), other[at]
        i = j


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)


def _cells(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    rows = column.combine_chunks()
    return np.asarray(pc.list_parent_indices(rows), np.int64), np.asarray(rows.flatten(), np.int64)


def _nearest(threshold: float):
    def run(cell: pa.Table) -> pa.Table:
        same = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
        kind = cell.column("side").to_numpy()
        sides = []
        for side in (0,) if same else (0, 1):
            own = cell.filter(pa.array(kind == side))
            own = own.take(pa.array(np.argsort(own.column("cluster").to_numpy(), kind="stable")))
            sides.append(own)
        sides = sides * 2 if same else sides
        bars = [cell.column(c).to_numpy()[kind == 2] for c in ("cluster", "other")]
        names, best, near = [s.column("cluster").to_numpy() for s in sides], [], []
        if all(map(len, names)):
            a, b = names
            x, y = (_vectors(s.column("total")) / s.column("n").to_numpy()[:, None] for s in sides)
            wobble = [ties(n) for n in names]
            cells = [_cells(s.column("cells")) for s in sides]
            best, near = [np.full(len(n), -np.inf) for n in names], [np.zeros(len(n), np.int64) for n in names]
            if same:
                best, near = best[:1] * 2, near[:1] * 2
            told = [[], []]
            for p, q in (bars, bars[::-1]):
                at, to = np.searchsorted(a, p), np.searchsorted(b, q)
                there = (at < len(a)) & (to < len(b))
                there[there] = (a[at[there]] == p[there]) & (b[to[there]] == q[there])
                told[0].append(at[there])
                told[1].append(to[there])
            told = [np.concatenate(v) for v in told]
            for lo in range(0, len(a), STRIP):
                hi = min(lo + STRIP, len(a))
                first = lo if same else 0  # within a block each pair is looked at once
                sim = x[lo:hi] @ y[first:].T
                sim[sim < threshold] = -np.inf
                if same:
                    sim[np.tril_indices(hi - lo)] = -np.inf
                here = (told[0] >= lo) & (told[0] < hi) & (told[1] >= first)
                sim[told[0][here] - lo, told[1][here] - first] = -np.inf
                here = slice(*np.searchsorted(cells[0][0], (lo, hi)))
                for p, q in barred_pairs((cells[0][0][here], cells[0][1][here]), cells[1]):
                    sim[p[q >= first] - lo, q[q >= first] - first] = -np.inf
                sim += np.multiply.outer(wobble[0][lo:hi], wobble[1][first:]) * WOBBLE
                for k, span, other, s in ((1, slice(first, len(b)), slice(lo, hi), sim.T), (0, slice(lo, hi), slice(first, len(b)), sim)):
                    top = s.argmax(1)
                    value = s[np.arange(len(s)), top]
                    more = value > best[k][span]
                    best[k][span] = np.where(more, value, best[k][span])
                    near[k][span] = np.where(more, names[1 - k][other][top], near[k][span])
        out = [(names[k][best[k] > -np.inf], near[k][best[k] > -np.inf], best[k][best[k] > -np.inf]) for k in range(len(best))][: 1 if same else 2]
        first, second, third = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"workspace": pa.array([cell.column("workspace")[0].as_py()] * len(first), pa.string()), "cluster": first, "near": second, "sim": third})

    return run


def nearest(clusters: DataFrame, apart: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(workspace, cluster, near, sim): the most similar other cluster of the workspace, ties by a hash of the pair, where
    the mean similarity is `threshold` or more; sim is larger than it by 1e-12 at most.

    clusters: workspace, cluster, n, total, cells: those that share a cell never meet; apart: workspace, a, b that never
    meet either. Clusters are dealt to blocks by hash,
    as many as the workspace needs; each pair of blocks is one group, which compares STRIP rows at once. A cluster is sent to each block once, as any exact search of all pairs in blocks does.
    """
    blocks = clusters.groupBy("workspace").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = clusters.join(blocks, "workspace").withColumn("block", F.pmod(F.xxhash64("cluster"), "blocks"))
    each = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = each.select("workspace", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.when(F.col("block") <= F.col("o"), 0).otherwise(1).alias("side"), "cluster", F.lit(None).cast("long").alias("other"), "n", "total", "cells")
    at = [F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b")]
    bars = apart.join(blocks, "workspace").select("workspace", F.least(*at).alias("i"), F.greatest(*at).alias("j"), F.lit(2).alias("side"), F.col("a").alias("cluster"), F.col("b").alias("other"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("total"), F.lit(None).cast("array<long>").alias("cells"))
    found = rows.unionByName(bars).groupBy("workspace", "i", "j").applyInArrow(_nearest(threshold), _BEST)
    best = found.groupBy("workspace", "cluster").agg(F.max(F.struct("sim", (-F.col("near")).alias("minus"))).alias("b"))
    return best.select("workspace", "cluster", (-F.col("b.minus")).alias("near"), F.col("b.sim").alias("sim"))


def linkage(units: DataFrame, apart: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(workspace, id, cluster): average-linkage clusters of each workspace, named by their smallest id.

    units: workspace (string), id (long, of all workspaces different), n (long), total (array<double>, the sum of n
    vectors), cells (array<long>, may be left out: units that share one never come together, without a row for each
    pair of them); apart: workspace, a, b, ids whose clusters never merge. Two clusters merge while the mean similarity of
    their members is `threshold` or more. A merged cluster's mean similarity to a third lies between those of its parts,
    so all mutual nearest pairs of a round merge at once, and a cluster without a partner is done and leaves the table.
    Tables of rounds are written to the shared folder; nothing but a count reaches the driver.
    """
    spark = units.sparkSession
    cells = F.coalesce("cells", F.array().cast("array<long>")) if "cells" in units.columns else F.array().cast("array<long>")
    t = materialise(units.select("workspace", F.col("id").alias("cluster"), F.col("n").cast("long").alias("n"), "total", cells.alias("cells")), "clusters")
    bars = materialise(apart.where("a != b").select("workspace", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "apart")
    merged: DataFrame | None = None
    while True:
        best = materialise(nearest(t, bars, threshold, block), "nearest")
        back = best.select("workspace", F.col("cluster").alias("near"), F.col("near").alias("cluster"))
        pairs = materialise(best.join(back, ["workspace", "cluster", "near"]).where("cluster < near").select("workspace", F.col("cluster").alias("keep"), F.col("near").alias("gone")), "merges")
        if pairs.isEmpty():
            break
        merged = pairs if merged is None else merged.unionByName(pairs)
        to = pairs.withColumnRenamed("gone", "cluster")
        live = t.join(best.select("workspace", "cluster"), ["workspace", "cluster"], "left_semi").join(to, ["workspace", "cluster"], "left")
        both = live.groupBy("workspace", F.coalesce("keep", "cluster").alias("cluster")).agg(F.sum("n").alias("n"), F.collect_list("total").alias("parts"), F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"))
        total = F.reduce(F.slice("parts", 2, 1), F.element_at("parts", 1), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
        after = materialise(both.select("workspace", "cluster", "n", total.alias("total"), "cells"), "clusters")
        for end in ("a", "b"):
            bars = bars.join(pairs.withColumnRenamed("gone", end), ["workspace", end], "left").withColumn(end, F.coalesce("keep", end)).drop("keep")
        kept = materialise(bars.select("workspace", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "apart")
        release(t)
        release(best)
        t, bars = after, kept
    edges = spark.createDataFrame([], "a long, b long") if merged is None else merged.select(F.col("keep").alias("a"), F.col("gone").alias("b"))
    of = connected_components(edges).select(F.col("vertex").alias("id"), F.col("component").alias("cluster"))
    return units.select("workspace", "id").join(of, "id", "left").select("workspace", "id", F.coalesce("cluster", "id").alias("cluster"))
