"""Embedding near-dedup by robust-pruned flat graphs over overlapping cluster shards.

1. vectors equal in all components form a class, which counts once from there on; lengths are kept apart;
2. spherical k-means on a bounded sample gives centroids; every class goes to its `overlap` nearest shards, so that
   neighbours share one even near a border. Shards that grow beyond four blocks are dealt anew around centroids of
   their own, fitted in tasks, so that shards do not grow with the data. What can't be parted so (a dense cluster) is
   dealt out in blocks by hash;
3. each block builds a graph: nearest candidates, the medoid and some random nodes, pruned by the robust rule (a
   candidate goes when a kept one is `alpha` times nearer to it than the node is), with reverse edges;
4. the adjacency lists that a class got in its shards are united;
5. each pair of blocks of a shard is a task: a greedy beam search from the medoid, over the united lists, which goes on
   through every node in range until no neighbour is; a bounded sample of its queries is compared with a full scan
   (audit), and a task that missed any link scans all of its own rows;
6. links are verified in double precision, counted in the least shard that both ends share, and leave a task only as
   counts and a spanning forest; components join the forests. missed_links() measures the recall of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.ngram_join import _Forest, _links
from reelgrid.operators.components import connected_components
from reelgrid.plans.scratch import materialise

_CHUNK = 256
_NONE = np.iinfo(np.int64).max


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of unit vectors; the same for the same sample."""
    at = sample[np.random.default_rng(5).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ at.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(norm > 0, total / np.maximum(norm, 1e-300), at)
    return at


def _unit(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _flat(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


def _near(x: np.ndarray, at: np.ndarray, overlap: int) -> np.ndarray:
    """The `overlap` centroids nearest to each row of x."""
    most = min(overlap, len(at))
    return np.argpartition(-(x @ at.T), most - 1, 1)[:, :most]


def _assign(shared, overlap: int):
    """mapInArrow: unit vectors and their nearest shards. Shards of one length are numbered from 2 ** 20 times it; a
    length too rare to be in the sample has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            size = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for own in np.unique(size).tolist():
                rows = batch.filter(pa.array(size == own))
                for lo in range(0, len(rows), 2048):
                    part = rows.slice(lo, 2048)
                    x = _unit(part.column("embedding"))
                    near = _near(x, at[own], overlap) if own in at else np.zeros((len(x), 1), np.int64)
                    shards = (near + (own << 20)).astype(np.int64)
                    step = np.arange(len(part) + 1, dtype=np.int32) * shards.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("cid"), part.column("m"), _flat(x), pa.ListArray.from_arrays(step, pa.array(shards.ravel()))], names=["cid", "m", "vec", "shards"]
                    )

    return run


def _fit(block: int):
    """applyInArrow: centroids for a shard from its sample."""

    def run(sample: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v) for v in sample.column("vec").to_pylist()])
        k = max(2, min(64, sample.column("n")[0].as_py() // (block // 2 or 1), len(x) // 8))
        return pa.table({"shard": sample.column("shard").slice(0, 1), "vec": _flat([centroids(x, min(k, len(x))).ravel()])})

    return run


def _deal(overlap: int):
    """mapInArrow over rows sorted by (shard, salt, cid): a shard's centroids, then vectors; gives these their nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for (_, _), rows in _groups(batches, ("shard", "salt", "cid", "m", "vec"), 2, most=4096):
            if rows[0][2] is None:
                at, rows = rows[0][4], rows[1:]
            if not rows:
                continue
            x = np.stack([np.frombuffer(r[4]) for r in rows])
            near = _near(x, np.frombuffer(at).reshape(-1, x.shape[1]), overlap)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.binary()), (0, pa.int64()))] + [pa.array(near.tolist(), pa.list_(pa.int64()))],
                names=["cid", "m", "vec", "shard", "near"],
            )

    return run


def resplit(member: DataFrame, block: int, most: int, parts: int, levels: int = 4, sample: int = 4096, salt: int = 50_000) -> DataFrame:
    """member (cid, m, vec, shard), shards of more than `most` rows dealt anew, each row to the two nearest of up to 64
    centroids of its shard. Centroids come from about `sample` rows a shard; a shard's rows are dealt in several tasks."""
    for level in range(levels):
        large = materialise(member.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most), "large")
        if large.isEmpty():
            break
        big = member.join(large, "shard")
        some = big.where(F.pmod(F.xxhash64("cid", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("n") / sample))) == 0)
        heads = some.select("shard", "n", "vec").groupBy("shard").applyInArrow(_fit(block), "shard long, vec binary")
        salts = F.ceil(F.col("n") / salt).cast("int")
        heads = heads.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("cid"), F.lit(None).cast("long").alias("m"), "vec")
        rows = big.select("shard", F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"), "cid", "m", "vec")
        dealt = heads.unionByName(rows).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "cid")
        dealt = dealt.mapInArrow(_deal(2), "cid long, m long, vec binary, shard long, near array<long>").withColumn("near", F.explode("near"))
        dealt = dealt.select("cid", "m", "vec", F.xxhash64("shard", "near").alias("shard"))
        member = materialise(member.join(large, "shard", "left_anti").select("cid", "m", "vec", "shard").unionByName(dealt), "members")
    return member


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def robust_prune(x: np.ndarray, degree: int, candidates: int, alpha: float) -> list[np.ndarray]:
    """Out-neighbours of each row of x by the robust rule, with reverse edges."""
    n, rng = len(x), np.random.default_rng(n := len(x))
    far = np.unique(np.concatenate(([medoid(x)], rng.integers(0, n, 16))))
    to: list[list[int]] = [[] for _ in range(n)]
    near = min(candidates, n - 1)
    for lo in range(0, n, _CHUNK):
        own = np.arange(lo, min(n, lo + _CHUNK))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -np.inf
        pick = np.argpartition(-sim, near - 1, 1)[:, :near] if near else np.zeros((len(own), 0), int)
        pick = np.concatenate((pick, np.broadcast_to(far, (len(own), len(far)))), 1)
        s = np.take_along_axis(sim, pick, 1)
        order = np.argsort(-s, 1, kind="stable")
        pick, s = np.take_along_axis(pick, order, 1), np.take_along_axis(s, order, 1)
        away, alive, each = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(s, -1))), np.isfinite(s), np.arange(len(own))
        for _ in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            best = pick[each, first]
            for q in each[some]:
                to[own[q]].append(int(best[q]))
            between = np.einsum("qd,qcd->qc", x[best], x[pick], optimize=True)
            alive &= some[:, None] & (alpha * np.sqrt(np.maximum(0, 2 - 2 * between)) > away) & (pick != best[:, None])
    back: list[set[int]] = [set(v) for v in to]
    for a, out in enumerate(to):
        for b in out:
            back[b].add(a)
    return [np.array(sorted(v), np.int64) for v in back]


def range_search(x: np.ndarray, edges: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row of x) pairs of cosine `threshold` or more that a range-expanding greedy search finds.

    What is open to a query is a sparse list: its best and all in range are expanded next, until none is left that is
    in range or among the best `beam` seen. A step costs by what it expands, not by the size of x.
    """
    first = np.concatenate(([0], np.cumsum([len(e) for e in edges])))
    flat = np.concatenate(edges) if first[-1] else np.zeros(0, np.int64)
    start, found = medoid(x), [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(queries), _CHUNK):
        q = queries[lo : lo + _CHUNK]
        seen, best = np.zeros((len(q), len(x)), bool), np.full((len(q), beam), -np.inf)
        who, node = np.arange(len(q)), np.full(len(q), start)
        sim = q @ x[start]
        held_who, held_node, held_sim = who[:0], node[:0], sim[:0]
        while len(who) or len(held_who):
            if len(who):
                seen[who, node] = True
                near = sim >= threshold
                found.append(np.stack((who[near] + lo, node[near])))
                n = np.bincount(who, minlength=len(q))
                place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                wide = np.full((len(q), n.max()), -np.inf)
                wide[who, place] = sim
                best = -np.partition(-np.concatenate((best, wide), 1), beam - 1, 1)[:, :beam]
            w, v, s = np.concatenate((held_who, who)), np.concatenate((held_node, node)), np.concatenate((held_sim, sim))
            worth = s >= np.minimum(best.min(1), threshold)[w]
            w, v, s = w[worth], v[worth], s[worth]
            order = np.lexsort((-s, w))
            w, v, s = w[order], v[order], s[order]
            go = np.concatenate(([True], w[1:] != w[:-1]))[: len(w)] | (s >= threshold)
            held_who, held_node, held_sim = w[~go], v[~go], s[~go]
            w, v = w[go], v[go]
            n = first[v + 1] - first[v]
            to = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[v], n)]
            who, node = np.divmod(np.unique(np.repeat(w, n) * len(x) + to), len(x))
            new = ~seen[who, node]
            who, node = who[new], node[new]
            sim = np.empty(len(who))
            for at in range(0, len(who), 1 << 16):
                sim[at : at + (1 << 16)] = np.einsum("ij,ij->i", q[who[at : at + (1 << 16)]], x[node[at : at + (1 << 16)]])
    a, b = np.concatenate(found, 1)
    return a, b


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int, most: int | None = None):
    """Runs of rows with equal first `keys` columns; at most `most` rows at a time."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in names), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[:keys]):
        while some := list(islice(group, most)):
            yield key, some
            if most is None:
                break


def _build(degree: int, candidates: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ("shard", "blk", "cid", "vec"), 2):
            cid = np.array([r[2] for r in rows])
            edges = robust_prune(np.stack([np.frombuffer(r[3]) for r in rows]), degree, candidates, alpha)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array([cid[e] for e in edges], pa.list_(pa.int64()))], names=["cid", "near"])

    return run


def _full(x: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.nonzero(q[i : i + 1024] @ x.T >= threshold) for i in range(0, len(q), 1024)]
    return np.concatenate([a + 1024 * i for i, (a, _) in enumerate(parts)]), np.concatenate([b for _, b in parts])


def audited_search(x, edges, q, threshold: float, beam: int, audit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """range_search, compared with a scan for up to `audit` of its queries; a scan of all (True) if it missed any link."""
    found = range_search(x, edges, q, threshold, beam)
    some = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    if np.isin(found[0], some).sum() < len(_full(x, q[some], threshold)[0]):
        return *_full(x, q, threshold), True
    return *found, False


def _padded(lists: list[list[int]]) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), _NONE)
    for row, own in zip(out, lists, strict=True):
        row[: len(own)] = own
    return out


def _search(threshold: float, beam: int, audit: int):
    names = ("shard", "i", "j", "cid", "m", "blk", "vec", "shards", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, i, j), rows in _groups(batches, names, 3):
            rows.sort(key=lambda r: r[3])
            cid, m, blk = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
            x, shards = np.stack([np.frombuffer(r[6]) for r in rows]), _padded([r[7] for r in rows])
            place = {c: k for k, c in enumerate(cid.tolist())}
            pairs, searches, scans = [], 0, 0
            for base, ask in {(i, j), (j, i)}:
                own, who = np.flatnonzero(blk == base), np.flatnonzero(blk == ask)
                if not len(own) or not len(who):
                    continue
                local = {int(g): k for k, g in enumerate(own)}
                edges = [np.array([local[p] for c in rows[g][8] if (p := place.get(c)) in local], np.int64) for g in own]
                a, b, scanned = audited_search(x[own], edges, x[who], threshold, beam, audit)
                searches, scans = searches + 1, scans + scanned
                pairs.append(np.stack((who[a], own[b])))
            a, b = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
            a, b = np.divmod(np.unique(np.minimum(a, b)[a != b] * len(cid) + np.maximum(a, b)[a != b]), len(cid))
            good = np.empty(len(a), bool)
            for lo in range(0, len(a), 1 << 16):
                s, t = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                same = (shards[s][:, :, None] == shards[t][:, None, :]).any(2) & (shards[s] != _NONE)
                least = np.where(same, shards[s], _NONE).min(1)
                good[lo : lo + (1 << 16)] = (least == shard) & (np.einsum("ij,ij->i", x[s], x[t]) >= threshold)
            a, b = a[good], b[good]
            links, forest = np.zeros(len(cid), np.int64), _Forest(len(cid))
            np.add.at(links, a, m[b])
            np.add.at(links, b, m[a])
            for s, t in zip(a.tolist(), b.tolist(), strict=True):
                forest.join(s, t)
            # the last row tells of the audit
            yield _links([*((int(cid[k]), int(links[k]), int(cid[forest.find(k)])) for k in np.flatnonzero(links)), (None, searches, scans)])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding, size, cid); size is null for vectors that link with nothing."""
    raw = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    top = F.array_max(F.transform("embedding", F.abs))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (top > 0)
    return raw.withColumn("size", F.when(F.coalesce(fine, F.lit(False)), F.size("embedding"))).withColumn("cid", F.xxhash64("embedding"))


def _centres(cls: DataFrame, sample: int, block: int) -> dict[int, np.ndarray]:
    """Centroids for each length of which the sample holds eight rows or more; as many as blocks, bounded by the sample."""
    column = cls.select("embedding").orderBy("cid").limit(sample).toArrow().column("embedding").combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    rows = {r["size"]: r["n"] for r in cls.where(F.size("embedding").isin(*np.unique(size).tolist())).groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect()} if len(size) else {}
    out = {}
    for own, n in rows.items():
        x = _unit(column.filter(pa.array(size == own)))
        if len(x) >= 8:
            out[own] = centroids(x, max(1, min(n // max(1, block // 2), len(x) // 8)))
    return out


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, overlap: int = 4, block: int = 1024,
    sample: int = 16384, degree: int = 16, candidates: int = 40, alpha: float = 1.2, beam: int = 12, audit: int = 24, report: dict | None = None,
) -> DataFrame:
    """Links between vectors of cosine `threshold` or more, in double precision.

    Returns a row per vector: vec_id, n_links (other vectors linked directly, copies included), component_id (the
    smallest vec_id reachable by links, itself included), kept (vec_id = component_id; null ids are not kept where a
    component has an id). Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths do not link. Repeated rows are vectors of their own. Other columns are left aside.
    sample: rows that the centroids are fitted on at most; every vector is indexed and searched. report, if given,
    takes the number of searches and of those that the audit replaced by a scan.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = _usable(vectors, id_col, vector_col)
    cls = materialise(raw.where("size > 0").groupBy("cid", "embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")), "classes")
    at = _centres(cls, sample, block)
    spread = cls.mapInArrow(_assign(spark.sparkContext.broadcast(at), overlap), "cid long, m long, vec binary, shards array<long>")
    member = materialise(spread.select("cid", "m", "vec", F.explode("shards").alias("shard")), "shards")
    member = resplit(member, block, 4 * block, parts)
    shards = member.groupBy("cid").agg(F.collect_set("shard").alias("shards"))
    blocks = member.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = member.join(blocks, "shard").withColumn("blk", F.pmod(F.xxhash64(F.col("cid") + 1), F.col("blocks")).cast("int"))
    member = materialise(member, "members")
    lists = member.select("shard", "blk", "cid", "vec").repartition(parts, "shard", "blk").sortWithinPartitions("shard", "blk")
    lists = lists.mapInArrow(_build(degree, candidates, alpha), "cid long, near array<long>")
    united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    asked = member.join(united, "cid").join(shards, "cid").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = asked.select("shard", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "cid", "m", "blk", "vec", "shards", "near")
    asked = asked.repartition(parts, "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    found = materialise(asked.mapInArrow(_search(threshold, beam, audit), "cid long, links long, lead long"), "links")
    if report is not None:
        row = found.where("cid is null").agg(F.sum("links"), F.sum("lead")).first()
        report.update(searches=row[0] or 0, scanned=row[1] or 0)
    found = found.where("cid is not null")
    comp = connected_components(found.select(F.col("cid").alias("a"), F.col("lead").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    out = cls.select("cid", "m", "least").join(links, "cid", "left").join(comp.select(F.col("vertex").alias("cid"), "component"), "cid", "left")
    out = out.withColumn("component", F.coalesce("component", "cid"))
    heads = out.groupBy("component").agg(F.min("least").alias("component_id"))
    out = out.join(heads, "component").select("cid", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = raw.where("size > 0").select("vec_id", "cid").join(out, "cid").select("vec_id", "n_links", "component_id")
    alone = raw.where("size is null or size = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _tally(shared, threshold: float):
    """mapInArrow: how many rows of the batches lie within the threshold of each asked vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            same = pc.equal(pc.list_value_length(batch.column("embedding")), own.shape[1])
            x = batch.column("embedding").filter(same)
            for lo in range(0, len(x), 4096):
                total += (own @ _unit(x.slice(lo, 4096)).T >= threshold).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["cid", "n"])

    return run


def missed_links(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, every: int = 20, block: int = 4096) -> DataFrame:
    """(asked, links, found): the recall of near_vectors() over all shards. Every vector whose id is divisible by `every`
    is compared with all vectors, in blocks of about `block` asked ones that are broadcast; found: of near_vectors()."""
    raw = _usable(vectors, id_col, vector_col).where("size > 0")
    asked = raw.where(F.col("vec_id") % every == 0)
    deal = [(r["size"], -(-r["n"] // block)) for r in asked.groupBy("size").agg(F.count("*").alias("n")).collect()]
    out = None
    for size, blocks in deal:
        for k in range(blocks):
            own = asked.where((F.col("size") == size) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)).select("vec_id", "embedding").toArrow()
            if not len(own):
                continue
            shared = vectors.sparkSession.sparkContext.broadcast((own.column("vec_id").to_pylist(), _unit(own.column("embedding"))))
            part = raw.select("embedding").mapInArrow(_tally(shared, threshold), "cid long, n long")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([(0, 0, 0)], "asked long, links long, found long")
    true = out.groupBy("cid").agg((F.sum("n") - 1).alias("n"))
    both = true.join(found.select(F.col("vec_id").alias("cid"), "n_links"), "cid")
    return both.agg(F.count("*").alias("asked"), F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found"))
