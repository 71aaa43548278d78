"""Clusters of mutually similar vectors by parallel pivot correlation clustering.

Vectors are ordered by a hash. Each round takes the next stretch of the order that is still free, of bounded size; its local minima,
those without a similar vector before them, become pivots and absorb all similar vectors (a long stretch is searched for them in tasks). Hot groups
go in the first round, and the vectors that remain meet the next stretch, which grows while most of it has no similar vector. Members that lie far from their pivot stay open and move to a closer pivot
of a later round (nearer than half the threshold distance none can be closer). Clusters are then described by centre, radius, size, medoid and
the members nearest to the centre, and tested: is every pair of members similar, is every member dissimilar to all others?
The medoid is recomputed from the final members: for squared distances the member with the least sum to all others is the one nearest to the mean.

Nothing here emits pairs within a group. Exact copies are collapsed first. A cluster of any size is tested in chunks,
by the triangle inequality where it decides, else by blocks of distances that leave only a verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.vectors import Router, differences, judged, lloyd, nearest, pack, rounding, squared, unpack, usable_vectors
from ridgeline.plans.lineage import cut_lineage, release

ORDER_BITS = 40


@dataclass(frozen=True)
class Clustering:
    """``threshold``: squared distance below which two vectors are similar; ``least``: members of a cluster that counts;
    ``stretch``: vectors of a round per square root of their number, ``most_stretch`` at most, up to ``alone`` the driver finds their minima; ``chunk``: distinct vectors of a cluster that one
    task takes; ``typical``: members that describe a cluster; ``regions``: blocks of regions, between which the search for near clusters is shared out."""

    threshold: float = 350.0
    least: int = 5
    stretch: float = 16.0
    most_stretch: int = 65_536
    alone: int = 8192
    chunk: int = 2048
    typical: int = 3
    regions: int = 8
    seed: int = 11


def local_minima(x: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of a matrix, in order, that are similar to no row chosen before them."""
    chosen: list[int] = []
    pivots = np.zeros((0, x.shape[1]), np.float32)
    for at in range(0, len(x), 512):
        block = x[at : at + 512]
        free = np.flatnonzero(~(judged(block, pivots, threshold) < np.float32(threshold)).any(1)) if len(pivots) else np.arange(len(block))
        near = judged(block[free], block[free], threshold) < np.float32(threshold)
        taken = np.zeros(len(free), bool)
        new = []
        for i in range(len(free)):
            if not taken[i]:
                new.append(at + int(free[i]))
                taken |= near[i]
        chosen += new
        pivots = np.concatenate([pivots, x[new]]) if new else pivots
    return np.array(chosen, np.int64)


def _shared_out(spark: SparkSession, x: np.ndarray, others: np.ndarray | None, threshold: float) -> np.ndarray:
    """Rows of ``x`` that are similar to none of ``others``, or, without them, to no row before them; tasks take 512 rows at a time."""
    shared = spark.sparkContext.broadcast((x, others))
    blocks = -(-len(x) // 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, o = shared.value
        for b in batches:
            for k in b.column(0).to_pylist():
                rows = np.arange(k * 512, min((k + 1) * 512, len(m)))
                end = len(o) if o is not None else int(rows[-1]) + 1
                for at in range(0, end, 2048):
                    if not len(rows):
                        break
                    there = (m if o is None else o)[at : min(at + 2048, end)]
                    near = judged(m[rows], there, threshold) < np.float32(threshold)
                    if o is None:
                        near &= np.arange(at, at + len(there))[None] < rows[:, None]
                    rows = rows[~near.any(1)]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(rows)], names=["row"])

    # Later blocks meet more rows: neighbours in number go to different tasks.
    work = spark.range(blocks, numPartitions=1).repartition(min(blocks, 4 * spark.sparkContext.defaultParallelism), F.xxhash64("id"))
    return np.sort(work.mapInArrow(run, "row bigint").toArrow()["row"].to_numpy())


def first_minima(spark: SparkSession, x: np.ndarray, threshold: float, alone: int) -> np.ndarray:
    """The rows of ``local_minima``, found by tasks: in turn the rows without a similar one before them, and what they leave."""
    left, chosen = np.arange(len(x)), []
    while len(left) > alone:
        new = _shared_out(spark, x[left], None, threshold)
        chosen.append(left[new])
        rest = np.setdiff1d(np.arange(len(left)), new)
        left = left[rest[_shared_out(spark, x[left[rest]], x[left[new]], threshold)]] if len(rest) else left[:0]
    return np.sort(np.concatenate([*chosen, left[local_minima(x[left], threshold)]]))


class _Cuts(list):
    """Cut lineage, and remember what was written so that it can go when nothing reads it any more."""

    def __call__(self, df: DataFrame) -> DataFrame:
        self.append(cut_lineage(df))
        return self[-1]

    def release(self) -> None:
        for df in self:
            release(df)
        self.clear()


def _router(points: np.ndarray, seed: int) -> Router:
    """All points where they are few, else under roots."""
    if len(points) <= Router.ALL:
        return Router(points, np.zeros(len(points), np.int64), points[:1])
    roots, label = lloyd(points, round(math.sqrt(len(points))), np.random.default_rng(seed), 3)
    return Router(points, label, roots)


def _absorb(rows: DataFrame, ids: np.ndarray, pivots: np.ndarray, c: Clustering, dim: int) -> DataFrame:
    """``rows`` (rep, vec, n, pivot, far, touched) after one round; ``touched``: pivots other than its own to which a row is similar."""
    router = _router(pivots, c.seed)
    shared = rows.sparkSession.sparkContext.broadcast((router, ids[router.order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, names = shared.value
        for b in batches:
            x = unpack(b.column(1), dim)
            leaf, d = r.nearest(x, 2, within=c.threshold)
            old, far = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            had = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            far = np.where(had, far, np.inf)
            old = np.where(had, old, -1).astype(np.int64)
            first, near = names[leaf[:, 0]], d[:, 0].astype(np.float64)
            own = np.isin(b.column(0).to_numpy(), names)  # a pivot absorbs itself
            first, near = np.where(own, b.column(0).to_numpy(), first), np.where(own, 0.0, near)
            similar = near < np.float32(c.threshold)
            moves = similar & (near < far)
            pivot = np.where(moves, first, old)
            now = np.where(moves, near, far)
            has = moves | had
            other = np.where(moves & had, old, np.where(similar & ~moves, first, np.where(d[:, 1] < np.float32(c.threshold), names[leaf[:, 1]], -1)))
            touched = other >= 0
            earlier = b.column(5).to_pylist()
            touches = [(e or []) + ([int(o)] if t else []) for e, o, t in zip(earlier, other, touched)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(pivot, mask=~has), pa.array(np.where(has, now, 0.0), mask=~has), pa.array(touches, pa.list_(pa.int64()))],
                names=["rep", "vec", "n", "pivot", "far", "touched"],
            )

    return rows.mapInArrow(run, "rep bigint, vec binary, n bigint, pivot bigint, far double, touched array<bigint>")


def pivot_members(df: DataFrame, id_col: str, vector_col: str, dim: int, c: Clustering, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Rows (rep, vec, n, pivot, far, touched): each distinct usable vector with its smallest id, its copies and its closest pivot."""
    spark = df.sparkSession
    v = usable_vectors(df, id_col, vector_col, dim)
    reps = v.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    rows = cut(reps.select("rep", "vec", "n", none.cast("bigint").alias("pivot"), none.cast("double").alias("far"), none.cast("array<bigint>").alias("touched")))
    least = spark.sparkContext.defaultParallelism
    tasks = max(least, rows.rdd.getNumPartitions())
    place = F.pmod(F.xxhash64("rep", F.lit(c.seed)), F.lit(1 << ORDER_BITS))
    settled = []
    done, grown = 0.0, 1.0  # all places below ``done`` are decided
    while True:
        open_rows, left = rows.agg(F.count(F.lit(1)), F.count_if(F.col("pivot").isNull())).first()
        if not left:
            settled.append(rows)
            break
        rows = rows.coalesce(min(tasks, max(least, -(-open_rows // 2048))))  # as few tasks as the rows that are left need
        free = rows.where(F.col("pivot").isNull())
        want = int(min(c.most_stretch, max(256, c.stretch * grown * math.sqrt(left))))
        # The places are uniform: this share of them holds about the wanted number, whatever the data.
        share = min(1.0, done + (1 - done) * want / left) if want < left else 1.0
        while True:
            stretch = free.where(place < F.lit(int(share * (1 << ORDER_BITS)))).select(place.alias("place"), "rep", "vec") if share < 1 else free.select(place.alias("place"), "rep", "vec")
            t = stretch.toArrow().combine_chunks().sort_by([("place", "ascending"), ("rep", "ascending")])
            if t.num_rows or share >= 1:
                break
            share = min(1.0, share * 2)
        x = unpack(t["vec"].combine_chunks(), dim)
        done = share
        chosen = first_minima(spark, x, c.threshold, c.alone)
        grown = min(grown * 2, 64.0) if len(chosen) > 0.8 * len(x) else 1.0
        out = cut(_absorb(rows, t["rep"].to_numpy()[chosen], x[chosen], c, dim))
        # Within half the threshold distance of its pivot a row cannot be closer to a later pivot.
        open_ = F.col("pivot").isNull() | (F.col("far") > c.threshold / 4)
        settled.append(out.where(~open_))
        rows = out.where(open_)
    return reduce(DataFrame.unionAll, settled).coalesce(tasks)


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of rows that are sorted by their first ``keys`` integer columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, z in zip(cuts, cuts[1:]):
            if last is not None and tuple(k[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[a])
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(t: pa.Table, column: str, dim: int) -> np.ndarray:
    parts = [unpack(x, dim) for x in t[column].chunks]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def all_similar(x: np.ndarray, threshold: float, others: np.ndarray | None = None) -> bool:
    others = x if others is None else others
    return all(not (judged(x[a : a + 512], others[b : b + 2048], threshold) >= np.float32(threshold)).any() for a in range(0, len(x), 512) for b in range(0, len(others), 2048))


def describe(members: DataFrame, dim: int, c: Clustering, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Rows (pivot, centre, radius, size, smallest, clique, typical): one a cluster; ``typical``: members nearest to the centre."""
    half = math.sqrt(c.threshold) / 2 * (1 - 1e-6)
    counts = members.groupBy("pivot").count()
    # Up to 64 chunks; a larger cluster has larger ones, so that its outer members, which visit every chunk, are not copied ever more often.
    chunks = F.least(F.ceil(F.col("count") / c.chunk), F.greatest(F.lit(64), F.ceil(F.col("count") / (64 * c.chunk))))
    large = counts.where(F.col("count") > c.chunk).select("pivot", chunks.cast("int").alias("chunks"))
    # At most one cluster per ``chunk`` vectors is that large.
    chunked = members.join(F.broadcast(large), "pivot", "left").withColumn("chunk", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks"))).cast("int"))
    rows = chunked.select("pivot", "chunk", "rep", "vec", "n", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    spread = rows.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "rep")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in _blocks(batches, 2):
            x, n, ids = _matrix(t, "vec", dim), t["n"].to_numpy(), t["rep"].to_numpy()
            chunks = t["chunks"][0].as_py()
            total = (x.astype(np.float64) * n[:, None]).sum(0)
            centre = (total / n.sum()).astype(np.float32)
            far = np.sqrt(((x.astype(np.float64) - centre) ** 2).sum(1))
            near = np.lexsort((ids, far))[: c.typical]
            clique = bool(far.max() < half) or all_similar(x, c.threshold)
            out.append((t["pivot"][0].as_py(), chunks, centre.tobytes(), float(far.max()), int(n.sum()), len(ids), int(ids.min()), clique, ids[near].tolist(), total.tobytes()))
            if len(out) >= 4096:
                yield _records(out)
                out = []
        if out:
            yield _records(out)

    kinds = "pivot bigint, chunks int, centre binary, radius double, size bigint, vectors bigint, smallest bigint, clique boolean, typical array<bigint>, total binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def _records(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), types)], names=names)

    parts = cut(spread.mapInArrow(fold, kinds))
    columns = ["pivot", "centre", "radius", "size", "smallest", "clique", "typical"]
    whole = parts.where("chunks = 1").select(*columns)
    if large.isEmpty():
        return whole

    def centre_of(t: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(t["total"].to_pylist()), np.float64).reshape(-1, dim).sum(0)
        centre = (total / sum(t["size"].to_pylist())).astype(np.float32)
        return pa.table({"pivot": t["pivot"].slice(0, 1), "centre": pa.array([centre.tobytes()], pa.binary()), "size": pa.array([sum(t["size"].to_pylist())], pa.int64()), "smallest": pa.array([min(t["smallest"].to_pylist())], pa.int64()), "clique": pa.array([all(t["clique"].to_pylist())])})

    centres = cut(parts.where("chunks > 1").groupBy("pivot").applyInArrow(centre_of, "pivot bigint, centre binary, size bigint, smallest bigint, clique boolean"))
    inner = rows.where("chunks > 1").join(F.broadcast(centres.select("pivot", "centre", F.col("clique").alias("so_far"))), "pivot")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.sqrt(differences(unpack(b.column(3), dim), unpack(b.column(6), dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(5), b.column(7), pa.array(far)], names=["pivot", "chunk", "rep", "vec", "chunks", "so_far", "far"])

    measured = cut(inner.select("pivot", "chunk", "rep", "vec", "n", "chunks", "centre", "so_far").mapInArrow(measure, "pivot bigint, chunk int, rep bigint, vec binary, chunks int, so_far boolean, far double"))
    # Two members whose distances to the centre add up to less than the threshold distance are similar: only outer members are tested.
    outer = measured.where((F.col("far") >= half) & F.col("so_far")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("kind", F.lit(1))
    tests = measured.where("so_far").withColumn("kind", F.lit(0)).unionByName(outer).select("pivot", "chunk", "kind", "rep", "vec").repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "kind")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = [], None
        for t in _pieces(batches, 3, 4096):
            k = (t["pivot"][0].as_py(), t["chunk"][0].as_py())
            if k != key:
                own, key = [], k
            x = _matrix(t, "vec", dim)
            if t["kind"][0].as_py() == 0:
                own.append(x)
            elif own and not all(all_similar(x, c.threshold, o) for o in own):
                yield pa.RecordBatch.from_arrays([pa.array([k[0]], pa.int64())], names=["pivot"])

    broken = tests.mapInArrow(test, "pivot bigint").distinct().withColumn("broken", F.lit(True))
    radius = measured.groupBy("pivot").agg(F.max("far").alias("radius"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            far = b.column(2).to_numpy()
            for p in np.unique(b.column(0).to_numpy()):
                at = np.flatnonzero(b.column(0).to_numpy() == p)
                ids = b.column(1).to_numpy()[at]
                o = np.lexsort((ids, far[at]))[: c.typical]
                best[int(p)] = sorted(best.get(int(p), []) + list(zip(far[at][o].tolist(), ids[o].tolist())))[: c.typical]
        flat = [(p, f, i) for p, v in best.items() for f, i in v]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*flat), (pa.int64(), pa.float64(), pa.int64()))], names=["pivot", "far", "rep"])

    typical = measured.select("pivot", "rep", "far").mapInArrow(top, "pivot bigint, far double, rep bigint").groupBy("pivot").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("far", "rep"))), 1, c.typical), lambda s: s["rep"]).alias("typical"))
    big = centres.join(radius, "pivot").join(typical, "pivot").join(broken, "pivot", "left").withColumn("clique", F.col("clique") & F.col("broken").isNull())
    return whole.unionByName(big.select(*columns))


def _pieces(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Like _blocks, but a group comes in pieces of bounded size."""
    for b in batches:
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, z in zip(cuts, cuts[1:]):
            for at in range(a, z, most):
                yield pa.Table.from_batches([b.slice(at, min(most, z - at))])


def region_extents(roots: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region of each cluster, the one with the nearest root, and how far from that root the cluster's ball reaches)."""
    region = nearest(x, roots)[0]
    return region, np.sqrt(((x.astype(np.float64) - roots[region]) ** 2).sum(1)) + radius


def reached(roots: np.ndarray, extent: np.ndarray, x: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Per cluster and region: whether the ball can come within ``reach`` of a ball of the region; ``extent`` of an empty region is negative infinity."""
    far = np.sqrt(np.maximum(squared(x, roots) - rounding(x)[:, None] - rounding(roots)[None], 0))
    return ~(far > (radius[:, None] + reach + extent[None]) * (1 + 1e-5))


def _near_clusters(clusters: DataFrame, dim: int, c: Clustering) -> DataFrame:
    """Pairs (a, b) of clusters, a one that may count, whose balls come within the threshold distance.

    Each cluster lives in the region of its nearest root; a candidate visits the blocks of regions that it can reach. Blocks are few, so that a
    candidate is seldom copied, but a task holds no more than about 65,536 clusters of a block.
    """
    reach = math.sqrt(c.threshold)
    total = clusters.count()
    share = min(1.0, 4096 / max(1, total))
    sample = clusters.where(F.pmod(F.xxhash64("pivot", F.lit(c.seed + 1)), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20))))).select("centre").toArrow().combine_chunks()
    x = unpack(sample["centre"].combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim), np.float32)
    # Leaves of a router lie beside those of the same root.
    roots = Router.fit(x, max(1, min(len(x), round(total / 256))), c.seed).leaves if len(x) else np.zeros((1, dim), np.float32)
    shared = clusters.sparkSession.sparkContext.broadcast(roots)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region, ball = region_extents(shared.value, unpack(b.column(0), dim), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int32)), pa.array(ball)], names=["region", "ball"])

    sizes = clusters.select("centre", "radius").mapInArrow(settle, "region int, ball double").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("ball").alias("extent")).toArrow()
    n, extent = np.zeros(len(roots), np.int64), np.full(len(roots), -np.inf)
    n[sizes["region"].to_numpy()], extent[sizes["region"].to_numpy()] = sizes["n"].to_numpy(), sizes["extent"].to_numpy()
    block = ((np.cumsum(n) - n) // max(2048, min(-(-total // c.regions), 65_536))).astype(np.int32)
    plan = clusters.sparkSession.sparkContext.broadcast((extent, block))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, of = plan.value
        starts = np.flatnonzero(np.r_[True, np.diff(of) > 0])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                y, rad = unpack(b.column(1), dim), b.column(2).to_numpy()
                home = of[region_extents(shared.value, y, rad)[0]]
                asks = np.flatnonzero(b.column(3).to_numpy() == 0)
                visits = np.logical_or.reduceat(reached(shared.value, far, y[asks], rad[asks], reach), starts, axis=1)
                i, j = np.nonzero(visits)
                took = pa.array(np.r_[np.arange(len(home)), asks[i]])
                kinds = np.r_[np.zeros(len(home), np.int32), np.ones(len(i), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[home, of[starts[j]]].astype(np.int32)), pa.array(kinds), b.column(0).take(took), b.column(1).take(took), b.column(2).take(took)], names=["region", "kind", "pivot", "centre", "radius"])

    kind = F.when(F.col("candidate"), 0).otherwise(1).cast("int").alias("kind")
    rows = clusters.select("pivot", "centre", "radius", kind).mapInArrow(spread, "region int, kind int, pivot bigint, centre binary, radius double")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, region = [], None
        for t in _pieces(batches, 2, 2048):
            if (r := t["region"][0].as_py()) != region:
                held, region = [], r
            y, rad, ids = _matrix(t, "centre", dim), t["radius"].to_numpy(), t["pivot"].to_numpy()
            if t["kind"][0].as_py() == 0:
                held.append((y, rad, ids))
                continue
            a, b = [], []
            for hx, hr, hi in held:
                limit = ((hr[:, None] + rad[None] + reach) * (1 + 1e-5)) ** 2
                i, j = np.nonzero(judged(hx, y, limit) < limit.astype(np.float32))
                ok = hi[i] != ids[j]
                a.append(hi[i[ok]])
                b.append(ids[j[ok]])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    pairs = rows.repartition("region").sortWithinPartitions("region", "kind").mapInArrow(meet, "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _touching(members: DataFrame, clusters: DataFrame, pairs: DataFrame, dim: int, c: Clustering, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Rows (pivot): clusters of ``pairs`` that have a member similar to a member of the other."""
    reach = math.sqrt(c.threshold) * (1 + 1e-5)
    info = clusters.select(F.col("pivot").alias("other"), "centre", "radius")
    sides = pairs.select("a", "b", F.col("a").alias("pivot"), F.col("b").alias("other"), F.lit(0).alias("side")).unionAll(pairs.select("a", "b", F.col("b").alias("pivot"), F.col("a").alias("other"), F.lit(1).alias("side")))
    rows = sides.join(info, "other").join(members.select("pivot", "rep", "vec"), "pivot").select("a", "b", "side", "rep", "vec", "centre", "radius")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(differences(unpack(b.column(4), dim), unpack(b.column(5), dim)))
            ok = pa.array(np.flatnonzero(d < (b.column(6).to_numpy() + reach) * (1 + 1e-9)))
            yield pa.RecordBatch.from_arrays([b.column(i).take(ok) for i in range(5)], names=["a", "b", "side", "rep", "vec"])

    kept = cut(rows.mapInArrow(close, "a bigint, b bigint, side int, rep bigint, vec binary"))
    # The first side is cut into chunks of bounded size, the second goes to each of them.
    sizes = kept.where("side = 0").groupBy("a", "b").agg(F.ceil(F.count(F.lit(1)) / c.chunk).cast("int").alias("chunks"))
    split = kept.join(sizes, ["a", "b"]).withColumn("chunk", F.explode(F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for t in _pieces(batches, 4, 2048):
            k = tuple(t[x][0].as_py() for x in ("a", "b", "chunk"))
            if k != key:
                held, key = [], k
            x = _matrix(t, "vec", dim)
            if t["side"][0].as_py() == 0:
                held.append(x)
            elif any((judged(h, x, c.threshold) < np.float32(c.threshold)).any() for h in held):
                yield pa.RecordBatch.from_arrays([pa.array([k[0], k[1]], pa.int64())], names=["pivot"])

    return split.select("a", "b", "chunk", "side", "vec").repartition("a", "b", "chunk").sortWithinPartitions("a", "b", "chunk", "side").mapInArrow(meet, "pivot bigint")


def similarity_clusters(df: DataFrame, id_col: str, vector_col: str, *, dim: int, clustering: Clustering = Clustering()) -> tuple[DataFrame, DataFrame]:
    """(clusters, membership).

    clusters: (cluster, size, radius, mutual, isolated, medoid, typical), one row a cluster, whatever its size; ``cluster`` is the smallest id of its members, ``typical`` the
    members nearest to its centre, ``medoid`` the first of them, which has the least sum of squared distances to all members, ``mutual`` whether all members are similar to each other, ``isolated`` whether no member is known to be similar to a vector outside.
    membership: (cluster, id_col), one row a usable vector. ``isolated`` is worked out only for mutual clusters of at least ``least`` members, others have null there.

    Defined cases: unusable vectors, and rows without an id (an integer), belong to no cluster; exact copies share a cluster and count each; a vector without a similar one is a cluster of its
    own; repeated ids with one vector count each; ties in distance go to the smaller id; further columns are ignored; an empty table gives no rows.
    Pivots, absorption, sizes, ``mutual`` and ``isolated`` are exact: no search is cut short.
    """
    c, cut = clustering, _Cuts()
    members = pivot_members(df, id_col, vector_col, dim, c, cut)
    described = cut(describe(members, dim, c, cut))
    touched = members.where(F.size("touched") > 0).select(F.explode(F.concat(F.col("touched"), F.array("pivot"))).alias("pivot")).distinct().withColumn("hit", F.lit(True))
    marked = described.join(touched, "pivot", "left").withColumn("candidate", F.col("clique") & (F.col("size") >= c.least) & F.col("hit").isNull())
    marked = cut(marked)
    pairs = cut(_near_clusters(marked, dim, c))
    joined = _touching(members, marked, pairs, dim, c, cut).distinct().withColumn("met", F.lit(True))
    isolated = F.when(F.col("clique") & (F.col("size") >= c.least), F.col("hit").isNull() & F.col("met").isNull())
    final = cut_lineage(marked.join(joined, "pivot", "left").select("pivot", F.col("smallest").alias("cluster"), "size", "radius", F.col("clique").alias("mutual"), isolated.alias("isolated"), F.get("typical", F.lit(0)).alias("medoid"), "typical"))
    # Copies find their cluster by a digest of the vector, so that no list of a group's ids is ever built.
    key = F.md5("vec").alias("key")
    of = cut_lineage(members.select(key, "pivot").join(final.select("pivot", "cluster"), "pivot").select("key", "cluster"))
    cut.release()
    membership = usable_vectors(df, id_col, vector_col, dim).select(key, F.col("id").alias(id_col)).join(of, "key").select("cluster", id_col)
    return final.drop("pivot"), membership
