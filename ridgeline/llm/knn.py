"""The k most similar vectors of every query, by an adaptive dimension scan of probed lists.

Lists are the leaves of a two-level k-means, cut into bands by the distance to the centre. Each query probes the lists that can
hold one of its k nearest vectors by the triangle inequality, the most promising ones first. A query that had more of them asks again:
with the k-th distance found as its bound it probes every list that the bound leaves. Lists are packed into cells of bounded
size. Vectors are shuffled to their cells once; queries, which may probe lists in every cell, are never shuffled to them: they lie in files that all
executors share, and each task of some cells reads a share of them and finds out which of its lists they probe. Inside a cell the vectors are rotated and lie in column blocks: the first block's
partial distances come from a matrix product, and after each block a hypothesis test abandons the candidates whose distance,
as estimated from the dimensions seen so far, is above the query's current k-th distance. Survivors are measured exactly.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.vectors import Router, differences, hashed_sample, pack, rounding, squared, unpack, usable_vectors
from ridgeline.plans.lineage import cut_lineage, release, scratch_folder

CLASSES = 1 << 20  # codes from here on are classes of tags


@dataclass(frozen=True)
class Search:
    """``lists_per_root_n``: lists per square root of the number of vectors, ``most_lists`` at most; ``sample_rows``: rows a list to fit the
    centres, ``most_sample`` in all (the only sampling: every vector is indexed); ``probes``: lists that one query probes at first, beyond those it
    needs to see k candidates; ``cell_rows``: vectors of one cell; ``risk``: of a false abandonment by one hypothesis test; ``guides``: vectors of the sample whose distances bound a query's k-th one before it probes; ``most_tags``: most frequent tags with
    statistics of their own, the others share as many classes; ``task_queries``: about how many queries a task takes to its cells, read in blocks of ``plan_queries``; ``most_parts``: partitions that the cells are spread over, if the cores are not more; ``most_held``: rows that a task keeps before it passes them on."""

    lists_per_root_n: float = 16.0
    most_lists: int = 65_536
    sample_rows: int = 16
    most_sample: int = 262_144
    probes: int = 512
    cell_rows: int = 8192
    blocks: tuple[int, ...] = (8, 16, 32)
    risk: float = 0.001
    most_tags: int = 64
    guides: int = 16_384
    task_queries: int = 16_384
    plan_queries: int = 2048
    most_parts: int = 128
    most_held: int = 1 << 20
    seed: int = 7

    def sizes(self, rows: int) -> tuple[int, int]:
        """(rows to sample, lists) for so many usable vectors."""
        lists = int(min(self.most_lists, max(4, self.lists_per_root_n * rows**0.5)))
        return min(self.most_sample, self.sample_rows * lists), lists


class Codes:
    """Numbers of tags: of the most frequent ones their place, of the others one of as many classes, by a digest that Spark has too."""

    def __init__(self, tops: list[str]):
        self.place, self.classes = {t: i for i, t in enumerate(tops)}, max(1, len(tops))

    def column(self, name: str) -> Column:
        out = F.when(F.col(name).isNull(), F.lit(-3)).otherwise(F.lit(CLASSES) + F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(self.classes)))
        known = F.create_map(*[F.lit(x) for t, i in self.place.items() for x in (t, i)]) if self.place else None
        return F.coalesce(F.try_element_at(known, F.col(name)), out).cast("bigint") if known is not None else out.cast("bigint")

    def of(self, column: pa.Array, none: int) -> np.ndarray:
        once = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
        numbers = np.array([self.place.get(t, CLASSES + zlib.crc32(t.encode()) % self.classes) for t in once.dictionary.to_pylist()] + [none], np.int64)
        return numbers[once.indices.fill_null(len(numbers) - 1).to_numpy()]


def copies_of(ids: np.ndarray, x: np.ndarray, tags: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, ids): one row of each group of equal vectors with equal tags, in the order of the lists, and the groups' ids, smallest first, from ``starts`` on."""
    marks = np.random.default_rng(1).integers(1 << 62, size=x.shape[1] + 1)
    whole = np.ascontiguousarray(np.concatenate([x.view(np.int32), tags.astype(np.int32)[:, None]], 1))
    with np.errstate(over="ignore"):
        digest = whole.astype(np.int64) @ marks
    if len(np.unique(digest)) == len(x):
        return np.arange(len(x)), np.arange(len(x) + 1), ids
    _, first, group = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 4)))[:, 0], return_index=True, return_inverse=True)
    place = np.argsort(lists[first], kind="stable")
    number = np.empty(len(place), np.int64)
    number[place] = np.arange(len(place))
    group = number[group]
    return first[place], np.concatenate([[0], np.cumsum(np.bincount(group))]), ids[np.lexsort((ids, group))]


def scan_cell(ids: np.ndarray, x: np.ndarray, tags: np.ndarray, lists: np.ndarray, qids: np.ndarray, q: np.ndarray, ks: np.ndarray, wanted: np.ndarray, probes: pa.ListArray, bound: np.ndarray, turn: tuple[np.ndarray, list[float]], s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, exact squared distances) of up to k candidates a query. ``tags``, ``wanted``: codes, -1 wants any. Copies are measured once."""
    kept, starts, ids = copies_of(ids, x, tags, lists)
    weight, alone = np.diff(starts), len(kept) == len(ids)
    if not alone:
        x, tags, lists = x[kept], tags[kept], lists[kept]
    dim = x.shape[1]
    bounds = [0, *[b for b in s.blocks if b < dim], dim]
    rot, factor = turn
    centre, turned = np.median(x[:64], axis=0).astype(np.float64), rot.astype(np.float64)
    with np.errstate(over="ignore"):
        xr, qr = (((m.astype(np.float64) - centre) @ turned).astype(np.float32) for m in (x, q))
        wx, wq = rounding(xr), rounding(qr)  # what the float32 distances may be wrong by
        wx4 = (wx * 1.001).astype(np.float32)
    xb = [np.ascontiguousarray(xr[:, a:b]) for a, b in zip(bounds, bounds[1:])]
    qb = [np.ascontiguousarray(qr[:, a:b]) for a, b in zip(bounds, bounds[1:])]
    ends = probes.offsets.to_numpy()
    who, which = np.repeat(np.arange(len(q)), np.diff(ends)), probes.values.to_numpy()[ends[0] : ends[-1]]
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    tau = bound * (1 + 1e-4) + 1e-3
    got_q, got_x, got_d = [], [], []
    for l in np.unique(which):
        a, b = np.searchsorted(lists, [l, l + 1])
        if a == b:
            continue
        mine = who[np.searchsorted(which, l) : np.searchsorted(which, l, "right")]
        for at in range(0, len(mine), 1024):
            rows = mine[at : at + 1024]
            part = squared(qb[0][rows], xb[0][a:b])
            keep = ~(part - wx4[a:b] > (tau[rows] * factor[0] + wq[rows])[:, None])
            if (wanted[rows] != -1).any():
                keep &= (wanted[rows] == -1)[:, None] | (wanted[rows][:, None] == tags[a:b][None])
            t = 1
            while t < len(xb) and keep.mean() > 0.1:  # while most survive, a product is cheaper than picking pairs
                part += squared(qb[t][rows], xb[t][a:b])
                keep &= ~(part - wx4[a:b] > (tau[rows] * factor[t] + wq[rows])[:, None])
                t += 1
            i, j = np.nonzero(keep)
            d = part[i, j]
            for t in range(t, len(xb)):
                if not len(i):
                    break
                diff = xb[t][a + j] - qb[t][rows[i]]
                d = d + np.einsum("ij,ij->i", diff, diff)
                ok = ~(d > tau[rows[i]] * factor[t] + wq[rows[i]] + wx[a + j])
                i, j, d = i[ok], j[ok], d[ok]
            if not len(i):
                continue
            o = np.lexsort((d, i))
            i, j, d = i[o], j[o], d[o]
            if alone:
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                begins, kth = rank == 0, rank == ks[rows[i]] - 1
            else:
                begins, upto = _cumulated(i, weight[a + j])
                kth = (upto >= ks[rows[i]]) & (upto - weight[a + j] < ks[rows[i]])
            # Before the k-th of them some other may be wrong by more.
            wrong = wq[rows[i]] + np.maximum.reduceat(wx[a + j], np.flatnonzero(begins))[np.cumsum(begins) - 1]
            tau[rows[i[kth]]] = np.fmin(tau[rows[i[kth]]], (d[kth] + wrong[kth]) * (1 + 1e-4) + 1e-3)
            near = ~(d > tau[rows[i]] + wrong)
            got_q.append(rows[i[near]])
            got_x.append(a + j[near])
            got_d.append(d[near])
    if not got_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = np.concatenate(got_q), np.concatenate(got_x), np.concatenate(got_d)
    ok = ~(d > tau[i] + wq[i] + wx[j])
    i, j = i[ok], j[ok]
    exact = np.concatenate([((x[j[c : c + 65536]].astype(np.float64) - q[i[c : c + 65536]]) ** 2).sum(1) for c in range(0, len(i), 65536)] or [np.zeros(0)])
    o = np.lexsort((exact, i))
    i, j, exact = i[o], j[o], exact[o]
    # Up to the distance of the k-th candidate, ties with it too; of each group of copies the k smallest ids; then the k best.
    begins, upto = _cumulated(i, weight[j])
    limit = np.full(len(q), np.inf)
    at_k = np.flatnonzero((upto >= ks[i]) & (upto - weight[j] < ks[i]))
    limit[i[at_k]] = exact[at_k]
    ok = exact <= limit[i]
    i, j, exact = i[ok], j[ok], exact[ok]
    many = np.minimum(weight[j], ks[i])
    of = np.repeat(np.arange(len(i)), many)
    found = ids[np.repeat(starts[j], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
    i, exact = i[of], exact[of]
    o = np.lexsort((found, exact, i))
    i, found, exact = i[o], found[o], exact[o]
    best = np.arange(len(i)) - np.searchsorted(i, i) < ks[i]
    return qids[i[best]], found[best], exact[best]


def _cumulated(group: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where a group begins, weights up to each row within its group) of rows in the order of their groups."""
    begins = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    total = np.cumsum(weight)
    before = (total - weight)[begins]
    return begins, total - (before[np.cumsum(begins) - 1] if len(group) else 0)


def nearest_vectors(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, k: str, *, dim: int, tag: str | None = None, wanted: str | None = None, search: Search = Search()) -> DataFrame:
    """Rows (query_id, id_col, _distance): for each query with a usable vector its ``k`` nearest usable vectors by squared L2.

    With ``tag`` (a column of ``vectors``) and ``wanted`` (of ``queries``), a query whose ``wanted`` is set meets only vectors
    with that tag: it is a filter before the search. Tags may be of any number; those beyond the most frequent ones share classes and are compared by themselves in the scan.

    Defined cases: unusable vectors (null, another length, a null or non-finite element, all zero) are no candidates and no queries; a vector
    equal to the query counts; rows and queries without an id are left out (ids are integers); equal distances go to the smaller id; a repeated query id is asked once; repeated vectors are candidates
    each; k of null, zero or less gives nothing; fewer than k candidates all come out; empty tables give no rows;
    further columns are ignored. Exact but for the hypothesis test of the first pass; the second pass abandons only what is too far.
    """
    spark, s = vectors.sparkSession, search
    v = usable_vectors(vectors, id_col, vector_col, dim, [tag] if tag else [])
    v = v.withColumnRenamed("x0", "tag") if tag else v.withColumn("tag", F.lit(None).cast("string"))
    once = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"), F.col(k).cast("int").alias("k"), (F.col(wanted) if wanted else F.lit(None).cast("string")).alias("wanted"))
    once = once.where(F.col("k") > 0).dropDuplicates(["qid"])
    q = usable_vectors(once, "qid", "qv", dim, ["k", "wanted"]).toDF("id", "k", "wanted", "vec")
    names = (query_id, id_col, "_distance")
    total = vectors.count()
    want, lists = s.sizes(total)
    sample, marks = hashed_sample(v, want, total, s.seed, dim, ["tag"])[1:]
    if len(sample) < want / 2 and len(sample) < total:  # many rows have no usable vector: only those that have one count
        total = v.count()
        want, lists = s.sizes(total)
        sample, marks = hashed_sample(v, want, total, s.seed, dim, ["tag"])[1:]
    if not len(sample):
        return spark.createDataFrame([], f"`{names[0]}` bigint, `{names[1]}` bigint, _distance double")
    router = Router.fit(sample, min(lists, len(sample)), s.seed)
    turn = fit_rotation(sample, s)
    bands = np.quantile(np.sqrt(differences(sample, router.leaves[router.nearest(sample)[0][:, 0]])), [0.5, 0.9])
    shared = spark.sparkContext.broadcast((router, turn, bands))
    n_bands = len(bands) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, _, edges = shared.value
        for b in batches:
            m = unpack(b.column(1), dim)
            leaf = r.nearest(m)[0]
            far = np.sqrt(differences(m, r.leaves[leaf[:, 0]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array((leaf[:, 0] * n_bands + np.searchsorted(edges, far)).astype(np.int32)), pa.array(far)], names=["id", "vec", "tag", "list", "far"])

    placed = cut_lineage(v.select("id", "vec", "tag").mapInArrow(assign, "id bigint, vec binary, tag string, list int, far double"))
    # The most frequent tags have codes of their own, the others share classes by a digest: a row per list, band and class, bounded whatever the data.
    tops = [r["tag"] for r in placed.where(F.col("tag").isNotNull()).groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(s.most_tags).collect()] if tag else []
    code = Codes(tops)
    stats = placed.withColumn("tag", code.column("tag")).groupBy("list", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.avg(F.col("far") * F.col("far")).alias("mean")).toArrow().sort_by("list")
    st_list, st_n = stats["list"].to_numpy().astype(np.int64), stats["n"].to_numpy()
    st_tag = stats["tag"].to_numpy().astype(np.int64)
    st = (st_list, st_tag, st_n, stats["low"].to_numpy(), stats["high"].to_numpy(), stats["mean"].to_numpy())
    # Neighbouring lists share a cell; a list beyond the size of a cell has several, its vectors spread by id.
    used, at = np.unique(st_list, return_inverse=True)
    sizes = np.bincount(at, st_n).astype(np.int64)
    cell_of, parts, cell, filled = np.zeros(len(router.leaves) * n_bands, np.int32), np.ones(len(router.leaves) * n_bands, np.int32), 0, 0
    for l, n in zip(used, sizes):
        if n > s.cell_rows or filled + n > s.cell_rows:
            cell, filled = cell + (filled > 0), 0
        cell_of[l], parts[l] = cell, max(1, -(-n // s.cell_rows))
        filled += n
        if n > s.cell_rows:
            cell, filled = cell + parts[l], 0
    guide = (sample[: s.guides], code.of(marks[0].slice(0, s.guides), -3))
    cells = int(max((cell_of + parts).max(), 1))
    tasks = min(cells, max(spark.sparkContext.defaultParallelism, s.most_parts))
    plan = spark.sparkContext.broadcast((st, code, cell_of, parts, guide))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, home, split, _ = plan.value
        for b in batches:
            l = b.column(3).to_numpy()
            h = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = home[l] + (h % split[l].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(b.column(c) for c in (3, 0, 1, 2))], names=["cell", "list", "id", "vec", "tag"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value[0]
        table, codes, _, _, near = plan.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                _, _, bound, cutoff = route(unpack(b.column(3), dim), b.column(1).to_numpy(), codes.of(b.column(2), -1), r, table, n_bands, s, near)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), pa.array(cutoff)], names=["id", "k", "wanted", "vec", "bound", "cutoff"])

    def meet(queries: DataFrame, last: bool) -> DataFrame:
        """Every cell meets all queries where it lies: a task reads a share of them from the shared folder and routes it to its own cells, so no row a query and cell is shuffled."""
        files = _written(queries, s.plan_queries)
        blocks = [(path, i) for path, n, _ in files for i in range(n)]
        shares = max(1, min(len(blocks), -(-sum(n for _, _, n in files) // s.task_queries), 20_000 // tasks))

        def scan(own: list[tuple[str, int]]) -> Callable:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                if not own:  # no queries
                    return
                r, (rot, factor), _ = shared.value
                turn = (rot, [1.0] * len(factor) if last else factor)  # a partial distance beyond the bound rules out for certain
                share = None
                for vs in _cells(batches):
                    share = share or Share(own, plan.value[1], dim)
                    share.scan(vs, r, plan.value[0], n_bands, turn, s)
                    if share.held > s.most_held:
                        yield share.taken()
                if share:
                    yield share.taken()

            return run

        return reduce(DataFrame.unionAll, [placed.mapInArrow(scan(blocks[i::shares]), "qid bigint, id bigint, d double, k int") for i in range(shares)])

    listed = placed
    placed = cut_lineage(listed.mapInArrow(to_cells, "cell int, list int, id bigint, vec binary, tag string").repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "list"))
    release(listed)
    asked = cut_lineage(q.mapInArrow(ask, "id bigint, k int, wanted string, vec binary, bound double, cutoff double"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))
    best = cut_lineage(meet(asked, False)).withColumn("rank", rank).where(F.col("rank") <= F.col("k"))
    left = asked.where(F.col("cutoff") < F.lit(float("inf")))  # these have lists left
    if not left.isEmpty():
        kth = best.where(F.col("rank") == F.col("k")).select(F.col("qid").alias("id"), F.col("d").alias("tau"))
        again = left.join(kth, "id", "left").select("id", "k", "wanted", "vec", F.coalesce("tau", F.lit(float("inf"))).alias("bound"), F.lit(float("inf")).alias("cutoff"))
        both = best.drop("rank").withColumn("turn", F.lit(1)).unionAll(meet(again, True).withColumn("turn", F.lit(2)))
        # The second answer of a query is whole: it takes the place of the first.
        last = both.withColumn("last", F.max("turn").over(Window.partitionBy("qid"))).where(F.col("turn") == F.col("last"))
        best = last.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))
    return best.select(F.col("qid").alias(names[0]), F.col("id").alias(names[1]), F.col("d").alias("_distance"))


def _written(queries: DataFrame, most: int) -> list[tuple[str, int, int]]:
    """(path, blocks, rows) of the files of the queries, in a folder that all executors share; a block has ``most`` rows at most."""
    folder = scratch_folder(queries.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, rows, path = None, 0, 0, f"{folder}/{uuid.uuid4().hex}"  # an attempt has a file of its own
        for b in batches:
            if out is None and b.num_rows:
                os.makedirs(folder, exist_ok=True)
                out = pa.ipc.new_file(path, b.schema)
            for at in range(0, b.num_rows, most):
                out.write_batch(b.slice(at, most))
                n += 1
            rows += b.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([rows], pa.int64())], names=["path", "n", "rows"])

    return sorted((x["path"], x["n"], x["rows"]) for x in queries.mapInArrow(write, "path string, n bigint, rows bigint").collect())


class Share:
    """Some of the queries, the best that a task's cells hold for each so far, and the bound that follows from them."""

    def __init__(self, blocks: list[tuple[str, int]], codes: Codes, dim: int):
        files = {path: pa.ipc.open_file(pa.memory_map(path)) for path in {path for path, _ in blocks}}
        t = pa.Table.from_batches([files[path].get_batch(i) for path, i in blocks]).combine_chunks()
        column = lambda c: pa.concat_arrays(t[c].chunks)
        self.ids, self.ks, self.wanted, self.m = column("id").to_numpy(), column("k").to_numpy(), column("wanted").cast(pa.string()), unpack(column("vec"), dim)
        self.bound, self.cutoff, self.tags = column("bound").to_numpy().copy(), column("cutoff").to_numpy(), codes.of(self.wanted, -1)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    @property
    def held(self) -> int:
        return len(self.best[0])

    def taken(self) -> pa.RecordBatch:
        i, ids, d = self.best
        self.best = i[:0], ids[:0], d[:0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(ids), pa.array(d), pa.array(self.ks[i])], names=["qid", "id", "d", "k"])

    def scan(self, vs: dict[str, pa.Array], r: Router, table: tuple, n_bands: int, turn: tuple[np.ndarray, list[float]], s: Search) -> None:
        """Meets a cell's vectors, in the order of their lists."""
        lists, x = vs["list"].to_numpy(), unpack(vs["vec"], self.m.shape[1])
        own = np.isin(table[0], np.unique(lists))
        who, which = probed(self.m, self.tags, self.bound, self.cutoff, r, tuple(c[own] for c in table), n_bands)
        asks, first = np.unique(who, return_index=True)
        ends = np.r_[first, len(who)]
        for at in range(0, len(asks), 2048):
            rows = asks[at : at + 2048]
            few, wanted, tags = ends[at : at + 2049], self.wanted.take(pa.array(rows)), (np.full(len(x), -3), np.full(len(rows), -1))
            if wanted.null_count < len(rows):  # the tags themselves, numbered within the cell
                same = pa.concat_arrays([vs["tag"], wanted]).dictionary_encode().indices
                there, number = same.is_valid().to_numpy(zero_copy_only=False), same.fill_null(0).to_numpy()
                tags = np.where(there[: len(x)], number[: len(x)], -3), np.where(there[len(x) :], number[len(x) :], -1)
            probes = pa.ListArray.from_arrays(pa.array((few - few[0]).astype(np.int32)), pa.array(which[few[0] : few[-1]].astype(np.int32)))
            self.add(*scan_cell(vs["id"].to_numpy(), x, tags[0], lists, rows, self.m[rows], self.ks[rows], tags[1], probes, self.bound[rows], turn, s))

    def add(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        if not len(i):
            return
        new = np.zeros(len(self.ids), bool)
        new[i] = True
        old = new[self.best[0]]
        i, ids, d = (np.concatenate([b[old], more]) for b, more in zip(self.best, (i, ids, d)))
        o = np.lexsort((ids, d, i))
        i, ids, d = i[o], ids[o], d[o]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kth = place == self.ks[i] - 1
        self.bound[i[kth]] = np.fmin(self.bound[i[kth]], d[kth])
        ok = place < self.ks[i]
        self.best = tuple(np.concatenate([b[~old], more[ok]]) for b, more in zip(self.best, (i, ids, d)))


def fit_rotation(sample: np.ndarray, s: Search) -> tuple[np.ndarray, list[float]]:
    """(rotation to the principal axes of the sample, factor of the threshold after each block).

    Under the hypothesis that a candidate is within the threshold t, its partial distance exceeds ``factor * t`` with a chance of at
    most ``risk``: the factor is that quantile of partial / full distance over pairs of the sample, near and far ones.
    """
    dim = sample.shape[1]
    bounds = [*[b for b in s.blocks if b < dim], dim]
    few = sample[:4096].astype(np.float64)
    values, axes = np.linalg.eigh(np.cov(few.T) if len(few) > 1 else np.eye(dim))
    rot = np.ascontiguousarray(axes[:, np.argsort(-values)], dtype=np.float32)
    if len(few) < 3:
        return rot, [1.0] * len(bounds)
    turned, rng = (few @ rot.astype(np.float64)), np.random.default_rng(s.seed)
    a = rng.integers(len(few), size=40_000)
    b = rng.integers(len(few), size=40_000)
    near = squared(turned[:1024].astype(np.float32), turned.astype(np.float32))
    near[np.arange(len(near)), np.arange(len(near))] = np.inf
    near = np.argpartition(near, min(10, near.shape[1] - 2), axis=1)[:, :10]
    a, b = np.r_[a, np.repeat(np.arange(len(near)), near.shape[1])], np.r_[b, near.ravel()]
    diff = (turned[a] - turned[b]) ** 2
    full = diff.sum(1)
    seen = full > 1e-9
    if not seen.any():
        return rot, [1.0] * len(bounds)
    return rot, [float(min(1.0, np.quantile(diff[seen, :w].sum(1) / full[seen], 1 - s.risk))) for w in bounds]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The vectors of each cell, of rows sorted by cell."""
    cell, vs = None, []

    def join() -> dict[str, pa.Array]:
        t = pa.Table.from_batches(vs)
        return {c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in t.column_names}

    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if key[x] != cell:
                if vs:
                    yield join()
                cell, vs = key[x], []
            vs.append(b.slice(x, y - x))
    if vs:
        yield join()


def _lists_of(want: int, table: tuple, n_bands: int) -> tuple[np.ndarray, ...] | None:
    """(rows, low, high, mean, list, leaf) of each list that holds the wanted tag, or a tag of its class; -1 wants any."""
    st_list, st_tag, st_n, low, high, mean = table
    use = np.arange(len(st_list)) if want == -1 else np.flatnonzero(st_tag == want)
    if not len(use):
        return None
    if want == -1 and len(np.unique(st_list)) < len(use):  # without a filter the tags of a list count as one
        u, inv = np.unique(st_list, return_inverse=True)
        n = np.bincount(inv, st_n)
        lo, hi = np.full(len(u), np.inf), np.zeros(len(u))
        np.minimum.at(lo, inv, low)
        np.maximum.at(hi, inv, high)
        return n, lo, hi, np.bincount(inv, mean * st_n) / n, u, u // n_bands
    return st_n[use], low[use], high[use], mean[use], st_list[use], st_list[use] // n_bands


def route(m: np.ndarray, ks: np.ndarray, tags: np.ndarray, r: Router, table: tuple, n_bands: int, s: Search, guide: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, lists, bound per query, cutoff per query): the lists each query probes and an upper bound of its k-th squared distance.

    A list whose vectors lie between ``low`` and ``high`` from its centre holds none nearer than max(d - high, low - d) to a
    query at distance d, and its n vectors are all within d + high: enough of these bound the k-th distance. A query with more
    such lists than it probes has a finite cutoff: it probes those with a score (expected squared distance) up to there.
    ``guide``, some of the vectors with their tags, bounds the k-th distance too: it is no farther than the k-th nearest of these.
    """
    # Arrays of a query block by all lists are float32: what their rounding may be wrong by goes into the limits.
    cutoff, slack = np.full(len(m), np.inf), rounding(r.leaves).astype(np.float32)
    norms = np.sqrt(np.einsum("ij,ij->i", r.leaves, r.leaves, dtype=np.float64))
    reach = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64)) + norms[np.isfinite(slack)].max(initial=0)
    out_rows, out_lists, bound = [], [], np.full(len(m), np.inf)
    for want in np.unique(tags):
        if (of := _lists_of(want, table, n_bands)) is None:
            continue
        n, lo, hi, mn, ls, lf = of
        lo, hi, mn, own = lo.astype(np.float32), hi.astype(np.float32), mn.astype(np.float32), slack[lf][None] * np.float32(1.001)
        some = None if guide is None or want >= CLASSES else guide[0] if want == -1 else guide[0][guide[1] == want]
        mine = np.flatnonzero(tags == want)
        step = max(8, min(256, (1 << 21) // len(lf)))
        top = few = min(s.probes, len(ls))
        if some is not None:  # the lists that hold the k nearest of many are few
            few = min(top, 64)
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            d2 = squared(m[rows], r.leaves)[:, lf]
            wrong = (rounding(m[rows])[:, None] * 1.001).astype(np.float32) + own
            far, near = np.sqrt(d2 + wrong), np.sqrt(np.fmax(d2 - wrong, 0))
            ub = np.full(len(rows), np.inf) if some is None else np.sqrt(_kth(m[rows], some, ks[rows]))
            # How many vectors of a class have the tag isn't known: such a query has no bound before the first pass.
            if want < CLASSES:
                upper = np.fmin(far + hi, np.inf)
                close = np.argpartition(upper, few - 1, axis=1)[:, :few]
                close = np.take_along_axis(close, np.argsort(np.take_along_axis(upper, close, 1), axis=1), 1)
                enough = np.cumsum(n[close], axis=1) >= ks[rows][:, None]
                at_k = np.take_along_axis(upper, np.take_along_axis(close, enough.argmax(1)[:, None], 1), 1)[:, 0]
                ub = np.fmin(ub, np.where(enough.any(1), at_k * (1 + 1e-6), np.inf))
            bound[rows] = ub * ub
            limit = (ub * (1 + 1e-5) + 1e-4 + 1e-6 * reach[rows]).astype(np.float32)
            possible = ~(np.fmax(near - hi, lo - far) > limit[:, None])
            cut = possible.sum(1) > top
            i, j = np.nonzero(possible[~cut])
            out_rows.append(rows[~cut][i])
            out_lists.append(ls[j])
            if not cut.any():
                continue
            # The nearest lists by expected distance; as many more as it takes to see k candidates.
            score = np.where(possible[cut], np.fmin(d2[cut] + mn, np.finfo(np.float32).max), np.inf)
            order = np.argpartition(score, top - 1, axis=1)[:, :top]
            cutoff[rows[cut]] = np.take_along_axis(score, order, 1).max(1)
            out_rows.append(np.repeat(rows[cut], top))
            out_lists.append(ls[order].ravel())
            for x in np.flatnonzero(n[order].sum(1) < np.minimum(ks[rows[cut]], n.sum())):  # rare: many tiny lists
                full = np.argsort(score[x], kind="stable")
                need = int(np.searchsorted(np.cumsum(n[full]), ks[rows[cut][x]])) + 1
                extra = np.setdiff1d(full[:need], order[x])
                out_rows.append(np.full(len(extra), rows[cut][x]))
                out_lists.append(ls[extra])
                seen = score[x][full[:need]]
                cutoff[rows[cut][x]] = seen[np.isfinite(seen)].max(initial=cutoff[rows[cut][x]])
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bound, cutoff
    return np.concatenate(out_rows), np.concatenate(out_lists), bound, cutoff


def _kth(m: np.ndarray, some: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """No less than the squared distance of each query to its k-th nearest of some vectors; infinite where they are fewer."""
    out = np.full(len(m), np.inf)
    can = np.flatnonzero(ks <= len(some))
    if len(can):
        k = int(ks[can].max())
        first = np.sort(np.partition(squared(m[can], some), k - 1, axis=1)[:, :k], axis=1)
        out[can] = first[np.arange(len(can)), ks[can] - 1].astype(np.float64) + rounding(m[can]) + rounding(some).max()
    return np.where(np.isnan(out), np.inf, out)


def probed(m: np.ndarray, tags: np.ndarray, bound: np.ndarray, cutoff: np.ndarray, r: Router, table: tuple, n_bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, lists), by query: of the lists of ``table`` those that can hold a vector within the squared distance ``bound`` and have a score up to the cutoff."""
    out_rows, out_lists = [], []
    slack = rounding(r.leaves)
    reach = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64)) + np.sqrt(np.einsum("ij,ij->i", r.leaves, r.leaves, dtype=np.float64))[np.isfinite(slack)].max(initial=0)
    limit = (np.sqrt(bound) * (1 + 1e-5) + 1e-4 + 1e-6 * reach).astype(np.float32)
    for want in np.unique(tags):
        if (of := _lists_of(want, table, n_bands)) is None:
            continue
        _, lo, hi, mn, ls, lf = of
        few, at_leaf = np.unique(lf, return_inverse=True)
        lo, hi, mn, own = lo.astype(np.float32), hi.astype(np.float32), mn.astype(np.float32), (slack[few] * 1.001).astype(np.float32)[None]
        mine, leaves = np.flatnonzero(tags == want), r.leaves[few]
        step = max(8, min(2048, (1 << 20) // len(lf)))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            d2 = squared(m[rows], leaves)
            wrong = (rounding(m[rows])[:, None] * 1.001).astype(np.float32) + own
            far, near = np.sqrt(d2 + wrong)[:, at_leaf], np.sqrt(np.fmax(d2 - wrong, 0))[:, at_leaf]
            possible = ~(np.fmax(near - hi, lo - far) > limit[rows][:, None])
            if (some := np.isfinite(cutoff[rows])).any():
                possible[some] &= ~(np.fmin((d2 - wrong)[some][:, at_leaf] + mn, np.finfo(np.float32).max) > cutoff[rows[some]][:, None] * (1 + 1e-6))
            i, j = np.nonzero(possible)
            out_rows.append(rows[i])
            out_lists.append(ls[j])
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, lists = np.concatenate(out_rows), np.concatenate(out_lists)
    o = np.argsort(rows, kind="stable")
    return rows[o], lists[o]
