"""Vectors as fixed-width binary rows, and the numeric kernels that the vector operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.ship import ship


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors with exactly ``dim`` elements, all finite as float32 and non-null, not all zero."""
    ends = column.offsets.to_numpy()
    ok = np.flatnonzero((np.diff(ends) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False)
    if not len(ok):
        return ok, np.zeros((0, dim), np.float32)
    with np.errstate(over="ignore"):
        m = flat[ends[:-1][ok][:, None] + np.arange(dim)].astype(np.float32)
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    return ok[good], m[good]


def pack(m: np.ndarray) -> pa.Array:
    """The rows of a float32 matrix as a binary column, without a copy a row."""
    m = np.ascontiguousarray(m, np.float32)
    ends = np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(m.tobytes())])


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The matrix of a binary column without nulls."""
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, dim), np.float32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, (ends[-1] - ends[0]) // 4, ends[0]).reshape(len(column), dim)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows (id, vec, x0, x1, ..): the rows with a usable vector and an id, packed; ``extra`` columns come along. Ids are integers."""
    ship(df.sparkSession)
    if df.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be integers: {id_col}")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(extra)), F.col(vector_col).alias("vec"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = usable(b.column(b.num_columns - 1), dim)
            took = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(c.take(took) for c in b.columns[:-1]), pack(m)], names=b.schema.names)

    return rows.mapInArrow(run, f"{kinds}, vec binary")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two matrices, by one matrix product."""
    d = a @ b.T
    d *= -2
    d += np.einsum("ij,ij->i", a, a)[:, None]
    d += np.einsum("ij,ij->i", b, b)[None]
    return np.maximum(d, 0, out=d)


def rounding(x: np.ndarray) -> np.ndarray:
    """Per row of a float32 matrix: ``squared(a, b)`` is wrong by at most ``rounding(a)[:, None] + rounding(b)[None]``; infinite where it may overflow."""
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    return np.where(norm < 1e30, norm * (4 * (x.shape[1] + 8) * 2.0**-24) + 1e-30, np.inf)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices, pair by pair, in float64."""
    return np.concatenate([((a[c : c + 16384].astype(np.float64) - b[c : c + 16384]) ** 2).sum(1) for c in range(0, len(a), 16384)] or [np.zeros(0)])


def judged(a: np.ndarray, b: np.ndarray, limit: float | np.ndarray) -> np.ndarray:
    """``squared(a, b)``, right about which pairs lie below ``limit`` (a number, or one a pair) as float32: pairs that float32 cannot tell from it are measured in float64."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.float32)
    edge = np.asarray(limit, np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        centre = np.median(b[:64], axis=0).astype(np.float32)
        x, y = a - centre, b - centre
        d = squared(x, y)
        wrong = ((rounding(x)[:, None] * 1.001).astype(np.float32), (rounding(y)[None] * 1.001 + np.max(limit) * 2.0**-22).astype(np.float32))
        i, j = np.nonzero(~(np.abs(d - edge) > wrong[0] + wrong[1]))
        if len(i):
            edges, limits = np.broadcast_to(edge, d.shape)[i, j], np.broadcast_to(np.asarray(limit, np.float64), d.shape)[i, j]
            for c in range(0, len(i), 16384):
                s = slice(c, c + 16384)
                exact = ((a[i[s]].astype(np.float64) - b[j[s]]) ** 2).sum(1)
                d[i[s], j[s]] = np.where(exact < limits[s], np.minimum(exact.astype(np.float32), np.nextafter(edges[s], np.float32(-np.inf))), np.maximum(exact.astype(np.float32), edges[s]))
    return d


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(centres, label of each row); an empty centre moves to a row that lies far from its own."""
    k = max(1, min(k, len(x)))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].astype(np.float32)
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label, best = nearest(x, centres)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, label, x)
        sizes = np.bincount(label, minlength=k)
        new = (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)
        if (empty := np.flatnonzero(sizes == 0)).size:
            new[empty] = x[np.argsort(-best)[: len(empty)]]
        if np.array_equal(new, centres):
            break
        centres = new
    return centres, nearest(x, centres)[0]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance) of each row; ties to the smaller number."""
    label, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for at in range(0, len(x), 2048):
        d = squared(x[at : at + 2048], centres)
        label[at : at + 2048] = d.argmin(1)
        best[at : at + 2048] = np.take_along_axis(d, label[at : at + 2048, None], 1)[:, 0]
    return label, best


class Router:
    """Leaves under roots. With few leaves each row meets all of them, with many only those of its nearest roots, or of
    every root that can have one ``within`` a squared distance."""

    ALL = 4096

    def __init__(self, leaves: np.ndarray, root_of: np.ndarray, roots: np.ndarray):
        self.order = np.argsort(root_of, kind="stable")  # the leaves' places in what was given
        self.leaves, self.root_of, self.roots = leaves[self.order], root_of[self.order], roots
        far = np.sqrt(((self.leaves.astype(np.float64) - roots[self.root_of]) ** 2).sum(1))
        self.radius = np.zeros(len(roots))  # of each root's leaves
        np.maximum.at(self.radius, self.root_of, far)

    @staticmethod
    def fit(sample: np.ndarray, count: int, seed: int) -> Router:
        """Two-level k-means of a bounded sample: about sqrt(count) roots, leaves in proportion to the rows of each."""
        rng = np.random.default_rng(seed)
        roots, label = lloyd(sample, max(1, round(math.sqrt(count))), rng)
        leaves, owner = [], []
        for r in range(len(roots)):
            rows = sample[label == r]
            if len(rows):
                own, _ = lloyd(rows, max(1, round(count * len(rows) / len(sample))), rng)
                leaves.append(own)
                owner += [r] * len(own)
        return Router(np.concatenate(leaves), np.array(owner), roots)

    def candidates(self, x: np.ndarray, roots: int, within: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, leaves, squared distances of all rows to all these leaves), so that each row meets its leaves once."""
        if len(self.leaves) <= self.ALL:
            for at in range(0, len(x), 512):
                rows = np.arange(at, min(at + 512, len(x)))
                yield rows, np.arange(len(self.leaves)), squared(x[rows], self.leaves) if within is None else judged(x[rows], self.leaves, within)
            return
        d = squared(x, self.roots)
        if within is None:
            meets = np.zeros(d.shape, bool)
            np.put_along_axis(meets, np.argpartition(d, min(roots, d.shape[1]) - 1, axis=1)[:, :roots], True, 1)
        else:  # a leaf within reach lies under a root within reach and the root's radius
            low = np.sqrt(np.maximum(d - rounding(x)[:, None] - rounding(self.roots)[None], 0))
            meets = ~(low > (self.radius + math.sqrt(within)) * (1 + 1e-6))
        for r in range(len(self.roots)):
            rows, leaves = np.flatnonzero(meets[:, r]), np.flatnonzero(self.root_of == r)
            if len(rows) and len(leaves):
                yield rows, leaves, squared(x[rows], self.leaves[leaves]) if within is None else judged(x[rows], self.leaves[leaves], within)

    def nearest(self, x: np.ndarray, count: int = 1, roots: int = 8, within: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, squared distances), nearest first, -1 where there are fewer; all leaves ``within`` a squared distance are met."""
        label, best = np.full((len(x), count), -1), np.full((len(x), count), np.inf, np.float32)
        for rows, leaves, d in self.candidates(x, roots, within):
            d = np.fmin(d, np.finfo(np.float32).max)  # beyond float32: far, but met
            m = min(count, len(leaves))
            pick = np.argpartition(d, m - 1, axis=1)[:, :m]
            both_d = np.concatenate([best[rows], np.take_along_axis(d, pick, 1)], 1)
            both_l = np.concatenate([label[rows], leaves[pick]], 1)
            o = np.lexsort((both_l, both_d), axis=1)[:, :count]
            best[rows], label[rows] = np.take_along_axis(both_d, o, 1), np.take_along_axis(both_l, o, 1)
        return label, best


def hashed_sample(vectors: DataFrame, rows: int, total: int, seed: int, dim: int, also: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(ids, matrix, further columns) of about ``rows`` of ``total`` rows, by a hash of the id: bounded, repeatable, in hash order."""
    share = min(1.0, rows / max(1, total))
    h = F.xxhash64("id", F.lit(seed))
    picked = vectors.where((F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).select("id", "vec", h.alias("h"), *also)
    t = picked.toArrow().combine_chunks().sort_by([("h", "ascending"), ("id", "ascending")])
    m = unpack(t["vec"].combine_chunks() if t.num_rows else pa.array([], pa.binary()), dim)
    return t["id"].to_numpy(), m, [t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for c in also]
