"""Percentiles per group from mergeable sketches: a hierarchy of randomised compactors.

Level h holds values of weight 2**h. A full level is sorted and every other value, from a random first, moves up; the rest is dropped.
Sketches of partitions, groups or days merge level by level. Each compaction at level h shifts any rank by at most 2**h, up or
down with equal chance, so the sum of squares of these shifts bounds the rank error by Hoeffding's inequality.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ridgeline.plans.ship import ship


class Sketch:
    """Values by level. ``k``: the capacity of the top level; lower levels hold less, by 2/3 a level, and at least 8."""

    def __init__(self, k: int = 400, seed: int = 0):
        self.k, self.n, self.squares, self.levels = k, 0, 0.0, [np.zeros(0)]
        self.low, self.high = math.inf, -math.inf
        self.rng = np.random.default_rng(seed)

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compact()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.squares += other.squares
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
        for h, v in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], v])
        self._compact()

    def _capacity(self, h: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - h)))

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self._capacity(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    h = 0  # capacities have changed
                    continue
                v = np.sort(self.levels[h])
                odd = len(v) % 2
                self.levels[h], v = v[:odd] if odd else np.zeros(0), v[odd:]
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], v[int(self.rng.integers(2)) :: 2]])
                self.squares += 4.0**h
            h += 1

    def quantiles(self, qs: Sequence[float]) -> list[float | None]:
        """The smallest kept value whose estimated rank reaches ``q * n``; the ends are exact; none where there is no value."""
        if not self.n:
            return [None] * len(qs)
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        o = np.argsort(v, kind="stable")
        v, ranks = v[o], np.cumsum(w[o])
        at = np.searchsorted(ranks, np.clip(np.asarray(qs) * self.n, 1, ranks[-1]))
        return [self.low if q <= 0 else self.high if q >= 1 else float(v[min(i, len(v) - 1)]) for q, i in zip(qs, at)]

    def rank_error(self, failure: float = 0.01) -> float:
        """As a share of n: with a probability of at least ``1 - failure`` the rank of a percentile is off by no more."""
        return math.sqrt(2 * math.log(2 / failure) * self.squares) / self.n if self.n else 0.0

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.n, self.squares, self.low, self.high, len(self.levels), *map(len, self.levels)], np.float64)
        return np.concatenate([head, *self.levels]).tobytes()

    @staticmethod
    def from_bytes(data: bytes, seed: int = 0) -> Sketch:
        a = np.frombuffer(data, np.float64)
        s = Sketch(int(a[0]), seed)
        s.n, s.squares, s.low, s.high, count = int(a[1]), float(a[2]), float(a[3]), float(a[4]), int(a[5])
        ends = np.cumsum([6 + count, *a[6 : 6 + count].astype(int)])
        s.levels = [a[x:y].copy() for x, y in zip(ends, ends[1:])]
        return s


def _by_group(df: DataFrame, groups: Sequence[str], k: int, seed: int, step: int) -> DataFrame:
    """Fold rows (groups, payload) into one sketch a group and batch stream; beyond ``step`` 0 payloads are sketches. Each partition and step tosses coins of its own."""
    names = [f"g{i}" for i in range(len(groups))]
    schema = StructType([*(StructField(f.name, f.dataType) for f in df.schema.fields if f.name in names), StructField("sketch", BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        coins = lambda key: [seed, step, TaskContext.get().partitionId(), zlib.crc32(repr(key).encode())]

        def out() -> pa.RecordBatch:
            keys = list(held)
            cols = [pa.array([key[i] for key in keys], type=types[i]) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([held[key].to_bytes() for key in keys], pa.binary())], names=[*names, "sketch"])

        types: list[pa.DataType] = []
        for b in batches:
            types = types or [b.schema.field(i).type for i in range(len(names))]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(names))))) if names else [()] * b.num_rows
            payload = b.column(len(names))
            if step:
                for key, data in zip(keys, payload.to_pylist()):
                    if key in held:
                        held[key].merge(Sketch.from_bytes(data))
                    else:
                        held[key] = Sketch.from_bytes(data, seed=coins(key))
            else:
                codes: dict[tuple, list[int]] = {}
                for at, key in enumerate(keys):
                    codes.setdefault(key, []).append(at)
                ends = payload.offsets.to_numpy()
                flat = payload.values.to_numpy(zero_copy_only=False)
                for key, rows in codes.items():
                    v = np.concatenate([flat[ends[r] : ends[r + 1]] for r in rows]).astype(np.float64)
                    v = v[np.isfinite(v) & (v > 0)]
                    if len(v):
                        (held[key] if key in held else held.setdefault(key, Sketch(k, coins(key)))).add(v)
            if len(held) > 20_000:  # many groups: hand on what there is, it merges later
                yield out()
                held.clear()
        if held:
            yield out()

    return df.mapInArrow(fold, schema)


def percentile_sketches(df: DataFrame, groups: Sequence[str], values: str, *, once: str | None = None, k: int = 400, seed: int = 0) -> DataFrame:
    """Rows (groups, sketch): one mergeable sketch of all usable elements of the arrays ``values`` per group.

    ``once`` names an id; rows that repeat it count once. Partitions sketch their rows before the shuffle, so a group that
    holds most rows sends no more than one sketch a partition. Usable elements are finite and above zero.

    Defined cases: null group values form a group; null and empty arrays, and unusable elements, add nothing; a group without usable elements
    gives no row; rows with a null id count each; further columns are ignored; an empty table gives no rows. The same table, split alike, gives the same sketches.
    """
    ship(df.sparkSession)
    names = [f"g{i}" for i in range(len(groups))]
    cols = [F.col(c).alias(n) for c, n in zip(groups, names)]
    v = F.coalesce(F.col(values).cast("array<double>"), F.array().cast("array<double>")).alias("payload")
    if once is None:
        rows = df.select(*cols, v)
    else:
        seen = df.select(F.col(once).alias("once"), *cols, v)
        rows = seen.where(F.col("once").isNotNull()).dropDuplicates(["once"]).unionAll(seen.where(F.col("once").isNull())).drop("once")
    return merge_sketches(_by_group(rows, names, k, seed, 0).toDF(*groups, "sketch"), groups, seed=seed)


def merge_sketches(sketches: DataFrame, groups: Sequence[str], sketch: str = "sketch", *, seed: int = 0, salts: int = 16) -> DataFrame:
    """Rows (groups, sketch): sketches of partitions or days merged per group, in two steps so that no task reads all of a group's."""
    ship(sketches.sparkSession)
    names = [f"g{i}" for i in range(len(groups))]
    rows = sketches.select(*(F.col(c).alias(n) for c, n in zip(groups, names)), F.col(sketch).alias("payload"))
    salt = F.pmod(F.xxhash64("payload"), F.lit(salts))
    # Sorted payloads: the order of merging, and so the result, doesn't hang on the order in which tasks end.
    first = rows.repartition(*[F.col(n) for n in names], salt).sortWithinPartitions(*names, "payload")
    half = _by_group(first, names, 0, seed, 1).withColumnRenamed("sketch", "payload")
    last = (half.repartition(*[F.col(n) for n in names]) if names else half.repartition(1)).sortWithinPartitions(*names, "payload")
    return _by_group(last, names, 0, seed, 2).toDF(*groups, "sketch")


def sketch_percentiles(sketches: DataFrame, groups: Sequence[str], percentiles: Sequence[float], sketch: str = "sketch", failure: float = 0.01) -> DataFrame:
    """Rows (groups, samples, p.., rank_error): ``p50`` for 0.5 and so on; the rank error holds with probability ``1 - failure``."""
    ship(sketches.sparkSession)
    rows = sketches.select(*groups, F.col(sketch).alias("sketch"))
    named = [f"p{q * 100:g}".replace(".", "_") for q in percentiles]
    n = len(groups)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [Sketch.from_bytes(x) for x in b.column(n).to_pylist()]
            got = [s.quantiles(percentiles) for s in all_]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([s.n for s in all_], pa.int64()), *(pa.array([g[i] for g in got], pa.float64()) for i in range(len(named))), pa.array([s.rank_error(failure) for s in all_], pa.float64())],
                names=[*groups, "samples", *named, "rank_error"],
            )

    return rows.mapInArrow(read, ", ".join([*([keys] if keys else []), "samples bigint", *(f"{c} double" for c in named), "rank_error double"]))
