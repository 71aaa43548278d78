"""A uniform sample of fixed size from data of unknown length that arrives in pieces.

Each partition runs skip-based reservoir sampling (the gaps between accepted records are drawn, most records cost nothing)
and counts its records. Reservoirs are merged in a tree: how many records come from each side is drawn from the hypergeometric
distribution over the populations they represent, so every record of the union stays equally likely. Reservoirs and their counts are
a state that can be kept: pieces that arrive later are sampled by themselves and merged into it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ridgeline.plans.lineage import cut_lineage
from ridgeline.plans.names import fresh
from ridgeline.plans.ship import ship


class Skips:
    """Algorithm L: positions of a stream of unknown length that enter a reservoir of ``size``, with the slot of each."""

    def __init__(self, size: int, rng: np.random.Generator):
        self.size, self.rng, self.seen = size, rng, 0
        self.w = math.exp(math.log(1 - rng.random()) / size)
        self.next = size + self._gap()

    def _gap(self) -> int:
        return math.floor(math.log(1 - self.rng.random()) / math.log1p(-self.w)) if self.w > 0 else 1 << 62

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the next ``n`` records, the accepted ones (offsets) and their slots; later ones replace earlier ones."""
        first = np.arange(max(0, min(n, self.size - self.seen)))
        offsets, slots = list(first), list(first + self.seen)
        while self.next < self.seen + n:
            offsets.append(self.next - self.seen)
            slots.append(int(self.rng.integers(self.size)))
            self.w *= math.exp(math.log(1 - self.rng.random()) / self.size)
            self.next += 1 + self._gap()
        self.seen += n
        return np.array(offsets, np.int64), np.array(slots, np.int64)


def shares(populations: list[int], size: int, rng: np.random.Generator) -> list[int]:
    """How many of ``size`` records come from each population: sequential hypergeometric draws."""
    rest, want, out = sum(populations), min(size, sum(populations)), []
    for n in populations:
        rest -= n
        # NumPy's own sampler is limited to 1e9; beyond it the record-by-record draw gives the same distribution.
        x = int(rng.hypergeometric(n, rest, want)) if n and want and n + rest < 10**9 else _draw(n, rest, want, rng)
        out.append(x)
        want -= x
    return out


def _draw(good: int, bad: int, want: int, rng: np.random.Generator) -> int:
    x = 0
    for _ in range(want if good else 0):
        if rng.random() * (good + bad) < good:
            x, good = x + 1, good - 1
        else:
            bad -= 1
    return x


STATE = ("_reservoir", "_slot", "_population")


def reservoirs(df: DataFrame, size: int, seed: int = 0, keep: Callable[[pa.RecordBatch], np.ndarray] | None = None, piece: str | None = None) -> DataFrame:
    """The state of a sample: rows of ``df`` and, as the last three columns, (_reservoir, _slot, _population): one reservoir of at most ``size`` rows a partition, or a partition and ``piece``.

    ``_population`` is the number of records that the reservoir stands for. States can be stored, and merged with those of data that arrives later.
    A task holds no more than ``size`` rows for each piece of its partition.

    Defined cases: null pieces are one piece; no record, no reservoir; where ``df`` has a column of the state's names, those of the state have more underscores.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in fresh(df.columns, *STATE))])
    arrow, width = to_arrow_schema(schema), len(df.columns)
    place = None if piece is None else df.columns.index(piece)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        of: dict[object, tuple[int, Skips]] = {}
        held: dict[int, pa.Table] = {}
        for whole in batches:
            if keep is not None:
                whole = whole.filter(pa.array(keep(whole)))
            if not whole.num_rows:
                continue
            names = [None] * whole.num_rows if place is None else whole.column(place).to_pylist()
            rows: dict[object, list[int]] = {}
            for at, name in enumerate(names if place is not None else ()):
                rows.setdefault(name, []).append(at)
            for name in rows or (None,):
                b = whole if len(rows) < 2 else whole.take(pa.array(rows[name]))
                if name not in of:
                    of[name] = len(of), Skips(size, np.random.default_rng([seed, pid, len(of)]))
                number, skips = of[name]
                offsets, slots = skips.take(b.num_rows)
                if not len(offsets):
                    continue
                last = {int(s): int(o) for o, s in zip(offsets, slots)}  # a slot filled twice keeps the later record
                new = pa.Table.from_batches([b.take(pa.array(list(last.values()), pa.int64()))]).append_column("s", pa.array(list(last), pa.int64()))
                if (had := held.get(number)) is not None:
                    new = pa.concat_tables([had.filter(pa.array(~np.isin(had["s"].to_numpy(), list(last)))), new])
                held[number] = new.combine_chunks()
        for number, skips in of.values():
            if (t := held.get(number)) is not None:
                n = t.num_rows
                # Slots are renumbered at random: any first m of them are a uniform sample of the reservoir's records.
                order = pa.array(np.random.default_rng([seed, pid, number, 1]).permutation(n))
                cols = [t.column(i) for i in range(width)] + [pa.array(np.full(n, pid << 32 | number)), order, pa.array(np.full(n, skips.seen))]
                yield from pa.table(cols, schema=arrow).to_batches()

    return df.mapInArrow(fill, schema)


def merge_reservoirs(states: Sequence[DataFrame] | DataFrame, size: int, by: Sequence[str] = (), seed: int = 0, fan_in: int = 32) -> DataFrame:
    """One state from several, with one reservoir, or one for each value of ``by``, whose records are a uniform sample of all that the states stand for.

    A merge task reads about ``fan_in`` reservoirs; how many records come from each is drawn from the hypergeometric distribution of their populations.
    States of one sequence must each stand for other records. Merging is repeatable with the same states and ``seed``.
    """
    if size < 1 or fan_in < 2:
        raise ValueError("size must be at least 1 and fan_in at least 2")
    parts = [states] if isinstance(states, DataFrame) else list(states)
    rid, slot, population = names = parts[0].columns[-3:]  # the state's columns are the last three
    rows = reduce(DataFrame.unionByName, [s.withColumn(rid, F.col(rid) * F.lit(len(parts)) + F.lit(i)) for i, s in enumerate(parts)])
    rows = cut_lineage(rows)
    ship(rows.sparkSession)
    (group,) = fresh(rows.columns, "group")
    schema = rows.schema
    arrow = to_arrow_schema(schema)

    def merger(level: int) -> Callable[[pa.Table], pa.Table]:
        def merge(t: pa.Table) -> pa.Table:
            target = t[group][0].as_py()
            t = t.drop_columns([group])
            ids, slots, pops = (t[c].to_numpy() for c in names)
            known = sorted({int(p): int(n) for p, n in zip(ids, pops)}.items())
            key = zlib.crc32(repr([t[c][0].as_py() for c in by]).encode())
            rng = np.random.default_rng([seed, level, target, key])
            wanted = dict(zip((p for p, _ in known), shares([n for _, n in known], size, rng)))
            chosen = np.flatnonzero(slots < np.array([wanted[int(p)] for p in ids]))
            chosen = chosen[np.lexsort((slots[chosen], ids[chosen]))]
            n = len(chosen)
            got = t.take(pa.array(chosen))
            new = {rid: pa.array(np.full(n, target)), slot: pa.array(rng.permutation(n)), population: pa.array(np.full(n, sum(p for _, p in known)))}
            return pa.table([new.get(c, got[c] if c not in new else None) for c in t.column_names], schema=arrow)

        return merge

    count = rows.groupBy(*by).agg(F.countDistinct(rid).alias("n")).agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        level += 1
        groups = max(1, -(-count // fan_in))
        spread = F.pmod(F.xxhash64(rid, F.lit(level)), F.lit(groups)) if groups > 1 else F.lit(0).cast("bigint")
        rows = rows.withColumn(group, spread).groupBy(*by, group).applyInArrow(merger(level), schema)
        if groups == 1:
            return rows
        count = groups


def reservoir_sample(df: DataFrame, size: int, seed: int = 0, keep: Callable[[pa.RecordBatch], np.ndarray] | None = None, fan_in: int = 32) -> DataFrame:
    """``min(size, rows)`` rows of ``df``, every row equally likely, in one pass over the data.

    ``keep`` picks the rows that count, by batch (a boolean mask). One reservoir is at most ``size`` rows, and a merge task reads
    about ``fan_in`` of them. The result is fixed by ``seed`` as long as the table's files are split alike.

    Defined cases: fewer rows than ``size`` all come out; repeated rows count each; nulls, long texts and any column names pass through; an empty
    table gives no rows; ``size`` must be positive.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # any names of the caller, twice the same ones too
    plain = df.toDF(*names)
    of = None if keep is None else lambda b: keep(pa.RecordBatch.from_arrays(b.columns, names=df_names))
    df_names = df.columns
    return merge_reservoirs(reservoirs(plain, size, seed, of), size, seed=seed, fan_in=fan_in).select(*names).toDF(*df.columns)
