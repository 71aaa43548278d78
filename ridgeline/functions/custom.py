"""User-defined functions over Arrow arrays: scalar, aggregate with mergeable states, window and table functions."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from ridgeline.plans.names import fresh


def udf(func: Callable[..., pa.Array], returns: str, volatility: str = "immutable", name: str | None = None) -> Callable[..., Column]:
    """Arrow arrays in, one Arrow array of the same length out. A volatile function isn't moved or repeated by the optimizer."""
    if volatility not in ("immutable", "stable", "volatile"):
        raise ValueError("volatility must be immutable, stable or volatile")

    @F.arrow_udf(returns)
    def call(*args: pa.Array) -> pa.Array:
        return func(*args)

    out = call.asNondeterministic() if volatility == "volatile" else call
    if name is not None:
        SparkSession.getActiveSession().udf.register(name, out)
    return out


class Accumulator:
    """Base of aggregates: ``update`` with arrays, ``state`` as bytes, ``merge`` with such states, ``evaluate`` to a Python value."""

    def update(self, *arrays: pa.Array) -> None:
        raise NotImplementedError

    def state(self) -> bytes:
        raise NotImplementedError

    def merge(self, states: Sequence[bytes]) -> None:
        raise NotImplementedError

    def evaluate(self) -> Any:
        raise NotImplementedError


def _groups(b: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """(key, columns) of the groups of a batch by its first ``n`` columns: the batch is put in order once, groups are slices of it."""
    if not n or not b.num_rows:
        if b.num_rows:
            yield (), b.columns
        return
    codes = np.zeros(b.num_rows, np.int64)
    for c in b.columns[:n]:
        one = c.dictionary_encode()
        number = one.indices.fill_null(len(one.dictionary)).to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (len(one.dictionary) + 1) + number, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    whole = b.take(pa.array(order))
    cuts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
    keys = whole.select(range(n)).take(pa.array(cuts))
    values = whole.columns[n:]
    for key, a, z in zip(zip(*[c.to_pylist() for c in keys.columns]), cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
        yield key, [v.slice(a, z - a) for v in values]


def sql_udaf(make: Callable[[], Accumulator], returns: str) -> Callable[..., Column]:
    """An accumulator as a function for SQL, ``agg`` and windows with any frame. Spark gives it a whole group at once: for groups that a task can hold; ``udaf`` has no such bound."""

    def whole(*args: pa.Array) -> Any:
        acc = make()
        acc.update(*args)
        return acc.evaluate()

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # type hints cannot tell a number of arguments that the call decides
        return F.arrow_udf(whole, returns, ArrowUDFType.GROUPED_AGG)


def udaf(df: DataFrame, group_by: Sequence[str], inputs: Sequence[str], make: Callable[[], Accumulator], returns: str, out: str) -> DataFrame:
    """Rows (group_by, out). Two phases: partitions send one state a group, so a hot group costs no task more than its states.

    Defined cases: null group values form a group; the accumulator sees nulls; an empty table gives no rows; names of helper columns never clash.
    """
    (state,) = fresh([*group_by, *inputs, out], "state")
    rows = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group_by)], *[F.col(c).alias(f"x{i}") for i, c in enumerate(inputs)])
    n = len(group_by)
    keys = [f"g{i}" for i in range(n)]
    partial = StructType([*rows.schema.fields[:n], StructField(state, BinaryType())])
    types = [to_arrow_type(f.dataType) for f in rows.schema.fields[:n]]
    result = to_arrow_type(_parse_datatype_string(returns))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Accumulator] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in held], types[i]) for i in range(n)], pa.array([a.state() for a in held.values()], pa.binary())], names=[*keys, state])

        for b in batches:
            for key, part in _groups(b, n):
                if key not in held:
                    held[key] = make()
                held[key].update(*part)
            if len(held) > 50_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States of a group lie side by side; a group may go on in the next batch."""
        last: tuple | None = None
        held: Accumulator | None = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in done], types[i]) for i in range(n)], pa.array([v for _, v in done], result)], names=[*keys, out])

        for b in batches:
            names = list(zip(*[c.to_pylist() for c in b.columns[:n]])) if n else [()] * b.num_rows
            states = b.column(n).to_pylist()
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if held is not None and names[at] != last:
                    done.append((last, held.evaluate()))
                    held = None
                held, last = held or make(), names[at]
                held.merge(states[at:end])
                at = end
            if len(done) >= 8192:
                yield flush()
                done = []
        if held is not None:
            done.append((last, held.evaluate()))
        if done:
            yield flush()

    final = StructType([*rows.schema.fields[:n], StructField(out, _parse_datatype_string(returns))])
    states = rows.mapInArrow(fold, partial)
    together = states.repartition(*keys).sortWithinPartitions(*keys) if n else states.repartition(1)
    return together.mapInArrow(finish, final).toDF(*group_by, out)


class WindowEvaluator:
    """Base of window functions. The flags say which of the methods is called.

    ``uses_window_frame``: ``evaluate`` with the frame of each row; else ``include_rank``: ``evaluate_all_with_rank``; else ``supports_bounded_execution``:
    ``evaluate`` with ``get_range`` of each row; else ``evaluate_all``. ``memoize`` is called after each row of ``evaluate``, ``is_causal`` says that no later row matters.
    """

    uses_window_frame = False
    include_rank = False
    supports_bounded_execution = False

    def memoize(self) -> None:
        """State kept between rows can be reduced here."""

    def is_causal(self) -> bool:
        return False

    def get_range(self, idx: int, num_rows: int) -> tuple[int, int]:
        """The rows that row ``idx`` needs: by default itself alone."""
        return idx, idx + 1

    def evaluate_all(self, values: list[pa.Array], num_rows: int) -> pa.Array:
        raise NotImplementedError

    def evaluate(self, values: list[pa.Array], eval_range: tuple[int, int]) -> Any:
        raise NotImplementedError

    def evaluate_all_with_rank(self, num_rows: int, ranks_in_partition: list[tuple[int, int]]) -> pa.Array:
        raise NotImplementedError


def _evaluated(e: WindowEvaluator, values: list[pa.Array], peers: list[tuple[int, int]], frame: tuple[int | None, int | None], kind: pa.DataType) -> pa.Array:
    n = len(values[0]) if values else peers[-1][1] if peers else 0
    if e.uses_window_frame or not e.include_rank and e.supports_bounded_execution:
        lo, hi = frame
        out = []
        for i in range(n):
            at = (max(0, i + lo) if lo is not None else 0, max(0, min(n, i + hi + 1)) if hi is not None else n) if e.uses_window_frame else e.get_range(i, n)
            got = e.evaluate(values, at)
            out.append(got.as_py() if isinstance(got, pa.Scalar) else got)
            e.memoize()
        return pa.array(out, kind)
    return e.evaluate_all_with_rank(n, peers) if e.include_rank else e.evaluate_all(values, n)


def udwf(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column], evaluate_all: Callable[[pa.Table], pa.Array] | Callable[[], WindowEvaluator], returns: str, out: str, inputs: Sequence[str] | None = None,
    frame: tuple[int | None, int | None] = (None, 0),
) -> DataFrame:
    """``df`` with a column that a function or an evaluator computes from each ordered window partition. One partition must fit a task.

    A function gets the whole partition as a table. A ``WindowEvaluator`` (the class, or a call that makes one) gets the arrays ``inputs``; ``frame``: offsets of
    the first and last row from the current one, None for no bound. For aggregates over frames, ``sql_udaf(..).over(..)`` needs no such partition in Python.
    """
    if out in df.columns:
        raise ValueError(f"column exists: {out}")
    place, peer = fresh([*df.columns, out], "place", "peer")
    from pyspark.sql import Window

    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    ranked = df.withColumn(place, F.row_number().over(w)).withColumn(peer, F.rank().over(w))
    schema = StructType([*df.schema.fields, StructField(out, _parse_datatype_string(returns))])
    kind = to_arrow_type(_parse_datatype_string(returns))
    made = isinstance(evaluate_all, type) or inputs is not None

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(place)
        starts = np.unique(t[peer].to_numpy()) - 1
        t = t.drop_columns([place, peer])
        if not made:
            return t.append_column(out, evaluate_all(t))
        peers = list(zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]))
        return t.append_column(out, _evaluated(evaluate_all(), [t[c].combine_chunks() for c in inputs or ()], peers, frame, kind).cast(kind))

    return ranked.groupBy(*partition_by).applyInArrow(run, schema)


def udtf(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Register a table function for SQL: a class whose ``eval`` yields rows."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))
