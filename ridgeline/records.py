"""Results as streams of Arrow batches."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.plans.ship import ship


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in parts:
        for at in range(0, whole.num_rows, 8192):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_batch(whole.slice(at, 8192))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])


class RecordBatchStream:
    """Batches one by one, for ``for`` and ``async for``. ``close`` ends it early."""

    def __init__(self, schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
        self.schema, self._batches = schema, batches

    def next(self) -> pa.RecordBatch:
        return next(self._batches)

    __next__ = next

    def __iter__(self) -> RecordBatchStream:
        return self

    def __aiter__(self) -> AsyncIterator[pa.RecordBatch]:
        return self

    async def __anext__(self) -> pa.RecordBatch:
        got = await asyncio.to_thread(lambda: next(self._batches, None))
        if got is None:
            raise StopAsyncIteration
        return got

    def close(self) -> None:
        if hasattr(self._batches, "close"):
            self._batches.close()


def stream(df: DataFrame) -> RecordBatchStream:
    """The rows, partition by partition; no more than two partitions are on the driver at a time."""
    ship(df.sparkSession)

    def read() -> Iterator[pa.RecordBatch]:
        for row in df.mapInArrow(_packed, "b binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(bytes(row["b"]))

    return RecordBatchStream(to_arrow_schema(df.schema), read())


def partition_streams(df: DataFrame) -> list[RecordBatchStream]:
    """One stream a partition; a partition runs when its stream is read, and what it needs from shuffles is computed once."""
    ship(df.sparkSession)
    rows = df.mapInArrow(_packed, "b binary").rdd
    schema = to_arrow_schema(df.schema)

    def read(number: int) -> Iterator[pa.RecordBatch]:
        for data in rows.context.runJob(rows, lambda part: [bytes(r["b"]) for r in part], [number]):
            yield from pa.ipc.open_stream(data)

    return [RecordBatchStream(schema, read(i)) for i in range(rows.getNumPartitions())]
