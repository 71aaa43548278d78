"""Readers and writers: Parquet, CSV, NDJSON, Avro, Arrow IPC and pyarrow datasets, with options by name."""

from __future__ import annotations

import fnmatch
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ridgeline.plans.ship import ship
from ridgeline.sources import avro


@dataclass(frozen=True)
class CsvReadOptions:
    has_header: bool = True
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    comment: str | None = None
    newlines_in_values: bool = False
    schema: str | None = None
    infer_share: float = 1.0
    null_value: str | None = None
    file_extension: str | None = None
    timestamp_format: str | None = None

    def options(self) -> dict[str, Any]:
        out = {"header": self.has_header, "sep": self.delimiter, "quote": self.quote, "multiLine": self.newlines_in_values, "inferSchema": self.schema is None, "samplingRatio": self.infer_share}
        out |= {k: v for k, v in (("escape", self.escape), ("comment", self.comment), ("nullValue", self.null_value), ("timestampFormat", self.timestamp_format), ("pathGlobFilter", self.file_extension and f"*{self.file_extension}")) if v is not None}
        return out


@dataclass(frozen=True)
class WriteOptions:
    """``mode``: append, overwrite or error; ``single_file``: one output file, only for results known to be small."""

    mode: str = "error"
    partition_by: Sequence[str] = ()
    sort_by: Sequence[str] = ()
    single_file: bool = False
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ParquetWriterOptions:
    compression: str = "zstd"
    compression_level: int | None = None
    row_group_bytes: int | None = None
    page_bytes: int | None = None
    dictionary: bool = True
    bloom_filters: Sequence[str] = ()
    no_dictionary: Sequence[str] = ()

    def options(self) -> dict[str, Any]:
        out: dict[str, Any] = {"compression": self.compression, "parquet.enable.dictionary": str(self.dictionary).lower()}
        if self.compression_level is not None:
            out["parquet.compression.codec.zstd.level"] = self.compression_level
        if self.row_group_bytes is not None:
            out["parquet.block.size"] = self.row_group_bytes
        if self.page_bytes is not None:
            out["parquet.page.size"] = self.page_bytes
        out |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.bloom_filters} | {f"parquet.enable.dictionary#{c}": "false" for c in self.no_dictionary}
        return out


def read_parquet(spark: SparkSession, path: str, schema: str | None = None, file_extension: str | None = None, merge_schema: bool = False) -> DataFrame:
    r = spark.read.option("mergeSchema", merge_schema)
    r = r.option("pathGlobFilter", f"*{file_extension}") if file_extension else r
    return (r.schema(schema) if schema else r).parquet(path)


def read_csv(spark: SparkSession, path: str, options: CsvReadOptions = CsvReadOptions()) -> DataFrame:
    r = spark.read.options(**options.options())
    return (r.schema(options.schema) if options.schema else r).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, infer_share: float = 1.0) -> DataFrame:
    """One JSON document a line."""
    r = spark.read.option("samplingRatio", infer_share)
    return (r.schema(schema) if schema else r).json(path)


def _avro_module(spark: SparkSession) -> bool:
    """Whether Spark's Avro module is on the class path."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
        return True
    except (AnalysisException, Py4JJavaError):
        return False


def read_avro(spark: SparkSession, path: str, schema: str | None = None, file_extension: str = ".avro") -> DataFrame:
    """By Spark's Avro module, or without it by tasks that decode a file each; ``schema`` picks columns by name."""
    if _avro_module(spark):
        r = spark.read.format("avro")
        return (r.schema(schema) if schema else r).load(path)
    ship(spark)
    fs, where = _located(path)
    files = _arrow_files(fs, where, file_extension)
    if not files:
        raise FileNotFoundError(path)
    kind = avro.spark_type(avro.schema_of(fs, files[0]))
    if not isinstance(kind, StructType):
        raise ValueError("an Avro table holds records")
    out = to_arrow_schema(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                for rows in avro.rows_of(fs, f):
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    df = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files), "path").mapInArrow(read, kind)
    return df if schema is None else df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in _parse_datatype_string(schema).fields])


def read_iceberg(spark: SparkSession, table: str, snapshot_id: int) -> DataFrame:
    """One exact snapshot of an Iceberg table; needs Iceberg's runtime on the class path."""
    return spark.read.option("snapshot-id", snapshot_id).format("iceberg").load(table)


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path; a relative path is one of the driver's."""
    return pafs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri().replace("%2A", "*").replace("%3F", "?").replace("%5B", "[").replace("%5D", "]"))


def _arrow_files(fs: pafs.FileSystem, path: str, extension: str = ".arrow") -> list[str]:
    """A file, those below a folder that end with the extension, or those a pattern fits."""
    if any(c in path for c in "*?["):
        base = path[: min(path.index(c) for c in "*?[" if c in path)].rsplit("/", 1)[0]
        found = fs.get_file_info(pafs.FileSelector(base or "/", allow_not_found=True, recursive=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.path, path))
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.Directory:
        return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(extension))
    return [path] if info.type == pafs.FileType.File else []


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams of a file system that the executors share (file, s3, hdfs); files are read in parallel, batch by batch."""
    fs, where = _located(path)
    files = _arrow_files(fs, where)
    if not files:
        raise FileNotFoundError(path)

    def opened(f: str):
        source = fs.open_input_file(f)
        try:
            return pa.ipc.open_file(source)
        except pa.ArrowInvalid:
            source.seek(0)
            return pa.ipc.open_stream(source)

    schema = opened(files[0]).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                r = opened(f)
                yield from (r.get_batch(i) for i in range(r.num_record_batches)) if hasattr(r, "num_record_batches") else r

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files), "path").mapInArrow(read, from_arrow_schema(schema))


def read_dataset(spark: SparkSession, dataset: pads.Dataset, columns: Sequence[str] | None = None, predicate: pads.Expression | None = None) -> DataFrame:
    """A pyarrow dataset of files, one task a fragment; columns and predicate are pushed into the scan.

    Fragments travel with their file system, format and partition, so columns that only the folders hold come out.
    """
    names = list(columns or dataset.schema.names)
    schema, whole = pa.schema([dataset.schema.field(c) for c in names]), dataset.schema
    parts = [(pickle.dumps(f),) for f in (dataset.get_fragments(predicate) if predicate is not None else dataset.get_fragments())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                for got in pickle.loads(data).to_batches(schema=whole, columns=names, filter=predicate):
                    if got.num_rows:
                        yield pa.RecordBatch.from_arrays([got.column(c).cast(schema.field(c).type) for c in names], schema=schema)

    rows = spark.createDataFrame(parts, "fragment binary")
    return (rows.repartition(len(parts)) if len(parts) > 1 else rows).mapInArrow(read, from_arrow_schema(schema))


def write(df: DataFrame, path: str, kind: str, options: WriteOptions = WriteOptions(), **extra: Any) -> None:
    """Write as parquet, csv, json, avro or arrow (IPC files, one a partition)."""
    if options.sort_by:
        df = df.sortWithinPartitions(*options.sort_by)
    if options.single_file:
        df = df.coalesce(1)
    if kind == "arrow" or kind == "avro" and not _avro_module(df.sparkSession):
        _write_files(df, path, kind, options)
        return
    w = df.write.mode(options.mode).options(**options.options, **extra)
    (w.partitionBy(*options.partition_by) if options.partition_by else w).format(kind).save(path)


def _write_files(df: DataFrame, path: str, kind: str, options: WriteOptions) -> None:
    """Arrow or Avro files, one a partition, written aside and moved, so that attempts of a task don't meet."""
    from pyspark import TaskContext

    if options.partition_by:
        raise ValueError(f"{kind} files cannot be partitioned by columns")
    ship(df.sparkSession)
    fs, where = _located(path)
    old = _arrow_files(fs, where, f".{kind}")
    if old and options.mode == "error":
        raise FileExistsError(path)
    fs.create_dir(where, recursive=True)
    offset = len(old) if options.mode == "append" else 0
    if options.mode == "overwrite":
        for f in old:
            fs.delete_file(f)
    schema = to_arrow_schema(df.schema)
    record = avro.avro_type(df.schema) if kind == "avro" else None
    codec = options.options.get("compression", "deflate")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{where}/part-{task.partitionId() + offset:05d}.{kind}"
        aside = f"{name}.{task.taskAttemptId()}.tmp"
        rows = 0
        with fs.open_output_stream(aside) as sink:
            if record is not None:
                rows = avro.write_rows(sink, record, (b.to_pylist() for b in batches), codec)
            else:
                with pa.ipc.new_file(sink, schema) as w:
                    for b in batches:
                        rows += b.num_rows
                        w.write_batch(b.cast(schema) if b.schema != schema else b)
        fs.move(aside, name)
        yield pa.RecordBatch.from_arrays([pa.array([rows])], names=["rows"])

    df.mapInArrow(save, "rows bigint").agg(F.sum("rows")).collect()
