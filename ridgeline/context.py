"""A session context: registration of tables and functions, readers, SQL and catalog access under one object, over a SparkSession."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.catalogs import Catalog, CatalogList, CatalogProvider, as_frame
from ridgeline.frame import Frame
from ridgeline.functions import custom as udfs
from ridgeline.plan import ExecutionPlan, LogicalPlan
from ridgeline.plans import statements
from ridgeline.plans.ship import ship
from ridgeline.records import RecordBatchStream, partition_streams, stream
from ridgeline.settings import RuntimeEnvBuilder, SessionConfig, SQLOptions
from ridgeline.sources import formats

_READ = {"parquet": formats.read_parquet, "csv": formats.read_csv, "json": formats.read_json, "avro": formats.read_avro, "arrow": formats.read_arrow}


def capacity(text: str) -> int:
    """Bytes of a size such as ``64K``, ``1.5G`` or ``100``."""
    units = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
    t = text.strip().upper().removesuffix("B").removesuffix("I")
    number, unit = (t[:-1], units[t[-1]]) if t and t[-1] in units else (t, 1)
    try:
        out = int(float(number) * unit)
    except ValueError:
        raise ValueError(f"not a size: {text}") from None
    if out < 0:
        raise ValueError(f"not a size: {text}")
    return out


def global_ctx() -> SessionContext:
    """The one context of the active session."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if _GLOBAL.get("spark") is not spark:
        _GLOBAL.update(spark=spark, context=SessionContext(spark))
    return _GLOBAL["context"]


_GLOBAL: dict[str, Any] = {}


class LocationInputPlugin:
    """Paths as tables: the kind by the file's extension, for files, folders of such files and patterns."""

    KINDS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "avro": "avro", "arrow": "arrow"}

    def is_correct_input(self, path: str) -> bool:
        return path.split("?")[0].rstrip("/*").rsplit(".", 1)[-1].lower() in self.KINDS

    def build_table(self, context: SessionContext, path: str) -> Frame:
        if not self.is_correct_input(path):
            raise ValueError(f"the kind of the files is not known: {path}")
        return context._read(self.KINDS[path.rstrip("/*").rsplit(".", 1)[-1].lower()], path)


class SessionContext:
    global_ctx = staticmethod(global_ctx)

    def __init__(self, spark: SparkSession | None = None, config: SessionConfig | None = None, runtime: RuntimeEnvBuilder | None = None):
        self.spark = spark or (runtime or RuntimeEnvBuilder()).builder().getOrCreate()
        self.config = config or SessionConfig()
        self.config.apply(self.spark)
        self.catalogs = CatalogList(self.spark)
        self._functions: dict[str, dict[str, Any]] = {"scalar": {}, "aggregate": {}, "window": {}, "table": {}}
        self._id = str(uuid.uuid4())

    # SQL
    def sql(self, statement: str, params: dict[str, Any] | Sequence[Any] | None = None, **frames: Frame) -> Frame:
        """Named or positional parameters; frames stand for ``{name}`` in the statement."""
        named = {k: v.df if isinstance(v, Frame) else v for k, v in frames.items()}
        statement = self.catalogs.bound(statement)
        return Frame(self.spark.sql(statement, args=params, **named) if params is not None else self.spark.sql(statement, **named))

    def sql_with_options(self, statement: str, options: SQLOptions | None = None, params: dict[str, Any] | Sequence[Any] | None = None, **allow: bool) -> Frame:
        """Refuses a statement that holds, anywhere in it, what the options don't allow."""
        rules = options or SQLOptions(**allow)
        for kind, name in statements.kinds(self.spark, statement).items():
            if not getattr(rules, f"allow_{kind}"):
                raise PermissionError(f"{kind} is not allowed: {name}")
        return self.sql(statement, params)

    def parse_sql_expr(self, text: str):
        return F.expr(text)

    # In-memory data
    def from_arrow(self, data: pa.Table | pa.RecordBatch, name: str | None = None) -> Frame:
        t = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
        return self._named(self.spark.createDataFrame(t), name)

    def from_pylist(self, data: list[dict], name: str | None = None) -> Frame:
        return self.from_arrow(pa.Table.from_pylist(data), name)

    def from_pydict(self, data: dict[str, list], name: str | None = None) -> Frame:
        return self.from_arrow(pa.table(data), name)

    def from_pandas(self, data: Any, name: str | None = None) -> Frame:
        return self._named(self.spark.createDataFrame(data), name)

    def from_polars(self, data: Any, name: str | None = None) -> Frame:
        return self.from_arrow(data.to_arrow(), name)

    def create_dataframe(self, partitions: Sequence[Sequence[pa.RecordBatch]], name: str | None = None) -> Frame:
        df = self.spark.createDataFrame(pa.Table.from_batches([b for p in partitions for b in p]))
        return self._named(df.repartition(len(partitions)) if len(partitions) > 1 else df, name)

    def create_dataframe_from_logical_plan(self, plan: LogicalPlan) -> Frame:
        return Frame(plan.df)

    execute_logical_plan = create_dataframe_from_logical_plan

    def execute(self, plan: ExecutionPlan, partitions: int | None = None) -> RecordBatchStream:
        """The rows of a plan, or of one of its partitions."""
        return stream(plan.df) if partitions is None else partition_streams(plan.df)[partitions]

    read_batches = create_dataframe

    def read_batch(self, batch: pa.RecordBatch) -> Frame:
        return self.from_arrow(batch)

    def empty_table(self) -> Frame:
        return Frame(self.spark.range(0).select())

    read_empty = empty_table

    def _named(self, df: DataFrame, name: str | None) -> Frame:
        if name:
            df.createOrReplaceTempView(name)
        return Frame(df)

    # Files
    def _read(self, kind: str, path: str, **options: Any) -> Frame:
        return Frame(_READ[kind](self.spark, path, **options))

    def __getattr__(self, name: str) -> Callable[..., Any]:
        verb, _, kind = name.partition("_")
        if kind in _READ and verb == "read":
            return lambda path, **options: self._read(kind, path, **options)
        if kind in _READ and verb == "register":
            return lambda table, path, **options: self._read(kind, path, **options).into_view(table)
        raise AttributeError(name)

    def register_listing_table(self, name: str, path: str, file_extension: str = ".parquet", schema: str | None = None) -> None:
        """Partition columns come from ``key=value`` folders."""
        kind = file_extension.lstrip(".").replace("ndjson", "json")
        r = self.spark.read.format(kind).option("pathGlobFilter", f"*{file_extension}")
        (r.schema(schema) if schema else r).load(path).createOrReplaceTempView(name)

    def register_dataset(self, name: str, dataset: Any) -> None:
        formats.read_dataset(self.spark, dataset).createOrReplaceTempView(name)

    def register_object_store(self, schema: str, options: dict[str, str]) -> None:
        """Hadoop file system settings, such as those of ``s3a``."""
        conf = self.spark._jsc.hadoopConfiguration()
        for k, v in options.items():
            conf.set(k if k.startswith("fs.") else f"fs.{schema}.{k}", v)

    def deregister_object_store(self, schema: str, keys: Sequence[str]) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for k in keys:
            conf.unset(k if k.startswith("fs.") else f"fs.{schema}.{k}")

    # Tables
    def register_view(self, name: str, frame: Frame) -> None:
        frame.df.createOrReplaceTempView(name)

    register_table = register_view

    def register_batch(self, name: str, batch: pa.RecordBatch) -> None:
        self.from_arrow(batch, name)

    def register_record_batches(self, name: str, partitions: Sequence[Sequence[pa.RecordBatch]]) -> None:
        self.create_dataframe(partitions, name)

    def register_table_factory(self, source: type) -> None:
        """A Python data source class; then ``format(name)`` and ``CREATE TABLE .. USING`` know it."""
        self.spark.dataSource.register(source)

    def deregister_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> Frame:
        got = self.catalogs.resolve(name)
        return Frame(got if got is not None else self.spark.table(name))

    table_provider = read_table = table

    def table_exist(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def register_table_provider(self, name: str, provider: Any) -> None:
        """A frame, an Arrow table, or an object with ``to_frame(spark)``, by name."""
        as_frame(self.spark, provider).createOrReplaceTempView(name)

    def register_catalog_provider(self, name: str, provider: CatalogProvider) -> None:
        """Its tables are ``name.schema.table`` in SQL and in ``table``."""
        self.catalogs.register_catalog(name, provider)

    def register_catalog_provider_list(self, providers: dict[str, CatalogProvider]) -> None:
        for name, provider in providers.items():
            self.register_catalog_provider(name, provider)

    def catalog_names(self) -> list[str]:
        return self.catalogs.catalog_names()

    def catalog(self, name: str = "spark_catalog") -> Catalog:
        return self.catalogs.catalog(name)

    def information_schema(self, kind: str = "tables") -> Frame:
        """``tables`` (table_catalog, table_schema, table_name, table_type), ``columns`` (with column_name, ordinal_position, data_type, is_nullable) or ``df_settings`` (name, value)."""
        if kind == "df_settings":
            return Frame(self.spark.sql("SET -v").select(F.col("key").alias("name"), "value"))
        found = [(t.catalog, (t.namespace or [None])[0], t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE") for t in self.spark.catalog.listTables()]
        if kind == "tables":
            return Frame(self.spark.createDataFrame(found, "table_catalog string, table_schema string, table_name string, table_type string"))
        if kind != "columns":
            raise ValueError(f"no such table of the information schema: {kind}")
        rows = [(c, s, t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for c, s, t, _ in found for i, f in enumerate(self.spark.table(t if s is None else f"`{s}`.`{t}`").schema.fields)]
        return Frame(self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"))

    def refresh_catalogs(self) -> None:
        self.spark.catalog.clearCache()

    # Functions
    def register_udf(self, name: str, func: Callable, returns: str, volatility: str = "immutable") -> Callable:
        out = udfs.udf(func, returns, volatility)
        self.spark.udf.register(name, out)
        self._functions["scalar"][name] = out
        return out

    def register_udaf(self, name: str, make: Callable, returns: str) -> None:
        """A SQL function for groups and window frames that a task can hold; ``aggregate_with`` has no such bound."""
        self._functions["aggregate"][name] = (make, returns)
        ship(self.spark)
        self.spark.udf.register(name, udfs.sql_udaf(make, returns))

    def register_udwf(self, name: str, evaluate_all: Callable, returns: str, inputs: Sequence[str] | None = None, frame: tuple[int | None, int | None] = (None, 0)) -> None:
        """A function of the whole ordered partition, or a ``WindowEvaluator``, for ``window_with``."""
        self._functions["window"][name] = (evaluate_all, returns, inputs, frame)

    def register_udtf(self, name: str, handler: type, returns: str) -> None:
        udfs.udtf(self.spark, name, handler, returns)
        self._functions["table"][name] = handler

    def deregister_udf(self, name: str) -> None:
        for kind in self._functions.values():
            kind.pop(name, None)
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    deregister_udaf = deregister_udwf = deregister_udtf = deregister_udf

    def aggregate_with(self, frame: Frame, name: str, group_by: Sequence[str], inputs: Sequence[str], out: str) -> Frame:
        make, returns = self._functions["aggregate"][name]
        return Frame(udfs.udaf(frame.df, group_by, inputs, make, returns, out))

    def window_with(self, frame: Frame, name: str, partition_by: Sequence[str], order_by: Sequence[str], out: str) -> Frame:
        func, returns, inputs, bounds = self._functions["window"][name]
        return Frame(udfs.udwf(frame.df, partition_by, order_by, func, returns, out, inputs, bounds))

    def udf(self, name: str) -> Callable:
        return self._functions["scalar"].get(name) or (lambda *args: F.call_function(name, *args))

    def udaf(self, name: str) -> Any:
        return self._functions["aggregate"][name]

    def udwf(self, name: str) -> Any:
        return self._functions["window"][name]

    def udfs(self) -> list[str]:
        return sorted({f.name for f in self.spark.catalog.listFunctions()} | set(self._functions["scalar"]))

    def udafs(self) -> list[str]:
        return sorted(self._functions["aggregate"])

    def udwfs(self) -> list[str]:
        return sorted(self._functions["window"])

    # Session
    def session_id(self) -> str:
        return self._id

    def session_start_time(self) -> str:
        import datetime

        return datetime.datetime.fromtimestamp(self.spark.sparkContext.startTime / 1000, datetime.UTC).isoformat()

    def enable_ident_normalization(self) -> bool:
        return self.spark.conf.get("spark.sql.caseSensitive") != "true"

    def enable_url_table(self) -> SessionContext:
        """Paths are tables in ``table_of``; in SQL they are as they are: ``SELECT * FROM parquet.`/path```."""
        self._locations = LocationInputPlugin()
        return self

    def table_of(self, path: str) -> Frame:
        return getattr(self, "_locations", LocationInputPlugin()).build_table(self, path)

    def enable_spark_functions(self) -> SessionContext:
        return self

    def copied_config(self) -> dict[str, str]:
        return dict(self.spark.sparkContext.getConf().getAll()) | self.config.conf

    def remove_optimizer_rule(self, name: str) -> bool:
        key = "spark.sql.optimizer.excludedRules"
        had = self.spark.conf.get(key, "")
        self.spark.conf.set(key, ",".join(filter(None, [had, name])))
        return name not in had.split(",")

    @staticmethod
    def parse_capacity_limit(text: str) -> int:
        return capacity(text)
