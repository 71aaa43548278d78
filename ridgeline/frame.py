"""A relational frame: the DataFrame verbs of the engine over a Spark DataFrame, which stays at hand as ``df``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ridgeline.plan import ExecutionPlan, LogicalPlan
from ridgeline.plans.names import fresh
from ridgeline.records import RecordBatchStream, partition_streams, stream
from ridgeline.sources import formats

_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def text_table(t: pa.Table, more: bool) -> str:
    cells = [[str(x) if x is not None else "" for x in r.values()] for r in t.to_pylist()]
    widths = [max([len(n), *(len(c[i]) for c in cells)]) for i, n in enumerate(t.column_names)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    shown = ["| " + " | ".join(c.ljust(w) for c, w in zip(row, widths)) + " |" for row in [t.column_names, *cells]]
    return "\n".join([line, shown[0], line, *shown[1:], line, *(["more rows follow"] if more else [])])


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    def __getitem__(self, name: str) -> Column:
        return self.df[name]

    def schema(self) -> pa.Schema:
        return to_arrow_schema(self.df.schema)

    def column(self, name: str) -> Column:
        return self.df[name]

    col = column

    def find_qualified_columns(self, *names: str) -> list[Column]:
        return [self.df[n] for n in names]

    def into_view(self, name: str) -> str:
        self.df.createOrReplaceTempView(name)
        return name

    def alias(self, name: str) -> Frame:
        return Frame(self.df.alias(name))

    def select(self, *exprs: Column | str) -> Frame:
        return Frame(self.df.select(*exprs))

    def select_exprs(self, *exprs: str) -> Frame:
        return Frame(self.df.selectExpr(*exprs))

    def parse_sql_expr(self, text: str) -> Column:
        return F.expr(text)

    def drop(self, *columns: str) -> Frame:
        return Frame(self.df.drop(*columns))

    def filter(self, *predicates: Column | str) -> Frame:
        df = self.df
        for p in predicates:
            df = df.where(p)
        return Frame(df)

    def window(self, **columns: Column) -> Frame:
        return Frame(self.df.withColumns(columns))

    def with_column(self, name: str, expr: Column) -> Frame:
        return Frame(self.df.withColumn(name, expr))

    def with_columns(self, **columns: Column) -> Frame:
        return Frame(self.df.withColumns(columns))

    def with_column_renamed(self, old: str, new: str) -> Frame:
        return Frame(self.df.withColumnRenamed(old, new))

    def cast(self, mapping: dict[str, str]) -> Frame:
        return Frame(self.df.withColumns({c: F.col(c).cast(t) for c, t in mapping.items()}))

    def aggregate(self, group_by: Sequence[Column | str], aggs: Sequence[Column], sets: str | Sequence[Sequence[str]] = "plain") -> Frame:
        """``sets``: plain, rollup, cube, or the grouping sets themselves."""
        g = self.df.groupBy(*group_by) if sets == "plain" else self.df.rollup(*group_by) if sets == "rollup" else self.df.cube(*group_by) if sets == "cube" else self.df.groupingSets([list(s) for s in sets], *group_by)
        return Frame(g.agg(*aggs))

    def sort(self, *exprs: Column | str, nulls_first: bool = True) -> Frame:
        return Frame(self.df.orderBy(*[(F.col(e).asc_nulls_first() if nulls_first else F.col(e).asc_nulls_last()) if isinstance(e, str) else e for e in exprs]))

    def sort_by(self, *exprs: str) -> Frame:
        return self.sort(*exprs, nulls_first=False)

    def limit(self, count: int, offset: int = 0) -> Frame:
        return Frame((self.df.offset(offset) if offset else self.df).limit(count))

    def head(self, n: int = 5) -> Frame:
        return self.limit(n)

    def tail(self, n: int = 5) -> Frame:
        """The last rows, read from the last partitions; they pass through the driver."""
        return Frame(self.df.sparkSession.createDataFrame(self.df.tail(n), self.df.schema))

    def distinct(self) -> Frame:
        return Frame(self.df.distinct())

    def distinct_on(self, on: Sequence[str], select: Sequence[str | Column], sort: Sequence[str | Column]) -> Frame:
        (rank,) = fresh(self.df.columns, "rank")
        first = self.df.withColumn(rank, F.row_number().over(Window.partitionBy(*on).orderBy(*sort))).where(F.col(rank) == 1)
        return Frame(first.select(*select))

    def join(self, right: Frame, on: str | Sequence[str] | None = None, how: str = "inner", left_on: Sequence[str] = (), right_on: Sequence[str] = (), coalesce_duplicate_keys: bool = True) -> Frame:
        names = [on] if isinstance(on, str) else list(on or [])
        kind = _HOW[how]
        if names and coalesce_duplicate_keys:
            return Frame(self.df.join(right.df, names, kind))
        pairs = list(zip(names or left_on, names or right_on, strict=True))
        if not pairs:
            raise ValueError("a join needs keys; for other conditions use join_on")
        cond = F.lit(True)
        for a, b in pairs:
            cond = cond & (self.df[a] == right.df[b])
        return Frame(self.df.join(right.df, cond, kind))

    def join_on(self, right: Frame, *exprs: Column, how: str = "inner") -> Frame:
        cond = exprs[0]
        for e in exprs[1:]:
            cond = cond & e
        return Frame(self.df.join(right.df, cond, _HOW[how]))

    def union(self, other: Frame, distinct: bool = False) -> Frame:
        out = self.df.unionAll(other.df)
        return Frame(out.distinct() if distinct else out)

    def union_distinct(self, other: Frame) -> Frame:
        return self.union(other, True)

    def union_by_name(self, other: Frame, distinct: bool = False) -> Frame:
        out = self.df.unionByName(other.df, allowMissingColumns=True)
        return Frame(out.distinct() if distinct else out)

    def intersect(self, other: Frame, distinct: bool = False) -> Frame:
        return Frame(self.df.intersect(other.df) if distinct else self.df.intersectAll(other.df))

    def except_all(self, other: Frame, distinct: bool = False) -> Frame:
        return Frame(self.df.subtract(other.df) if distinct else self.df.exceptAll(other.df))

    def unnest_columns(self, *columns: str, preserve_nulls: bool = True, recursions: int = 1) -> Frame:
        """Several columns are unnested side by side; shorter ones are filled with null."""
        df = self.df
        for _ in range(recursions):
            if len(columns) == 1:
                df = df.withColumn(columns[0], (F.explode_outer if preserve_nulls else F.explode)(columns[0]))
                continue
            (item,) = fresh(df.columns, "item")
            zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array()).alias(c) for c in columns])
            df = df.withColumn(item, (F.explode_outer if preserve_nulls else F.explode)(zipped)).withColumns({c: F.col(item)[c] for c in columns}).drop(item)
        return Frame(df)

    def fill_null(self, value: Any, subset: Sequence[str] | None = None) -> Frame:
        """Nulls of the columns whose type the value fits become the value; NaN is a value of its own and stays."""
        fits = {bool: ("boolean",), int: ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), float: ("float", "double", "decimal"), str: ("string",)}.get(type(value))
        names = list(subset) if subset is not None else self.df.columns
        kinds = {f.name: f.dataType.simpleString() for f in self.df.schema.fields}
        chosen = [c for c in names if fits is None or kinds[c].split("(")[0] in fits]
        return Frame(self.df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(kinds[c])) for c in chosen}) if chosen else self.df)

    def transform(self, func: Callable[..., Frame], *args: Any) -> Frame:
        return func(self, *args)

    def describe(self) -> Frame:
        """Rows count, null_count, mean, std, min, max and median; doubles for numeric columns, text for others, which have no mean, std or median."""
        fields = [f for f in self.df.schema.fields if isinstance(f.dataType, NumericType | StringType | DateType | TimestampType | TimestampNTZType | BooleanType)]
        aggs: list[Column] = []
        for i, f in enumerate(fields):
            x, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NumericType)
            none = F.lit(None).cast("double")
            got = {
                "count": F.count(x), "null_count": F.count_if(x.isNull()), "mean": F.avg(x) if number else none, "std": F.stddev_samp(x) if number else none, "min": F.min(x), "max": F.max(x), "median": F.median(x) if number else none,
            }
            aggs += [v.cast("double" if number else "string").alias(f"{k}_{i}") for k, v in got.items()]
        one = self.df.agg(*aggs) if aggs else self.df.sparkSession.range(1)
        rows = [F.struct(F.lit(k).alias("describe"), *[F.col(f"{k}_{i}").alias(f.name) for i, f in enumerate(fields)]) for k in ("count", "null_count", "mean", "std", "min", "max", "median")]
        return Frame(one.select(F.inline(F.array(*rows))))

    def repartition(self, n: int) -> Frame:
        return Frame(self.df.repartition(n))

    def repartition_by_hash(self, *exprs: Column | str, num: int) -> Frame:
        return Frame(self.df.repartition(num, *exprs))

    def cache(self) -> Frame:
        return Frame(self.df.cache())

    def explain(self, mode: str = "formatted", analyze: bool = False) -> str:
        q = self.df._jdf.queryExecution()
        if analyze:
            self.df.write.format("noop").mode("overwrite").save()
            self.df.count()
        return self.df.sparkSession._jvm.PythonSQLUtils.explainString(q, mode)

    def logical_plan(self) -> LogicalPlan:
        return LogicalPlan(self.df)

    def optimized_logical_plan(self) -> LogicalPlan:
        return LogicalPlan(self.df, optimized=True)

    def execution_plan(self) -> ExecutionPlan:
        return ExecutionPlan(self.df)

    def count(self) -> int:
        return self.df.count()

    def show(self, n: int = 20) -> None:
        self.df.show(n)

    def collect(self) -> list[pa.RecordBatch]:
        return self.to_arrow_table().to_batches()

    def collect_column(self, name: str) -> pa.ChunkedArray:
        return self.df.select(name).toArrow().column(0)

    def collect_partitioned(self) -> list[list[pa.RecordBatch]]:
        """All rows on the driver, by partition."""
        return [list(s) for s in self.execute_stream_partitioned()]

    def execute_stream(self) -> RecordBatchStream:
        return stream(self.df)

    def execute_stream_partitioned(self) -> list[RecordBatchStream]:
        return partition_streams(self.df)

    def default_str_repr(self, rows: int = 20) -> str:
        """The first rows as a text table, and whether there are more."""
        got = self.df.limit(rows + 1).toArrow()
        return text_table(got.slice(0, rows), got.num_rows > rows)

    __repr__ = default_str_repr

    def to_arrow_table(self) -> pa.Table:
        return self.df.toArrow()

    def to_pandas(self) -> Any:
        return self.df.toPandas()

    def to_pylist(self) -> list[dict]:
        return self.to_arrow_table().to_pylist()

    def to_pydict(self) -> dict[str, list]:
        return self.to_arrow_table().to_pydict()

    def to_polars(self) -> Any:
        import polars

        return polars.from_arrow(self.to_arrow_table())

    def write_parquet(self, path: str, options: formats.ParquetWriterOptions = formats.ParquetWriterOptions(), write: formats.WriteOptions = formats.WriteOptions()) -> None:
        formats.write(self.df, path, "parquet", write, **options.options())

    write_parquet_with_options = write_parquet

    def write_csv(self, path: str, with_header: bool = True, write: formats.WriteOptions = formats.WriteOptions()) -> None:
        formats.write(self.df, path, "csv", write, header=with_header)

    def write_json(self, path: str, write: formats.WriteOptions = formats.WriteOptions()) -> None:
        formats.write(self.df, path, "json", write)

    def write_arrow(self, path: str, write: formats.WriteOptions = formats.WriteOptions()) -> None:
        formats.write(self.df, path, "arrow", write)

    def write_avro(self, path: str, write: formats.WriteOptions = formats.WriteOptions()) -> None:
        formats.write(self.df, path, "avro", write)

    def write_table(self, name: str, mode: str = "append") -> None:
        self.df.write.mode(mode).saveAsTable(name)
