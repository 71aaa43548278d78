"""Settings of a session context, of the environment it runs in, and of what its SQL may do."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SQLOptions:
    """Kinds of statements that are allowed besides reading."""

    allow_ddl: bool = True
    allow_dml: bool = True
    allow_statements: bool = True

    def with_allow_ddl(self, allow: bool = True) -> SQLOptions:
        return replace(self, allow_ddl=allow)

    def with_allow_dml(self, allow: bool = True) -> SQLOptions:
        return replace(self, allow_dml=allow)

    def with_allow_statements(self, allow: bool = True) -> SQLOptions:
        return replace(self, allow_statements=allow)


@dataclass(frozen=True)
class SessionConfig:
    """Settings by name, as those of Spark that have the same effect. Each method returns a changed copy.

    Spark decides by itself, from sizes seen at run time, whether a join, an aggregation or a sort needs an exchange: switching one
    off keeps Spark from splitting and coalescing its partitions, never from shuffling where the result needs it.
    """

    conf: dict[str, str] = field(default_factory=dict)
    default: tuple[str, str] | None = None
    information: bool = False

    def set(self, key: str, value: object) -> SessionConfig:
        text = str(value).lower() if isinstance(value, bool) else str(value)
        return replace(self, conf={**self.conf, key: text})

    def with_create_default_catalog_and_schema(self, enabled: bool = True) -> SessionConfig:
        return replace(self, default=("spark_catalog", "default") if enabled else None)

    def with_default_catalog_and_schema(self, catalog: str, schema: str) -> SessionConfig:
        return replace(self, default=(catalog, schema))

    def with_information_schema(self, enabled: bool = True) -> SessionConfig:
        return replace(self, information=enabled)

    def _positive(self, n: int) -> int:
        if n < 1:
            raise ValueError("a positive number is needed")
        return n

    def with_batch_size(self, rows: int) -> SessionConfig:
        n = self._positive(rows)
        return self.set("spark.sql.execution.arrow.maxRecordsPerBatch", n).set("spark.sql.parquet.columnarReaderBatchSize", n)

    def with_target_partitions(self, n: int) -> SessionConfig:
        return self.set("spark.sql.shuffle.partitions", self._positive(n))

    def with_repartition_aggregations(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.adaptive.coalescePartitions.enabled", enabled)

    def with_repartition_joins(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.adaptive.skewJoin.enabled", enabled)

    def with_repartition_windows(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", enabled)

    def with_repartition_sorts(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.adaptive.localShuffleReader.enabled", enabled)

    def with_repartition_file_scans(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.files.maxPartitionBytes", 128 << 20 if enabled else (1 << 63) - 1)

    def with_repartition_file_min_size(self, size: int) -> SessionConfig:
        return self.set("spark.sql.files.openCostInBytes", self._positive(size))

    def with_parquet_pruning(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.parquet.filterPushdown", enabled)

    def apply(self, spark: SparkSession) -> None:
        for k, v in self.conf.items():
            spark.conf.set(k, v)
        if self.default:
            spark.catalog.setCurrentCatalog(self.default[0])
            spark.catalog.setCurrentDatabase(self.default[1])


@dataclass(frozen=True)
class RuntimeEnvBuilder:
    """Memory and spill folders. They are fixed when a Spark application starts: ``options`` are for the session's builder."""

    options: dict[str, str] = field(default_factory=dict)

    def _with(self, **options: str) -> RuntimeEnvBuilder:
        return RuntimeEnvBuilder({**self.options, **{k.replace("__", "."): v for k, v in options.items()}})

    def with_disk_manager_os(self) -> RuntimeEnvBuilder:
        import tempfile

        return self._with(spark__local__dir=tempfile.gettempdir())

    def with_disk_manager_specified(self, *paths: str) -> RuntimeEnvBuilder:
        if not paths:
            raise ValueError("at least one folder is needed")
        return self._with(spark__local__dir=",".join(paths))

    def with_temp_file_path(self, path: str) -> RuntimeEnvBuilder:
        return self._with(spark__local__dir=path)

    def with_disk_manager_disabled(self) -> RuntimeEnvBuilder:
        """Spark always spills rather than fail; what can be avoided is shuffle data on disk beyond what a task needs."""
        return self._with(spark__shuffle__spill__compress="true", spark__shuffle__compress="true")

    def with_fair_spill_pool(self, size: int) -> RuntimeEnvBuilder:
        """Tasks of an executor share its memory evenly, which Spark's unified memory does."""
        return self._with(spark__executor__memory=f"{max(1, size >> 20)}m", spark__memory__fraction="0.6")

    def with_greedy_memory_pool(self, size: int) -> RuntimeEnvBuilder:
        return self._with(spark__executor__memory=f"{max(1, size >> 20)}m", spark__memory__fraction="0.8")

    def with_unbounded_memory_pool(self) -> RuntimeEnvBuilder:
        return self._with(spark__memory__fraction="0.9", spark__memory__storageFraction="0.1")

    def builder(self, base: SparkSession.Builder | None = None) -> SparkSession.Builder:
        out = base or SparkSession.builder
        for k, v in self.options.items():
            out = out.config(k, v)
        return out
