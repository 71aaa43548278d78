"""Catalogs, schemas and tables: those of Spark, and those that a Python provider offers by name."""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


class Table:
    def __init__(self, df: DataFrame, name: str, kind: str = "BASE"):
        self.df, self.name, self.kind = df, name, kind

    @property
    def schema(self) -> pa.Schema:
        return to_arrow_schema(self.df.schema)


def as_frame(spark: SparkSession, source: Any) -> DataFrame:
    """A DataFrame of a DataFrame, a frame, a table, an Arrow table or batch, or an object that has ``to_frame(spark)``."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, pa.RecordBatch):
        source = pa.Table.from_batches([source])
    if isinstance(source, pa.Table):
        return spark.createDataFrame(source)
    if hasattr(source, "to_frame"):
        return as_frame(spark, source.to_frame(spark))
    if isinstance(getattr(source, "df", None), DataFrame):
        return source.df
    raise TypeError(f"not a table: {type(source).__name__}")


class SchemaProvider:
    """A schema in Python: names, and what each name stands for. This one holds what is registered with it."""

    def __init__(self) -> None:
        self.held: dict[str, Any] = {}

    def table_names(self) -> set[str]:
        return set(self.held)

    def table(self, name: str) -> Any:
        return self.held.get(name)

    def register_table(self, name: str, table: Any) -> None:
        self.held[name] = table

    def deregister_table(self, name: str, cascade: bool = True) -> None:
        self.held.pop(name, None)

    def table_exist(self, name: str) -> bool:
        return name in self.table_names()


class CatalogProvider:
    """A catalog in Python: names of schemas and their providers. This one holds what is registered with it."""

    def __init__(self) -> None:
        self.held: dict[str, SchemaProvider] = {}

    def schema_names(self) -> set[str]:
        return set(self.held)

    def schema(self, name: str) -> SchemaProvider | None:
        return self.held.get(name)

    def register_schema(self, name: str, schema: SchemaProvider) -> None:
        self.held[name] = schema

    def deregister_schema(self, name: str, cascade: bool = False) -> None:
        if name in self.held and self.held[name].table_names() and not cascade:
            raise ValueError(f"the schema has tables: {name}")
        self.held.pop(name, None)


class SparkSchema(SchemaProvider):
    """A database of Spark."""

    def __init__(self, spark: SparkSession, catalog: str, name: str):
        self.spark, self.full = spark, f"`{catalog}`.`{name}`"

    def table_names(self) -> set[str]:
        return {t.name for t in self.spark.catalog.listTables(self.full) if not t.isTemporary}

    def table(self, name: str) -> Any:
        return self.spark.table(f"{self.full}.`{name}`") if name in self.table_names() else None

    def register_table(self, name: str, table: Any) -> None:
        as_frame(self.spark, table).write.saveAsTable(f"{self.full}.`{name}`")

    def deregister_table(self, name: str, cascade: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.full}.`{name}`")


class SparkCatalog(CatalogProvider):
    """A catalog of Spark."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def schema_names(self) -> set[str]:
        return {r[0] for r in self.spark.sql(f"SHOW NAMESPACES IN `{self.name}`").collect()}

    def schema(self, name: str) -> SchemaProvider | None:
        return SparkSchema(self.spark, self.name, name) if name in self.schema_names() else None

    def register_schema(self, name: str, schema: SchemaProvider | None = None) -> None:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{self.name}`.`{name}`")
        for t in schema.table_names() if schema else ():
            SparkSchema(self.spark, self.name, name).register_table(t, schema.table(t))

    def deregister_schema(self, name: str, cascade: bool = False) -> None:
        self.spark.sql(f"DROP NAMESPACE IF EXISTS `{self.name}`.`{name}` {'CASCADE' if cascade else 'RESTRICT'}")


class Catalog:
    """What a context knows by a catalog's name."""

    def __init__(self, spark: SparkSession, provider: CatalogProvider):
        self.spark, self.provider = spark, provider

    def schema_names(self) -> set[str]:
        return self.provider.schema_names()

    names = schema_names

    def schema(self, name: str = "default") -> Schema:
        got = self.provider.schema(name)
        if got is None:
            raise KeyError(f"schema not found: {name}")
        return Schema(self.spark, got)

    def register_schema(self, name: str, schema: SchemaProvider) -> None:
        self.provider.register_schema(name, schema)

    def deregister_schema(self, name: str, cascade: bool = False) -> None:
        self.provider.deregister_schema(name, cascade)


class Schema:
    def __init__(self, spark: SparkSession, provider: SchemaProvider):
        self.spark, self.provider = spark, provider

    def table_names(self) -> set[str]:
        return self.provider.table_names()

    names = table_names

    def table(self, name: str) -> Table:
        got = self.provider.table(name)
        if got is None:
            raise KeyError(f"table not found: {name}")
        return Table(as_frame(self.spark, got), name)

    def register_table(self, name: str, table: Any) -> None:
        self.provider.register_table(name, table)

    def deregister_table(self, name: str) -> None:
        self.provider.deregister_table(name)

    def table_exist(self, name: str) -> bool:
        return self.provider.table_exist(name)


class CatalogList:
    """Catalogs by name: the registered providers, then those of Spark."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def catalog_names(self) -> list[str]:
        return sorted({*self.held, *(c.name for c in self.spark.catalog.listCatalogs())})

    def catalog(self, name: str) -> Catalog:
        if name in self.held:
            return Catalog(self.spark, self.held[name])
        if name not in self.catalog_names():
            raise KeyError(f"catalog not found: {name}")
        return Catalog(self.spark, SparkCatalog(self.spark, name))

    def register_catalog(self, name: str, provider: CatalogProvider) -> None:
        self.held[name] = provider

    def resolve(self, name: str) -> DataFrame | None:
        """The table ``catalog.schema.table`` of a registered provider."""
        parts = name.split(".")
        if len(parts) != 3 or parts[0] not in self.held:
            return None
        return self.catalog(parts[0]).schema(parts[1]).table(parts[2]).df

    def bound(self, statement: str) -> str:
        """The statement with the provider tables it names registered as views; three-part names outside quotes are replaced."""
        if not self.held:
            return statement
        names = "|".join(map(re.escape, self.held))
        pattern = re.compile(rf"('(?:[^'\\]|\\.|'')*'|`[^`]*`|\"[^\"]*\")|(?<![\w.])((?:{names})\.\w+\.\w+)(?![\w.(])")

        def view(m: re.Match) -> str:
            if m[1]:
                return m[1]
            df = self.resolve(m[2])
            alias = "ridgeline_" + m[2].replace(".", "_")
            df.createOrReplaceTempView(alias)
            return alias

        return pattern.sub(view, statement)
