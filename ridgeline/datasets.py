"""Two tiny example tables, as frames or as Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The rows of the example tables.
TABLES = {
    "documents": (
        "document_id bigint, title string, tenant_id bigint, status string, category string, embedding array<float>",
        [
            (1, "Vector indexing", 42, "published", "search", [0.0, 0.0]),
            (2, "Lakehouse tables", 42, "published", "storage", [1.0, 0.0]),
            (3, "Query engines", 42, "draft", "compute", [2.0, 0.0]),
            (4, "Approximate search", 7, "published", "search", [8.0, 0.0]),
            (5, "Distributed execution", 42, "published", "compute", [9.0, 0.0]),
            (6, "Catalog recovery", 42, "archived", "storage", [10.0, 0.0]),
        ],
    ),
    "document_stats": (
        "document_id bigint, category string, popularity bigint",
        [(1, "search", 91), (2, "storage", 74), (3, "compute", 68), (4, "search", 86), (5, "compute", 95), (6, "storage", 57)],
    ),
}


def example(spark: SparkSession, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no such example: {name}; there are {', '.join(sorted(TABLES))}")
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def write_examples(spark: SparkSession, folder: str) -> dict[str, str]:
    """Write both as Parquet below a folder; their paths by name."""
    out = {name: f"{folder.rstrip('/')}/{name}.parquet" for name in TABLES}
    for name, path in out.items():
        example(spark, name).coalesce(1).write.mode("overwrite").parquet(path)
    return out
