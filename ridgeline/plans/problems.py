"""Queries of the general data-quality problems, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.orphans import MATCHES, orphan_references
from ridgeline.operators.skew import heavy_keys, range_stitched_totals, running_totals
from ridgeline.sources.tables import table

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _references(spark: SparkSession, d: str) -> DataFrame:
    namespaces, objects = table(spark, d, "catalog_namespaces"), table(spark, d, "metadata_objects")
    indexes = table(spark, d, "catalog_indexes")
    tombstones = table(spark, d, "catalog_tombstones").withColumn("at", F.expr(f"timestampadd(MILLISECOND, unreachable_since_ms, {EPOCH})"))
    cases = (
        ("catalog_indexes", "namespace", indexes, "entry_id", "registered_at", namespaces, "created_at", "dropped_at"),
        ("catalog_indexes", "metadata_location", indexes, "entry_id", "registered_at", objects, "written_at", "deleted_at"),
        ("catalog_tombstones", "metadata_location", tombstones, "tombstone_id", "at", objects, "written_at", "deleted_at"),
    )
    out = None
    for name, field, refs, ref_id, at, parents, begin, end in cases:
        orphans = orphan_references(refs, ref_id, [field], parents, [field], ref_time=at, alive_from=begin, alive_to=end)
        rows = orphans.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.date_format("r_time", "yyyy-MM").alias("period"), F.col("r_id").alias("ref_id"))
        out = rows if out is None else out.unionAll(rows)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).groupBy("ref_table", "ref_field", "period").agg(F.countDistinct("ref_id").alias("orphans"))


LATER = "2026-01-01"


def p2_composite(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of namespace and metadata file, either of which may be null, that no earlier registration has, by each match rule."""
    rows = table(spark, d, "catalog_indexes")
    refs, parents = rows.where(F.col("registered_at") >= F.lit(LATER)), rows.where(F.col("registered_at") < F.lit(LATER))
    keys = ["namespace", "metadata_location"]
    found = [orphan_references(refs, "entry_id", keys, parents, keys, match=m).select(F.lit(m).alias("match"), F.col("r_id").alias("ref_id")) for m in MATCHES]
    return reduce(DataFrame.unionAll, found).distinct()


def p5_bucket_totals(spark: SparkSession, d: str) -> DataFrame:
    return range_stitched_totals(table(spark, d, "ivf_postings_files"), "cid_bucket", "file_id", "rows")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(p5_bucket_totals(spark, d), "cid_bucket", 0.02)


def p5_running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per file the rows of its bucket so far, in the order of the files: a per-key result that a heavy bucket cannot hold up."""
    files = table(spark, d, "ivf_postings_files").where(F.col("cid_bucket").isNotNull())
    once = files.groupBy("cid_bucket", "file_id").agg(F.max(F.greatest(F.coalesce("rows", F.lit(0)), F.lit(0))).alias("n"))
    return running_totals(once, "cid_bucket", "file_id", "n").select("cid_bucket", "file_id", "running_total")


_REF_SQL = """
SELECT DISTINCT 'catalog_indexes' AS ref_table, 'namespace' AS ref_field, strftime(registered_at, '%Y-%m') AS period, entry_id AS ref_id
FROM catalog_indexes r WHERE namespace IS NOT NULL AND registered_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM catalog_namespaces p WHERE p.namespace = r.namespace AND p.created_at <= r.registered_at AND (p.dropped_at IS NULL OR r.registered_at < p.dropped_at))
UNION ALL
SELECT DISTINCT 'catalog_indexes', 'metadata_location', strftime(registered_at, '%Y-%m'), entry_id
FROM catalog_indexes r WHERE metadata_location IS NOT NULL AND registered_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM metadata_objects p WHERE p.metadata_location = r.metadata_location AND p.written_at <= r.registered_at AND (p.deleted_at IS NULL OR r.registered_at < p.deleted_at))
UNION ALL
SELECT DISTINCT 'catalog_tombstones', 'metadata_location', strftime(make_timestamp(unreachable_since_ms * 1000), '%Y-%m'), tombstone_id
FROM catalog_tombstones r WHERE NOT EXISTS (
  SELECT 1 FROM metadata_objects p WHERE p.metadata_location = r.metadata_location AND p.written_at <= make_timestamp(unreachable_since_ms * 1000)
  AND (p.deleted_at IS NULL OR make_timestamp(unreachable_since_ms * 1000) < p.deleted_at))
"""
_COMPOSITE_SQL = f"""
WITH r AS (SELECT entry_id, namespace AS n, metadata_location AS m FROM catalog_indexes WHERE registered_at >= TIMESTAMP '{LATER}'), p AS (SELECT namespace AS n, metadata_location AS m FROM catalog_indexes WHERE registered_at < TIMESTAMP '{LATER}')
SELECT DISTINCT 'simple' AS match, entry_id AS ref_id FROM r WHERE n IS NOT NULL AND m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.n = r.n AND p.m = r.m)
UNION ALL SELECT DISTINCT 'full', entry_id FROM r WHERE (n IS NULL) <> (m IS NULL) OR n IS NOT NULL AND m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.n = r.n AND p.m = r.m)
UNION ALL SELECT DISTINCT 'partial', entry_id FROM r WHERE (n IS NOT NULL OR m IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM p WHERE (r.n IS NULL OR p.n = r.n) AND (r.m IS NULL OR p.m = r.m))
"""
_TOTAL_SQL = """
SELECT cid_bucket, CAST(sum(greatest(coalesce(rows, 0), 0)) AS BIGINT) AS total, count(*) AS entries
FROM (SELECT file_id, cid_bucket, max(rows) AS rows FROM ivf_postings_files WHERE cid_bucket IS NOT NULL GROUP BY file_id, cid_bucket) GROUP BY cid_bucket
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_report": p2_report, "p2_composite": p2_composite, "p5_found": p5_found, "p5_bucket_totals": p5_bucket_totals, "p5_running_totals": p5_running_totals}
ORACLE = {
    "p2_found": _REF_SQL,
    "p2_report": f"SELECT ref_table, ref_field, period, count(DISTINCT ref_id) AS orphans FROM ({_REF_SQL}) GROUP BY ref_table, ref_field, period",
    "p2_composite": _COMPOSITE_SQL,
    "p5_found": f"WITH t AS ({_TOTAL_SQL}) SELECT cid_bucket FROM t WHERE total > 0 AND total * 50 >= (SELECT sum(total) FROM t)",
    "p5_bucket_totals": _TOTAL_SQL,
    "p5_running_totals": """
SELECT cid_bucket, file_id, CAST(sum(n) OVER (PARTITION BY cid_bucket ORDER BY file_id) AS BIGINT) AS running_total
FROM (SELECT cid_bucket, file_id, max(greatest(coalesce(rows, 0), 0)) AS n FROM ivf_postings_files WHERE cid_bucket IS NOT NULL GROUP BY cid_bucket, file_id)
""",
}
