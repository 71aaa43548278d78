"""Queries of the training-data problems, over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.bpe import VOCABULARY, encoder, shared_vocabulary, token_ids
from ridgeline.llm.clusters import similarity_clusters
from ridgeline.llm.knn import nearest_vectors
from ridgeline.llm.leaks import leaked_items
from ridgeline.llm.pieces import split_documents
from ridgeline.llm.quantiles import merge_sketches, percentile_sketches, sketch_percentiles
from ridgeline.llm.sample import merge_reservoirs, reservoir_sample, reservoirs
from ridgeline.llm.vectors import usable
from ridgeline.plans.ship import ship
from ridgeline.sources.tables import table

DIM = 64
SAMPLE = 2_000
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest documents of every query, with their distance."""
    text = F.col("filter_text")
    value = F.regexp_extract(text, r"^\s*status\s*=\s*'((?:[^']|'')*)'\s*$", 1)
    wanted = F.when(text.isNotNull(), F.when(text.rlike(r"^\s*status\s*=\s*'(?:[^']|'')*'\s*$"), F.replace(value, F.lit("''"), F.lit("'"))).otherwise(F.raise_error(F.concat(F.lit("not a filter on status: "), text))))
    queries = table(spark, d, "queries").select("query_id", "query_vector", "k", wanted.alias("wanted"))
    return nearest_vectors(table(spark, d, "documents"), "doc_id", "embedding", queries, "query_id", "query_vector", "k", dim=DIM, tag="status", wanted="wanted")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_neighbours(spark, d).select("query_id", "doc_id")


def p1_similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest documents (itself among them) of every document whose id is divisible by 20: a stated query set against all rows."""
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_doc_id"), "embedding", F.lit(10).alias("k"))
    return nearest_vectors(docs, "doc_id", "embedding", asked, "query_doc_id", "embedding", "k", dim=DIM)


def p1_similar_ids(spark: SparkSession, d: str) -> DataFrame:
    return p1_similar_documents(spark, d).select("query_doc_id", "doc_id")


def _has_vector(b: pa.RecordBatch) -> np.ndarray:
    mask = np.zeros(b.num_rows, bool)
    mask[usable(b.column("embedding"), DIM)[0]] = True
    return mask


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "batch_no", "embedding")
    return reservoir_sample(docs, SAMPLE, seed=3, keep=_has_vector)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """One reservoir a piece, from one pass over all pieces: what is kept of each when it arrives."""
    docs = table(spark, d, "documents").select("doc_id", "batch_no", "embedding")
    return merge_reservoirs(reservoirs(docs, SAMPLE, 3, _has_vector, piece="batch_no"), SAMPLE, ["batch_no"], 3)


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """How many records each piece's reservoir stands for, and how many it keeps."""
    return _pieces(spark, d).groupBy("batch_no").agg(F.first("_population").alias("population"), F.count(F.lit(1)).alias("kept"))


def p3_from_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the whole from the kept states of its pieces, with the number of records that it stands for."""
    apart = _pieces(spark, d).withColumn("_reservoir", F.xxhash64("batch_no"))
    return merge_reservoirs(apart, SAMPLE, seed=3).select("doc_id", "batch_no", F.col("_population").alias("population"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    groups = ["implementation", "nprobe"]
    sketches = percentile_sketches(table(spark, d, "search_curve"), groups, "latency_ms_samples", once="point_id")
    return sketch_percentiles(sketches, groups, PERCENTILES)


def p4_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles by merging the sketches of separate days."""
    groups = ["implementation", "nprobe"]
    points = table(spark, d, "search_curve").withColumn("day", F.to_date("measured_at"))
    days = percentile_sketches(points, [*groups, "day"], "latency_ms_samples", once="point_id")
    return sketch_percentiles(merge_sketches(days, groups), groups, PERCENTILES)


def p4_extent(spark: SparkSession, d: str) -> DataFrame:
    """What of a sketch is exact: the number of samples and the ends."""
    groups = ["implementation", "nprobe"]
    sketches = percentile_sketches(table(spark, d, "search_curve"), groups, "latency_ms_samples", once="point_id")
    return sketch_percentiles(sketches, groups, (0.0, 1.0)).select(*groups, "samples", "p0", "p100")


def p4_error(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ranks of all percentiles, counted exactly, lie within a sketch's own error bound."""
    groups = ["implementation", "nprobe"]
    points = table(spark, d, "search_curve").dropDuplicates(["point_id"]).select(*groups, F.explode("latency_ms_samples").alias("x")).where("x > 0 AND x < double('infinity')")
    asked = p4_percentiles(spark, d).withColumnsRenamed({g: f"of_{g}" for g in groups})
    met = points.join(F.broadcast(asked), F.col("implementation").eqNullSafe(F.col("of_implementation")) & F.col("nprobe").eqNullSafe(F.col("of_nprobe")))  # a row a group, of which there are few
    off = []
    for q in PERCENTILES:
        p = F.col(f"p{q * 100:g}")
        below, upto = F.count_if(F.col("x") < p) / F.count(F.lit(1)), F.count_if(F.col("x") <= p) / F.count(F.lit(1))
        # A sketch's percentile is a value that is there: its rank runs from ``below`` to ``upto``; one value more or less is no error.
        off.append(F.greatest(below - q, q - upto) <= F.max("rank_error") + 1 / F.count(F.lit(1)))
    return met.groupBy(*groups).agg(reduce(lambda a, b: a & b, off).alias("within"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(table(spark, d, "documents"), "doc_id", "embedding", dim=DIM)[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    clusters, membership = similarity_clusters(table(spark, d, "documents"), "doc_id", "embedding", dim=DIM)
    kept = clusters.where("size >= 5 AND mutual AND isolated").select("cluster")
    return membership.join(kept, "cluster").select(F.col("cluster").alias("cluster_doc_id"), "doc_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text as decoded from its ids."""
    ship(spark)
    find = shared_vocabulary(spark, VOCABULARY)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(find())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode_bytes(ids) for ids in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])

    return p7_ids(spark, d).mapInArrow(decoded, "doc_id bigint, text binary").select("doc_id", F.md5("text").alias("digest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece_no = 1").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_neighbours, p1_similar_documents, p1_similar_ids, p3_sample, p3_pieces, p3_from_pieces, p4_percentiles, p4_from_days, p4_extent, p4_error, p6_clusters, p6_found, p7_ids, p7_decoded, p8_found, p9_found, p9_pieces)
}
#: Nodes that share one closed neighbourhood of as many nodes are a clique without outside neighbours. All pairs: for small tables only.
_USABLE = f"len({{v}}) = {DIM} AND len(list_filter({{v}}, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND len(list_filter({{v}}, lambda x: x <> 0)) > 0"
ORACLE: dict[str, str] = {
    # Exact, by all pairs: for small tables only. There the search finds everything.
    "p1_found": f"""
WITH q AS (SELECT DISTINCT ON (query_id) query_id, query_vector::DOUBLE[] AS v, k, filter_text FROM queries WHERE {_USABLE.format(v="query_vector")}),
d AS (SELECT doc_id, embedding::DOUBLE[] AS e, status FROM documents WHERE {_USABLE.format(v="embedding")})
SELECT query_id, doc_id FROM (SELECT query_id, doc_id, k, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(e, v), doc_id) AS r FROM q JOIN d ON filter_text IS NULL OR status = regexp_extract(filter_text, '([^'']*)'' *$', 1)) WHERE r <= k
""",
    "p1_similar_ids": f"""
WITH d AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE {_USABLE.format(v="embedding")})
SELECT query_doc_id, doc_id FROM (SELECT q.doc_id AS query_doc_id, d.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY list_distance(d.e, q.e), d.doc_id) AS r FROM (SELECT * FROM d WHERE doc_id % 20 = 0) q, d) WHERE r <= 10
""",
    "p4_extent": """
SELECT implementation, nprobe, count(*) AS samples, min(x) AS p0, max(x) AS p100 FROM (SELECT implementation, nprobe, unnest(latency_ms_samples) AS x FROM (SELECT DISTINCT ON (point_id) * FROM search_curve))
WHERE isfinite(x) AND x > 0 GROUP BY implementation, nprobe
""",
    "p4_error": """
SELECT DISTINCT implementation, nprobe, true AS within FROM (SELECT implementation, nprobe, unnest(latency_ms_samples) AS x FROM search_curve) WHERE isfinite(x) AND x > 0
""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p3_pieces": f"""
SELECT batch_no, count(*) AS population, CAST(least(count(*), {SAMPLE}) AS BIGINT) AS kept FROM documents WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
GROUP BY batch_no
""",
    "p6_found": """
WITH v AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT a.doc_id, count(*) AS c, min(b.doc_id) AS first, sum(hash(b.doc_id)::HUGEINT) AS mark FROM v a, v b WHERE list_distance(a.e, b.e) ** 2 < 350 GROUP BY a.doc_id),
k AS (SELECT c, first, mark FROM n GROUP BY c, first, mark HAVING count(*) = c AND c >= 5)
SELECT first AS cluster_doc_id, doc_id FROM n JOIN k USING (c, first, mark)
""",
}
