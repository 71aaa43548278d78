"""Compile a vector query to a DataFrame: route to clusters, prune files, filter, measure, keep the nearest."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.ship import ship
from ridgeline.plans.statements import plain_expression
from ridgeline.records import stream
from ridgeline.vector import lvq
from ridgeline.vector.build import RESERVED, decoded_centroids, matrix, read_table, vector_columns
from ridgeline.vector.errors import Corrupt, InvalidArgument, InvalidSchema
from ridgeline.vector.formats import check_postings, load
from ridgeline.vector.query import VectorQuery
from ridgeline.vector.storage import Warehouse


def canonical_query(query: Sequence[float], dim: int | None, metric: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        q = np.asarray(query, np.float64).astype(np.float32)
    if q.ndim != 1 or not len(q) or not np.isfinite(q).all():
        raise InvalidArgument("the query vector must hold finite values")
    if dim is not None and len(q) != dim:
        raise InvalidArgument(f"the query vector has {len(q)} values, the index {dim}")
    if metric == "cosine":
        norm = np.sqrt((q.astype(np.float64) ** 2).sum())
        if not norm > 0:
            raise InvalidArgument("cosine needs a query of a norm above zero")
        q = (q * (1 / norm)).astype(np.float32)
    return q


def distance_to(q: np.ndarray, metric: str = "l2_squared"):
    """An Arrow UDF: squared L2 between canonical vectors and a fixed query; null for a null vector, an error for another length or a non-finite result."""
    values = q.astype(np.float64)

    @F.arrow_udf("float")
    def measured(v: pa.Array) -> pa.Array:
        from ridgeline.vector.build import matrix as canonical

        there = v.is_valid().to_numpy(zero_copy_only=False)
        some = v.drop_null()
        if (np.diff(some.offsets.to_numpy()) != len(values)).any():
            raise ValueError("a vector has another dimension than the query")
        out = np.zeros(len(v), np.float32)
        x = canonical(some, len(values), metric)
        out[there] = ((x.astype(np.float64) - values) ** 2).sum(1) if len(x) else 0
        if not np.isfinite(out).all():
            raise ValueError("a distance is not finite")
        return pa.array(out, mask=~there)

    return measured


def code_distance_to(q: np.ndarray, bits: int):
    """An Arrow UDF over (offset, scale, code)."""
    values, w = q.astype(np.float64), lvq.width(len(q), bits)

    @F.arrow_udf("float")
    def measured(offset: pa.Array, scale: pa.Array, code: pa.Array) -> pa.Array:
        from ridgeline.vector import lvq as codec

        raw = b"".join(code.to_pylist())
        if len(raw) != w * len(code):
            raise ValueError("a code has a wrong length")
        x = codec.decode(offset.to_numpy(), scale.to_numpy(), np.frombuffer(raw, np.uint8).reshape(-1, w), len(values), bits)
        return pa.array(((x - values) ** 2).sum(1).astype(np.float32))

    return measured


class ByteCache:
    """The values used last, up to so many bytes in all; a value larger than that is not kept."""

    def __init__(self, most: int):
        self.most, self.held, self.bytes, self.hits, self.misses, self.lock = most, OrderedDict(), 0, 0, 0, threading.Lock()

    def get(self, key: tuple, make: Callable[[], tuple[object, int]]) -> object:
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                self.hits += 1
                return self.held[key][0]
            self.misses += 1
        value, size = make()
        with self.lock:
            if key not in self.held and size <= self.most:
                self.held[key] = (value, size)
                self.bytes += size
                self._shrink()
        return value

    def _shrink(self) -> None:
        while self.bytes > self.most:
            self.bytes -= self.held.popitem(last=False)[1][1]

    def limit(self, most: int) -> None:
        with self.lock:
            self.most = most
            self._shrink()

    def clear(self) -> None:
        with self.lock:
            self.held.clear()
            self.bytes = 0

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.held), "bytes": self.bytes, "most_bytes": self.most, "hits": self.hits, "misses": self.misses}


CENTROIDS, MANIFESTS = ByteCache(256 << 20), ByteCache(64 << 20)


def _centroids(uri: str, location: str, dim: int) -> np.ndarray:
    def make() -> tuple[np.ndarray, int]:
        m = decoded_centroids(read_table(Warehouse(uri), f"{location}part-00000.parquet"), dim)
        return m, m.nbytes

    return CENTROIDS.get((uri, location, dim), make)


def _manifest(uri: str, location: str) -> dict:
    def make() -> tuple[dict, int]:
        raw = Warehouse(uri).read_bytes(f"{location}manifest.json")
        return check_postings(load(raw.decode())), 4 * len(raw)

    return MANIFESTS.get((uri, location), make)


def relations(warehouse: Warehouse, snapshot: dict) -> tuple[str, str]:
    """(centroids, postings) locations of a snapshot."""
    r = snapshot["index-relations"]
    if "artifact_manifest" in r:
        doc = warehouse.read_json(r["artifact_manifest"])
        if doc.get("index") != snapshot["parameters"]:
            raise Corrupt("the artifact manifest belongs to another snapshot")
        return doc["hierarchy"]["centroids"], doc["postings"]
    return r["ivf_centroids"], r["ivf_postings"]


def clear_caches() -> None:
    CENTROIDS.clear()
    MANIFESTS.clear()


def route(centroids: np.ndarray, q: np.ndarray, nprobe: int) -> np.ndarray:
    """The ``nprobe`` nearest clusters, ties to the smaller id."""
    d = ((centroids.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1)
    return np.lexsort((np.arange(len(d)), d))[:nprobe]


def postings(spark, warehouse: Warehouse, snapshot: dict, cids: np.ndarray | None, inline: int = 128) -> DataFrame:
    """Postings of the clusters: files by the manifest, row groups by statistics, and the predicate itself."""
    _, location = relations(warehouse, snapshot)
    files = _manifest(warehouse.uri, location)["files"]
    if cids is not None:
        wanted = np.sort(cids)
        files = [f for f in files if np.searchsorted(wanted, f["min-cid"]) < np.searchsorted(wanted, f["max-cid"], "right")]
    if not files:
        files, cids = _manifest(warehouse.uri, location)["files"][:1], np.zeros(0, np.int64)
    df = spark.read.parquet(*[warehouse.spark_path(f"{location}{f['path']}") for f in files])
    if cids is None:
        return df
    if not len(cids):
        return df.where(F.lit(False))
    if len(cids) <= inline:
        return df.where(F.col("cid").isin([int(c) for c in cids]))
    chosen = spark.createDataFrame(pa.table({"cid": pa.array(cids.astype(np.int32))}))
    return df.join(F.broadcast(chosen), "cid", "left_semi")  # at most nlist integers


def output_columns(source: DataFrame, projection: Sequence[str] | None) -> list[str]:
    cols = list(projection) if projection is not None else source.columns
    if not cols or len(set(cols)) != len(cols):
        raise InvalidArgument("a projection names at least one column, each once")
    for c in cols:
        if c not in source.columns:
            raise InvalidArgument(f"column not found: {c}")
    return cols


def _eligible(source: DataFrame, predicate: str | None) -> DataFrame:
    if predicate is None:
        return source
    try:
        if not plain_expression(source.sparkSession, predicate):
            raise InvalidArgument("a predicate takes neither subqueries nor reflection")
        return source.where(F.expr(predicate))
    except InvalidArgument:
        raise
    except Exception as e:
        raise InvalidArgument(f"the predicate cannot be used: {e}") from e


def _top(df: DataFrame, distance: Column, ties: Sequence[str], k: int) -> DataFrame:
    return df.withColumn(RESERVED, distance).orderBy(RESERVED, *[F.col(f"`{t}`") for t in ties]).limit(k)


def exact(source: DataFrame, query: VectorQuery) -> DataFrame:
    """All eligible rows, always by squared L2."""
    if query.index is not None or query.part("nprobes") is not None:
        raise InvalidArgument("an exact search takes neither an index nor nprobes")
    column = query.column
    if column is None:
        found = vector_columns(source)
        if len(found) != 1:
            raise InvalidArgument("the vector column must be named" if found else "the table has no vector column")
        column = found[0]
    elif column not in vector_columns(source):
        raise InvalidSchema(f"vector column not found: {column}")
    ship(source.sparkSession)
    cols = output_columns(source, query.part("select"))
    q = canonical_query(query.vector, None, "l2_squared")
    rows = _eligible(source, query.part("where")).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, column])])
    simple = [f.name for f in rows.schema.fields if isinstance(f.dataType.simpleString(), str) and f.dataType.simpleString() in ("bigint", "int", "string", "date", "boolean")]
    return _top(rows, distance_to(q)(F.col(f"`{column}`")), simple[:1], query.part("limit")).select(*[F.col(f"`{c}`") for c in cols], RESERVED)


def indexed(source: DataFrame, query: VectorQuery, warehouse: Warehouse, snapshot: dict, inline: int = 128) -> DataFrame:
    """Search the clusters that routing picks. Quantised postings without a filter are ranked before the source is read."""
    spark = source.sparkSession
    ship(spark)
    p, keys, metric, column = snapshot["parameters"], snapshot["source-key-fields"], snapshot["metric"], snapshot["vector-field"]
    dim, nlist, encoding = int(p["dimension"]), int(p["nlist"]), p["posting_encoding"]
    nprobe = query.part("nprobes") if query.part("nprobes") is not None else min(nlist, 20)
    if nprobe > nlist:
        raise InvalidArgument(f"nprobes must not exceed nlist: {nprobe} > {nlist}")
    cols = output_columns(source, query.part("select"))
    q = canonical_query(query.vector, dim, metric)
    cids = None if nprobe == nlist else route(_centroids(warehouse.uri, relations(warehouse, snapshot)[0], dim), q, nprobe)
    found = postings(spark, warehouse, snapshot, cids, inline)
    key_names = [f"key_{i + 1}" for i in range(len(keys))]
    rows = _eligible(source, query.part("where"))
    half = F.col(RESERVED) * F.lit(0.5).cast("float") if metric == "cosine" else F.col(RESERVED)
    final = [*[F.col(f"`{c}`") for c in cols], half.cast("float").alias(RESERVED)]
    if encoding == "source":
        needed = list(dict.fromkeys([*cols, *keys, column]))
        joined = rows.select(*[F.col(f"`{c}`") for c in needed]).join(found.select(*key_names), [F.col(f"`{k}`") == F.col(n) for k, n in zip(keys, key_names)]).drop(*key_names)
        return _top(joined, distance_to(q, metric)(F.col(f"`{column}`")), keys, query.part("limit")).select(*final)
    measure = code_distance_to(q, 4 if encoding == "lvq4" else 8)("offset", "scale", "code")
    renamed = found.select(*[F.col(n).alias(k) for n, k in zip(key_names, keys)], "offset", "scale", "code")
    if query.part("where") is None:
        top = _top(renamed, measure, keys, query.part("limit")).select(*[F.col(f"`{k}`") for k in keys], RESERVED)
        if set(cols) <= set(keys):
            return top.select(*final)
        best = F.broadcast(top)  # at most k rows
        return rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, *keys])]).join(best, list(keys)).orderBy(RESERVED, *[F.col(f"`{k}`") for k in keys]).select(*final)
    needed = list(dict.fromkeys([*cols, *keys]))
    joined = rows.select(*[F.col(f"`{c}`") for c in needed]).join(renamed, list(keys))
    return _top(joined, measure, keys, query.part("limit")).select(*final)


def recall(exact_rows: DataFrame, found: DataFrame, query_id: str, key: str) -> DataFrame:
    """Rows (query_id, recall): the share of each query's exact neighbours that was found."""
    hits = exact_rows.select(query_id, key).distinct().join(found.select(query_id, key).distinct().withColumn("hit", F.lit(1)), [query_id, key], "left")
    return hits.groupBy(query_id).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The result as Arrow batches, partition by partition."""
    yield from stream(df)


__all__ = ["batches", "canonical_query", "clear_caches", "code_distance_to", "distance_to", "exact", "indexed", "matrix", "postings", "recall", "relations", "route"]
