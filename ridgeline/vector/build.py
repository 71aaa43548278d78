"""Build an inverted file: one pass for checks and counts, a bounded sample to train, one pass to assign, encode and write.

Rows are assigned to the nearest of the persisted (8-bit) leaf centroids by a matrix product in each task, once. Postings go to ranges of
(root, cluster, hash of the key) whose bounds come from the cluster sizes of a bounded sample, so a heavy cluster is written by several tasks, and
each task writes Parquet files whose row groups hold exactly one cluster.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType

from ridgeline.plans.lineage import cut_lineage
from ridgeline.plans.ship import ship
from ridgeline.vector import lvq
from ridgeline.vector.config import IVF, WriteOptions
from ridgeline.vector.errors import Backend, InvalidArgument, InvalidSchema
from ridgeline.vector.formats import check_postings, fingerprint
from ridgeline.vector.storage import Warehouse
from ridgeline.vector.training import Hierarchy, budgets, closest, kmeans, train

KEY_TYPES = (BooleanType, IntegerType, LongType, BinaryType, StringType, DateType)
RESERVED = "_distance"
LOCAL = 1 << 24  # sampled values that the driver trains by itself


def vector_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, FloatType | DoubleType)]


def check_source(df: DataFrame, column: str, keys: Sequence[str]) -> None:
    """Names and types; values are checked by the first pass."""
    names = df.columns
    if RESERVED in names:
        raise InvalidSchema(f"the source has the reserved column {RESERVED}")
    if column not in names:
        raise InvalidSchema(f"vector column not found: {column}")
    if column not in vector_columns(df):
        raise InvalidSchema(f"vector column {column} must be list<float> or list<double>")
    if not keys or len(set(keys)) != len(keys):
        raise InvalidArgument("source keys must be given, each once")
    for k in keys:
        if k not in names:
            raise InvalidSchema(f"key column not found: {k}")
        if not isinstance(df.schema[k].dataType, KEY_TYPES):
            raise InvalidSchema(f"unsupported source key type of {k}: {df.schema[k].dataType.simpleString()}")


def inspect(df: DataFrame, column: str, keys: Sequence[str], config: IVF) -> tuple[int, int]:
    """(rows, dimension) in one pass over keys and vectors; an error names the first rule that the values break."""
    v = F.col(f"`{column}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > F.lit(3.4028235677973366e38)))
    zero = ~F.exists(v, lambda x: x.cast("float") != 0)
    seen = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("null_vectors"), F.count_if(bad).alias("bad"), F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count_if(zero).alias("zero"),
        *[F.count_if(F.col(f"`{k}`").isNull()).alias(f"k{i}") for i, k in enumerate(keys)]).first()
    if not seen["n"]:
        raise InvalidSchema("the source must hold at least one row")
    for i, k in enumerate(keys):
        if seen[f"k{i}"]:
            raise Backend(f"source key {k} must not contain nulls")
    if seen["null_vectors"]:
        raise InvalidSchema(f"vector column {column} must not contain nulls")
    if seen["bad"]:
        raise InvalidSchema(f"vector column {column} must hold finite, non-null elements")
    if seen["low"] != seen["high"] or seen["low"] < 1:
        raise InvalidSchema("all vectors must have the same positive dimension")
    if config.metric == "cosine" and seen["zero"]:
        raise InvalidSchema("cosine needs vectors of a norm above zero")
    if config.nlist > seen["n"]:
        raise InvalidArgument(f"nlist must not exceed ntotal: {config.nlist} > {seen['n']}")
    return seen["n"], seen["low"]


def matrix(column: pa.Array, dim: int, metric: str) -> np.ndarray:
    """Canonical float32 vectors; for cosine of unit length, by a norm in double precision."""
    ends = column.offsets.to_numpy()
    x = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float32).reshape(-1, dim)
    if metric == "cosine":
        inverse = 1 / np.sqrt((x.astype(np.float64) ** 2).sum(1))
        x = (x * inverse[:, None]).astype(np.float32)
    return x


def sampled(df: DataFrame, column: str, keys: Sequence[str], rows: int, want: int, seed: int) -> DataFrame:
    """Rows (v, h): about ``want`` of ``rows`` rows, a little more rather than less, chosen by a hash of key and vector."""
    h = F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.col(f"`{column}`"), F.lit(seed))
    picked = df.select(F.col(f"`{column}`").alias("v"), h.alias("h"))
    if want >= rows:
        return picked
    return picked.where(F.pmod("h", F.lit(1 << 40)) < F.lit(min(1 << 40, int((1 << 40) * (want / rows) * 1.1) + (1 << 34))))


def _collected(df: DataFrame, dim: int, metric: str, most: int) -> np.ndarray:
    t = df.toArrow().combine_chunks().sort_by("h")
    return matrix(t["v"].combine_chunks(), dim, metric)[:most]


def train_index(df: DataFrame, column: str, keys: Sequence[str], dim: int, rows: int, config: IVF) -> Hierarchy:
    """Centroids from ``nlist * training_rows`` sampled rows, at most ``most_training_rows`` but never fewer than nlist.

    A small sample is trained on the driver. Beyond ``LOCAL`` values the driver trains only the roots, from 512 rows each, and each root's
    leaves are trained by a task of their own from the sampled rows that it owns; centroids alone come back.
    """
    want = min(rows, max(config.nlist, min(config.nlist * config.training_rows, config.most_training_rows)))
    if want * dim <= LOCAL:
        x = _collected(sampled(df, column, keys, rows, want, config.seed), dim, config.metric, max(want, config.nlist))
        if len(x) < config.nlist:
            every = sampled(df, column, keys, rows, rows, config.seed).orderBy("h").limit(max(want, config.nlist))
            x = _collected(every, dim, config.metric, max(want, config.nlist))
        return train(x, config.nlist, config.iterations, config.seed)
    ship(df.sparkSession)
    count = max(1, round(config.nlist**0.5))
    few = _collected(sampled(df, column, keys, rows, min(want, 512 * count), config.seed), dim, config.metric, 512 * count)
    roots = kmeans(few, min(count, len(few)), config.iterations, np.random.default_rng(config.seed))
    shared = df.sparkSession.sparkContext.broadcast(roots)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), dim, config.metric)
            label, _ = closest(x, shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(dim)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), b.column(1), flat], names=["root", "h", "v"])

    owned = cut_lineage(sampled(df, column, keys, rows, want, config.seed).mapInArrow(own, "root int, h bigint, v array<float>"))
    sizes = {r["root"]: r["count"] for r in owned.groupBy("root").count().collect()}  # a row a root
    kept = sorted(sizes)
    if sum(sizes.values()) < config.nlist:
        raise Backend("the training sample is smaller than nlist")
    share = budgets(np.array([sizes[r] for r in kept]), config.nlist)
    leaves_of = dict(zip(kept, share.tolist()))

    def leaves(t: pa.Table) -> pa.Table:
        r = t["root"][0].as_py()
        t = t.sort_by("h").combine_chunks()
        got = kmeans(matrix(t["v"].combine_chunks(), dim, "l2_squared"), leaves_of[r], config.iterations, np.random.default_rng([config.seed, r + 1]))
        return pa.table({"root": pa.array([r] * len(got), pa.int32()), "place": pa.array(range(len(got)), pa.int32()), "leaf": pa.array(got.tolist(), pa.list_(pa.float32()))})

    out = owned.groupBy("root").applyInArrow(leaves, "root int, place int, leaf array<float>").toArrow().combine_chunks().sort_by([("root", "ascending"), ("place", "ascending")])
    return Hierarchy(matrix(out["leaf"].combine_chunks(), dim, "l2_squared"), roots[kept], np.concatenate([[0], np.cumsum(share)]))


def centroid_table(h: Hierarchy) -> pa.Table:
    offset, scale, codes = lvq.encode(h.leaves, 8)
    bucket = np.repeat(np.arange(len(h.roots)), np.diff(h.offsets))
    schema = pa.schema([pa.field("cid", pa.int32(), False), pa.field("cid_bucket", pa.int32(), False), pa.field("offset", pa.float32(), False), pa.field("scale", pa.float32(), False), pa.field("code", pa.binary(), False)])
    return pa.table([pa.array(np.arange(len(bucket), dtype=np.int32)), pa.array(bucket.astype(np.int32)), pa.array(offset), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())], schema=schema)


def root_table(h: Hierarchy) -> pa.Table:
    schema = pa.schema([pa.field("cid_bucket", pa.int32(), False), pa.field("cid_begin", pa.int32(), False), pa.field("cid_end", pa.int32(), False), pa.field("centroid", pa.list_(pa.field("element", pa.float32(), False)), False)])
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(h.roots) + 1, dtype=np.int32) * h.roots.shape[1]), pa.array(h.roots.ravel()), type=schema.field("centroid").type)
    return pa.table([pa.array(np.arange(len(h.roots), dtype=np.int32)), pa.array(h.offsets[:-1].astype(np.int32)), pa.array(h.offsets[1:].astype(np.int32)), flat], schema=schema)


def decoded_centroids(t: pa.Table, dim: int) -> np.ndarray:
    codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(-1, dim)
    return lvq.decode(t["offset"].to_numpy(), t["scale"].to_numpy(), codes, dim, 8).astype(np.float32)


def write_table(warehouse: Warehouse, location: str, t: pa.Table, options: WriteOptions) -> tuple[int, str]:
    return warehouse.put(location, lambda f: pq.write_table(t, f, compression=options.compression, use_dictionary=False))


def read_table(warehouse: Warehouse, location: str) -> pa.Table:
    return pq.read_table(pa.BufferReader(warehouse.read_bytes(location)))


def ranges(counts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of each cluster on a line of ``parts`` equal partitions, by its share of the rows; no cluster is without a place."""
    size = counts + 0.5
    length = size * (parts / size.sum())
    return np.cumsum(length) - length, length


def sampled_sizes(df: DataFrame, column: str, keys: Sequence[str], dim: int, config: IVF, shared: Broadcast, rows: int) -> np.ndarray:
    """Rows of a bounded sample by cluster: 16 a cluster and at least 65,536; only these are assigned."""
    some = sampled(df, column, keys, rows, min(rows, max(65_536, 16 * config.nlist)), config.seed + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value[0]), np.int64)
        for b in batches:
            if b.num_rows:
                seen += np.bincount(closest(matrix(b.column(0), dim, config.metric), shared.value[0])[0], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["cid", "n"])

    got = some.mapInArrow(count, "cid int, n bigint").groupBy("cid").agg(F.sum("n").alias("n")).toArrow()  # a row a cluster at most
    out = np.zeros(config.nlist, np.int64)
    out[got["cid"].to_numpy()] = got["n"].to_numpy()
    return out


def write_postings(df: DataFrame, column: str, keys: Sequence[str], dim: int, config: IVF, leaves: np.ndarray, offsets: np.ndarray, warehouse: Warehouse, location: str, options: WriteOptions, ntotal: int) -> dict:
    """Assign, encode, shuffle once and write; the manifest comes last."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((leaves, offsets))  # bounded: nlist rows
    parts = options.partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, ntotal * (dim + 64) >> 28))
    plan = spark.sparkContext.broadcast(ranges(sampled_sizes(df, column, keys, dim, config, shared, ntotal), parts))
    names = [f"key_{i + 1}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{column}`").alias("v"), F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    types = [to_arrow_type(rows.schema[n].dataType) for n in names]
    bits = {"source": 0, "lvq4": 4, "lvq8": 8}[config.encoding]
    extra = ", offset float, scale float, code binary" if bits else ""
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centres, cuts), (begin, length) = shared.value, plan.value
        for b in batches:
            x = matrix(b.column(len(names)), dim, config.metric)
            cid, _ = closest(x, centres)
            within = (b.column(len(names) + 1).to_numpy().view(np.uint64) >> np.uint64(11)) * 2.0**-53  # a key's place in its cluster's range
            place = np.minimum((begin[cid] + within * length[cid]).astype(np.int32), parts - 1)
            cols = [pa.array(place.astype(np.int32)), pa.array((np.searchsorted(cuts, cid, "right") - 1).astype(np.int32)), pa.array(cid.astype(np.int32)), *b.columns[: len(names)]]
            if bits:
                low, scale, codes = lvq.encode(x, bits)
                w = codes.shape[1]
                code = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * np.int32(w)).tobytes()), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])
                cols += [pa.array(low), pa.array(scale), code]
            yield pa.RecordBatch.from_arrays(cols, names=["place", "bucket", "cid", *names, *(["offset", "scale", "code"] if bits else [])])

    assigned = rows.mapInArrow(assign, f"place int, bucket int, cid int, {kinds}{extra}")
    laid = assigned.repartitionById(parts, "place").drop("place").sortWithinPartitions("bucket", "cid", *names)
    schema = pa.schema([pa.field("cid", pa.int32(), False), *(pa.field(k, t, False) for k, t in zip(names, types)), *([pa.field("offset", pa.float32(), False), pa.field("scale", pa.float32(), False), pa.field("code", pa.binary(), False)] if bits else [])])
    group_rows = int(min(131_072, max(8192, -(-ntotal // config.nlist))))
    out = "path string, `cid-bucket` int, `min-cid` int, `max-cid` int, rows bigint, size bigint, sha256 string"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, part, held, weight, bucket = TaskContext.get().partitionId(), 0, [], 0, None
        done: list[tuple] = []

        def flush() -> None:
            nonlocal part, held, weight
            if not held:
                return
            t = pa.Table.from_batches(held).drop_columns(["bucket"]).cast(schema)
            cid = t["cid"].to_numpy()
            path = f"cid_bucket={bucket:06d}/part-{pid * 1000 + part:05d}.parquet"

            def write(f) -> None:
                with pq.ParquetWriter(f, schema, compression=options.compression, use_dictionary=False, write_statistics=True) as w:
                    cuts = [0, *(np.flatnonzero(np.diff(cid)) + 1).tolist(), len(cid)]
                    for a, z in zip(cuts, cuts[1:]):
                        for at in range(a, z, group_rows):
                            w.write_table(t.slice(at, min(group_rows, z - at)), row_group_size=group_rows)

            size, digest = warehouse.put(f"{location}/{path}", write)
            done.append((path, bucket, int(cid[0]), int(cid[-1]), len(cid), size, digest))
            part, held, weight = part + 1, [], 0

        for b in batches:
            buckets = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if z == a:
                    continue
                if buckets[a] != bucket or weight >= options.file_bytes:
                    flush()
                    bucket = int(buckets[a])
                piece = b.slice(a, z - a)
                held.append(piece)
                weight += piece.nbytes
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["path", "cid-bucket", "min-cid", "max-cid", "rows", "size", "sha256"])

    # One row a file of the index comes back, not one a vector.
    entries = sorted((r.asDict() for r in laid.mapInArrow(save, out).collect()), key=lambda e: (e["cid-bucket"], e["min-cid"], e["path"]))
    manifest = check_postings({"format-version": 1, "nlist": config.nlist, "ntotal": ntotal, "cid-offsets": offsets.tolist(), "files": entries})
    warehouse.create_json(f"{location}/manifest.json", manifest)
    return manifest


def build(df: DataFrame, column: str, keys: Sequence[str], config: IVF, options: WriteOptions, warehouse: Warehouse, index_uuid: str, centroids: Callable[[str, Callable[[], str]], str], progress: Callable[[str], None]) -> dict:
    """Build all relations and return the snapshot that describes them. ``centroids(fingerprint, make)`` shares trained artifacts."""
    progress("inspecting")
    check_source(df, column, keys)
    ntotal, dim = inspect(df, column, keys, config)
    mark = fingerprint(column, dim, config.metric, config.nlist)

    def make() -> str:
        progress("training")
        h = train_index(df, column, keys, dim, ntotal, config)
        artifact = str(uuid.uuid4())
        base = f"indexes/{artifact.replace('-', '')}/1"
        write_table(warehouse, f"{base}/ivf_centroids/part-00000.parquet", centroid_table(h), options)
        write_table(warehouse, f"{base}/ivf_roots/part-00000.parquet", root_table(h), options)
        descriptor = {"vector-field": column, "dimension": dim, "metric": config.metric, "nlist": config.nlist, "clustering-profile-version": 1}
        where = f"metadata/{artifact}/v1.metadata.json"
        warehouse.create_json(where, {"format-version": 1, "artifact-uuid": artifact, "fingerprint": mark, "created-at-ms": int(time.time() * 1000), "descriptor": descriptor, "centroids": f"{base}/ivf_centroids/", "roots": f"{base}/ivf_roots/"})
        return where

    where = centroids(mark, make)
    doc = warehouse.read_json(where)
    progress("assigning")
    leaves = decoded_centroids(read_table(warehouse, f"{doc['centroids']}part-00000.parquet"), dim)
    roots = read_table(warehouse, f"{doc['roots']}part-00000.parquet")
    offsets = np.r_[roots["cid_begin"].to_numpy(), roots["cid_end"].to_numpy()[-1:]].astype(np.int64)
    snapshot_id = int(time.time() * 1000) * 1000 + int(uuid.uuid4().int % 1000)
    base = f"indexes/{index_uuid.replace('-', '')}/{snapshot_id}"
    write_postings(df, column, keys, dim, config, leaves, offsets, warehouse, f"{base}/ivf_postings", options, ntotal)
    parameters = {"dimension": str(dim), "nlist": str(config.nlist), "ntotal": str(ntotal), "posting_encoding": config.encoding}
    if config.encoding == "source":
        parameters |= {"ivf_centroids_fingerprint": mark, "ivf_centroids_uuid": doc["artifact-uuid"], "ivf_centroids_metadata_location": where}
        relations = {"ivf_centroids": doc["centroids"], "ivf_postings": f"{base}/ivf_postings/"}
    else:
        parameters["artifact_uuid"] = str(uuid.uuid4())
        relations = {"artifact_manifest": f"{base}/manifest.json"}
        warehouse.create_json(f"{base}/manifest.json", {"format-version": 1, "artifact-uuid": parameters["artifact_uuid"], "index": parameters, "vector-field": column, "metric": config.metric, "source-key-fields": list(keys), "hierarchy": {"centroids": doc["centroids"], "roots": doc["roots"], "cid-offsets": offsets.tolist()}, "postings": f"{base}/ivf_postings/"})
    progress("publishing")
    return {"snapshot-id": snapshot_id, "summary": {"operation": "build"}, "vector-field": column, "source-key-fields": list(keys), "indexed-rows": ntotal, "index-family": "ivf", "index-schema-version": 1, "metric": config.metric, "parameters": parameters, "index-relations": relations}
