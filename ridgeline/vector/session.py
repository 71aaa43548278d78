"""Sessions over a warehouse: tables, the life cycle of their indexes, vector and SQL queries."""

from __future__ import annotations

import asyncio
import contextlib
import re
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from pathlib import Path
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.plans import statements
from ridgeline.vector import search
from ridgeline.vector.build import build, vector_columns
from ridgeline.vector.catalog import Catalog
from ridgeline.vector.config import IVF, SessionConfig, WriteOptions
from ridgeline.vector.errors import AlreadyExists, Busy, Conflict, EngineError, InvalidArgument, InvalidSchema, NotFound
from ridgeline.vector.formats import check_metadata, current, successor
from ridgeline.vector.leases import Leases
from ridgeline.vector.maintenance import Maintenance
from ridgeline.vector.query import VectorQuery
from ridgeline.vector.storage import Warehouse

_NAME = re.compile(r"[^\W\d]\w*(\.[^\W\d]\w*)*")
#: The share of a build's work that lies behind at the start of each phase, by experience.
PHASES = {"queued": 0.0, "inspecting": 0.02, "training": 0.1, "assigning": 0.4, "publishing": 0.97}
_NAMESPACE = uuid.UUID("6f3a1c1e-5d4b-4c39-9a59-0b7a3c7d9e21")


class _Admission:
    """At most so many queries at once, so many waiting, each for so long."""

    def __init__(self, config: SessionConfig):
        self.slots = threading.Semaphore(config.query_concurrency)
        self.waiting, self.capacity, self.timeout, self.lock = 0, config.query_queue_capacity, config.query_queue_timeout, threading.Lock()

    @contextlib.contextmanager
    def permit(self) -> Iterator[None]:
        if not self.slots.acquire(blocking=False):
            with self.lock:
                if self.waiting >= self.capacity:
                    raise Busy("the queue of queries is full")
                self.waiting += 1
            try:
                if not self.slots.acquire(timeout=self.timeout):
                    raise Busy("the query waited too long")
            finally:
                with self.lock:
                    self.waiting -= 1
        try:
            yield
        finally:
            self.slots.release()


class Results:
    """Arrow batches as they come. The first is there before this is, so that errors show early; ``close`` cancels the rest."""

    def __init__(self, schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
        self.schema, self._batches = schema, batches
        self._first = next(batches, None)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        first, self._first = self._first, None
        if first is not None:
            yield first.cast(self.schema) if first.schema != self.schema else first
        for b in self._batches:
            yield b.cast(self.schema) if b.schema != self.schema else b

    def close(self) -> None:
        self._batches.close()


class Session:
    def __init__(self, spark: SparkSession, root: str, config: SessionConfig = SessionConfig()):
        self.spark, self.config = spark, config
        search.CENTROIDS.limit(config.centroid_cache_bytes)
        search.MANIFESTS.limit(config.manifest_cache_bytes)
        if config.query_dop:
            spark.conf.set("spark.sql.shuffle.partitions", config.query_dop)
        if "://" not in root:
            Path(root).mkdir(parents=True, exist_ok=True)
        self.warehouse = Warehouse(root)
        if not self.warehouse.uri.startswith("file://"):
            raise InvalidArgument("the catalog needs a file path; tables and postings may lie elsewhere")
        self.root = Path(self.warehouse.uri.removeprefix("file://"))
        self.catalog = Catalog(self.root / "catalog.db")
        self.owner = str(uuid.uuid4())
        self.leases = Leases(self.root / "locks")
        self._lease = self.leases.session(self.owner)
        self._admission = _Admission(config)
        self._builds: dict[tuple[str, str], tuple[Future, dict]] = {}
        self._pool = ThreadPoolExecutor(1, thread_name_prefix="ridgeline-build")
        self._sources: dict[str, DataFrame] = {}
        self._lock = threading.Lock()
        for name in self.catalog.list_tables():
            self._bind(name)

    def _bind(self, name: str) -> DataFrame:
        uri, definition = self.catalog.load_table(name)
        df = self.spark.read.schema(definition["schema"]).parquet(uri) if definition.get("schema") else self.spark.read.parquet(uri)
        df.createOrReplaceTempView(name.replace(".", "_"))
        self._sources[name] = df
        return df

    def register_parquet(self, name: str, path: str) -> SourceTable:
        """Register a file, folder or ``*`` pattern; the schema of now is pinned."""
        if not _NAME.fullmatch(name):
            raise InvalidArgument(f"not a table name: {name}")
        path = path if "://" in path else Path(path).absolute().as_uri().replace("%2A", "*")
        schema = self.spark.read.parquet(path).schema
        if search.RESERVED in schema.names:
            raise InvalidSchema(f"the source has the reserved column {search.RESERVED}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.catalog.create_table(name, path, {"schema": ddl})
        self._bind(name)
        return SourceTable(self, name)

    def list_tables(self) -> list[str]:
        return self.catalog.list_tables()

    def table(self, name: str) -> SourceTable:
        self.catalog.load_table(name)
        return SourceTable(self, name)

    def deregister_table(self, name: str) -> None:
        if self.catalog.find_by_source(name):
            raise InvalidArgument(f"table has indexes: {name}")
        self.catalog.drop_table(name)
        self.spark.catalog.dropTempView(name.replace(".", "_"))
        self._sources.pop(name, None)

    def source(self, name: str) -> DataFrame:
        return self._sources[name] if name in self._sources else self._bind(name)

    def metadata(self, source: str, index: str) -> dict:
        return check_metadata(self.warehouse.read_json(self.catalog.load(source, index)))

    def _chosen(self, query: VectorQuery) -> tuple[str, dict]:
        """The named index, or the only one that fits."""
        entries = self.catalog.find_by_source(query.source)
        if query.index is not None:
            if query.index not in entries:
                raise NotFound(f"index not found: {query.index}")
            snapshot = current(self.metadata(query.source, query.index))
            if query.column not in (None, snapshot["vector-field"]):
                raise InvalidArgument(f"index {query.index} is not on column {query.column}")
            return query.index, snapshot
        found = [(n, s) for n in entries if query.column in (None, (s := current(self.metadata(query.source, n)))["vector-field"])]
        if len(found) != 1:
            raise InvalidArgument("several indexes fit, name one" if found else "no index fits; an exact search must be asked for")
        return found[0]

    def dataframe(self, query: VectorQuery | str) -> DataFrame:
        """The plan of a query, to compose with any other DataFrame."""
        if isinstance(query, str):
            self._read_only(query)
            return self.spark.sql(query)
        source = self.source(query.source)
        if query.part("exact"):
            return search.exact(source, query)
        _, snapshot = self._chosen(query)
        return search.indexed(source, query, self.warehouse, snapshot, self.config.inline_clusters)

    def _read_only(self, sql: str) -> None:
        """Only statements that read registered relations: no command or write anywhere in it, no path as a table, no reflection."""
        if not sql.strip():
            raise InvalidArgument("the statement is empty")
        try:
            held = statements.kinds(self.spark, sql)
        except Py4JJavaError as e:
            raise InvalidArgument(f"the statement cannot be parsed: {str(e)[:300]}") from e
        except ParseException as e:
            raise InvalidArgument(f"the statement cannot be parsed: {str(e)[:300]}") from e
        if held:
            raise InvalidArgument(f"only reading statements are allowed, not {next(iter(held.values()))}")
        if (what := statements.outside(self.spark, sql)) is not None:
            raise InvalidArgument(f"only registered relations and plain functions are allowed, not {what}")

    def collect(self, query: VectorQuery | str) -> pa.Table:
        with self._admission.permit():
            return self.dataframe(query).toArrow()

    def stream(self, query: VectorQuery | str) -> Iterator[pa.RecordBatch]:
        """Arrow batches; closing the iterator early cancels the rest and frees the permit."""
        with self._admission.permit():
            group = f"ridgeline-{uuid.uuid4()}"
            self.spark.sparkContext.setJobGroup(group, "ridgeline stream", True)
            try:
                yield from search.batches(self.dataframe(query))
            finally:
                self.spark.sparkContext.cancelJobGroup(group)

    def results(self, query: VectorQuery | str) -> Results:
        """Like ``stream``, with the schema at hand."""
        return Results(to_arrow_schema(self.dataframe(query).schema), self.stream(query))

    def batch(self, queries: Sequence[VectorQuery]) -> DataFrame:
        """Rows (query_no, .., _distance) of several queries in one plan; they must have the same columns."""
        if not queries:
            raise InvalidArgument("a batch has at least one query")
        return reduce(DataFrame.unionByName, [self.dataframe(q).withColumn("query_no", F.lit(i)) for i, q in enumerate(queries)])

    def recall(self, query: VectorQuery, key: str) -> float:
        """The share of the exact nearest rows that a query through an index finds."""
        exact = VectorQuery(query.source, query.vector, query.column or self._chosen(query)[1]["vector-field"], parts={"limit": query.part("limit"), "exact": True} | ({"where": query.part("where")} if query.part("where") else {}))
        one = [self.dataframe(q.select([key])).withColumn("q", F.lit(0)) for q in (exact, query)]
        got = search.recall(one[0], one[1], "q", key).first()
        return 1.0 if got is None else float(got["recall"])

    def sql(self, statement: str) -> pa.Table:
        return self.collect(statement)

    def to_sql(self, query: VectorQuery) -> str:
        """A statement that gives the query's rows. Its relation has the same name each time and stays registered in this session."""
        df = self.dataframe(query)
        name = "ridgeline_" + uuid.uuid5(_NAMESPACE, repr(query) + repr(self.catalog.find_by_source(query.source))).hex
        df.createOrReplaceTempView(name)
        return f"SELECT {', '.join(f'`{c}`' for c in df.columns)} FROM `{name}` ORDER BY `{search.RESERVED}`"

    def explain(self, query: VectorQuery | str, mode: str = "formatted") -> str:
        df = self.dataframe(query)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def analyze(self, query: VectorQuery | str) -> dict[str, Any]:
        """Run it; (rows, seconds, plan with the final adaptive steps)."""
        df, began = self.dataframe(query), time.time()
        seen = Observation()
        with self._admission.permit():
            watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            watched.write.format("noop").mode("overwrite").save()
        rows = seen.get["rows"]
        return {"rows": rows, "seconds": time.time() - began, "plan": df._jdf.queryExecution().executedPlan().toString()}

    def maintenance(self) -> Maintenance:
        return Maintenance(self.warehouse, self.catalog, self.leases, self.owner)

    def clear_caches(self) -> None:
        search.clear_caches()

    def cache_stats(self) -> dict[str, dict[str, int]]:
        return {"centroids": search.CENTROIDS.stats(), "manifests": search.MANIFESTS.stats()}

    def close(self) -> None:
        self._pool.shutdown(wait=True)
        self._lease.release()
        self.catalog.close()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class SourceTable:
    def __init__(self, session: Session, name: str):
        self.session, self.name = session, name

    @property
    def df(self) -> DataFrame:
        return self.session.source(self.name)

    def search(self, query: Sequence[float], *, column: str | None = None, index: str | None = None) -> VectorQuery:
        return VectorQuery(self.name, tuple(float(x) for x in query), column, index)

    def _submit(self, name: str, job: Any) -> None:
        s = self.session
        with s._lock:
            if any(not f.done() for f, _ in s._builds.values()):
                raise Busy("another build is running")
            state = {"phase": "queued", "fraction": 0.0, "error": None}
            s._builds[self.name, name] = (s._pool.submit(job, state), state)

    def _run(self, name: str, column: str, keys: Sequence[str], config: IVF, options: WriteOptions, base: str | None) -> Any:
        s = self.session

        def centroids(mark: str, make: Any) -> str:
            got, until = None, time.time() + s.config.centroid_wait
            while True:
                try:
                    got = s.catalog.claim_centroids(self.name, mark, s.owner)
                    break
                except Conflict:  # another build trains the same: its result serves this one too, and a lease that runs out is free again
                    if time.time() >= until:
                        raise
                    time.sleep(0.25)
            while got is None:
                stop = threading.Event()

                def renew() -> None:
                    while not stop.wait(10):
                        s.catalog.renew_centroids(self.name, mark, s.owner)

                thread = threading.Thread(target=renew, daemon=True)
                thread.start()
                try:
                    got = make()
                    s.catalog.publish_centroids(self.name, mark, s.owner, got)
                except BaseException:
                    s.catalog.abandon_centroids(self.name, mark, s.owner)
                    raise
                finally:
                    stop.set()
            return got

        def job(state: dict) -> None:
            try:
                old = check_metadata(s.warehouse.read_json(base)) if base else None
                index_uuid = old["index-uuid"] if old else str(uuid.uuid4())
                write = options if options.partitions or not s.config.build_dop else replace(options, partitions=s.config.build_dop)
                with s.leases.build(index_uuid):
                    snapshot = build(self.df, column, keys, config, write, s.warehouse, index_uuid, centroids, lambda p: state.update(phase=p, fraction=PHASES[p]))
                doc = successor(old, snapshot, index_uuid, int(time.time() * 1000))
                where = f"metadata/{index_uuid}/v{doc['last-sequence-number']}-{uuid.uuid4().hex}.metadata.json"
                s.warehouse.create_json(where, doc)
                s.catalog.commit(self.name, name, base, where) if base else s.catalog.register(self.name, name, where)
                state.update(phase="ready", fraction=1.0)
            except BaseException as e:
                state.update(phase="failed", error=e)
                raise

        return job

    def create_index(self, name: str, column: str, key: str | Sequence[str], config: IVF, options: WriteOptions = WriteOptions(), wait: bool = True) -> None:
        keys = [key] if isinstance(key, str) else list(key)
        if name in self.session.catalog.find_by_source(self.name):
            raise AlreadyExists(f"index exists: {name}")
        self._submit(name, self._run(name, column, keys, config, options, None))
        if wait:
            self.wait_for_index(name)

    def refresh_index(self, name: str, config: IVF | None = None, options: WriteOptions = WriteOptions(), wait: bool = True) -> None:
        """A new snapshot over the source as it is now. The metric cannot change; nlist and encoding can."""
        base = self.session.catalog.load(self.name, name)
        snap = current(check_metadata(self.session.warehouse.read_json(base)))
        config = config or IVF(int(snap["parameters"]["nlist"]), snap["parameters"]["posting_encoding"], snap["metric"])
        if config.metric != snap["metric"]:
            raise InvalidArgument("the metric of an index cannot change")
        self._submit(name, self._run(name, snap["vector-field"], snap["source-key-fields"], config, options, base))
        if wait:
            self.wait_for_index(name)

    def register_index(self, name: str, metadata_location: str) -> None:
        """Attach metadata that is already in the warehouse, after checks against this table."""
        snap = current(check_metadata(self.session.warehouse.read_json(metadata_location)))
        if snap["vector-field"] not in vector_columns(self.df) or any(k not in self.df.columns for k in snap["source-key-fields"]):
            raise InvalidSchema("the table lacks a field of the index")
        if self.df.count() != snap["indexed-rows"]:
            raise InvalidSchema("the table has another number of rows than the index")
        _, where = search.relations(self.session.warehouse, snap)
        search._manifest(self.session.warehouse.uri, where)
        self.session.catalog.register(self.name, name, metadata_location)

    def index_status(self, name: str) -> dict[str, Any]:
        """``phase`` of a build, or ``ready``; the error of a failed build stays until the next."""
        ran = self.session._builds.get((self.name, name))
        published = name in self.session.catalog.find_by_source(self.name)
        if ran is None and not published:
            raise NotFound(f"index not found: {name}")
        state = dict(ran[1]) if ran else {"phase": "ready", "fraction": 1.0, "error": None}
        return state | {"published": published}

    def wait_for_index(self, name: str, timeout: float | None = None) -> dict[str, Any]:
        """A waiter that gives up doesn't stop the build."""
        ran = self.session._builds.get((self.name, name))
        if ran is not None:
            try:
                ran[0].result(timeout)
            except EngineError:
                raise
        return self.index_status(name)

    def list_indexes(self) -> list[dict[str, Any]]:
        out = []
        for name in self.session.catalog.find_by_source(self.name):
            s = current(self.session.metadata(self.name, name))
            out.append({"name": name, "column": s["vector-field"], "keys": s["source-key-fields"], "metric": s["metric"], "encoding": s["parameters"]["posting_encoding"], "nlist": int(s["parameters"]["nlist"]), "rows": s["indexed-rows"], "snapshot": s["snapshot-id"]})
        return out

    def drop_index(self, name: str) -> None:
        self.session.catalog.drop(self.name, name)
        self.session._builds.pop((self.name, name), None)


def connect(spark: SparkSession, root: str, config: SessionConfig = SessionConfig()) -> Session:
    return Session(spark, root, config)


class AsyncResults:
    """Batches of a stream, awaited one by one; leaving it early cancels the rest."""

    def __init__(self, session: Session, query: VectorQuery | str):
        self._batches = session.stream(query)

    def __aiter__(self) -> AsyncResults:
        return self

    async def __anext__(self) -> pa.RecordBatch:
        got = await asyncio.to_thread(next, self._batches, None)
        if got is None:
            raise StopAsyncIteration
        return got

    async def aclose(self) -> None:
        await asyncio.to_thread(self._batches.close)

    async def __aenter__(self) -> AsyncResults:
        return self

    async def __aexit__(self, *_: object) -> None:
        await self.aclose()


class AsyncSession:
    """The same methods, awaited; each runs in a thread. ``stream`` gives batches with ``async for``."""

    def __init__(self, session: Session):
        self.session = session

    def stream(self, query: VectorQuery | str) -> AsyncResults:
        return AsyncResults(self.session, query)

    def __getattr__(self, name: str) -> Any:
        target = getattr(self.session, name)
        if not callable(target):
            return target

        async def call(*args: Any, **named: Any) -> Any:
            out = await asyncio.to_thread(target, *args, **named)
            return AsyncSession(out) if isinstance(out, SourceTable) else out  # type: ignore[arg-type]

        return call


async def connect_async(spark: SparkSession, root: str, config: SessionConfig = SessionConfig()) -> AsyncSession:
    return AsyncSession(await asyncio.to_thread(connect, spark, root, config))
