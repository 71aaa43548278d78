"""Settings of indexes, writers and sessions."""

from __future__ import annotations

from dataclasses import dataclass

from ridgeline.vector.errors import InvalidArgument

ENCODINGS = ("source", "lvq4", "lvq8")
METRICS = ("l2_squared", "cosine")


@dataclass(frozen=True)
class IVF:
    """An inverted file of ``nlist`` clusters. ``training_rows``: rows a cluster of the sample that trains it, ``most_training_rows`` in all."""

    nlist: int
    encoding: str = "source"
    metric: str = "l2_squared"
    training_rows: int = 256
    most_training_rows: int = 1 << 24
    iterations: int = 20
    seed: int = 42

    def __post_init__(self) -> None:
        if isinstance(self.nlist, bool) or not isinstance(self.nlist, int) or not 1 <= self.nlist < 1 << 31:
            raise InvalidArgument("nlist must be an integer from 1 to 2147483647")
        if self.encoding not in ENCODINGS:
            raise InvalidArgument(f"encoding must be one of {ENCODINGS}")
        if self.metric not in METRICS:
            raise InvalidArgument(f"metric must be one of {METRICS}")


@dataclass(frozen=True)
class WriteOptions:
    """``file_bytes``: size at which a postings file ends; ``compression``: of the Parquet files; ``partitions``: write tasks, 0 for the session's."""

    file_bytes: int = 256 << 20
    compression: str = "zstd"
    partitions: int = 0

    def __post_init__(self) -> None:
        if self.file_bytes < 1 or self.partitions < 0:
            raise InvalidArgument("file_bytes must be positive and partitions not negative")
        if self.compression not in ("zstd", "snappy", "gzip", "lz4", "none"):
            raise InvalidArgument(f"compression not supported: {self.compression}")


@dataclass(frozen=True)
class SessionConfig:
    """``query_*``: queries at once, waiting, and how long (seconds); ``inline_clusters``: up to so many clusters go into the scan as a list; ``centroid_wait``: seconds that a build waits for another one's centroids;
    ``query_dop``, ``build_dop``: partitions of shuffles of queries and builds, 0 for the session's; ``*_cache_bytes``: bounds of the caches, which all sessions of a process share."""

    query_concurrency: int = 1
    query_queue_capacity: int = 64
    query_queue_timeout: float = 60.0
    inline_clusters: int = 128
    centroid_wait: float = 3600.0
    query_dop: int = 0
    build_dop: int = 0
    centroid_cache_bytes: int = 256 << 20
    manifest_cache_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        if self.query_concurrency < 1 or self.query_queue_capacity < 0 or self.query_queue_timeout < 0:
            raise InvalidArgument("concurrency must be positive, capacity and timeout not negative")
        if min(self.query_dop, self.build_dop, self.centroid_cache_bytes, self.manifest_cache_bytes) < 0:
            raise InvalidArgument("degrees of parallelism and cache sizes must not be negative")
