"""Vector search over Parquet tables: exact and inverted-file indexes, their life cycle and publication."""

from ridgeline.vector.config import IVF, SessionConfig, WriteOptions
from ridgeline.vector.query import VectorQuery
from ridgeline.vector.session import Session, SourceTable, connect, connect_async

__all__ = ["IVF", "Session", "SessionConfig", "SourceTable", "VectorQuery", "WriteOptions", "connect", "connect_async"]
