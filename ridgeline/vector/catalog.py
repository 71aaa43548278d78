"""The catalog: tables, indexes, centroid artifacts and tombstones, atomic per identifier, in SQLite."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from pathlib import Path

from ridgeline.vector.errors import AlreadyExists, Conflict, NotFound

_SCHEMA = """
CREATE TABLE IF NOT EXISTS tables (name TEXT PRIMARY KEY, uri TEXT NOT NULL, definition TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS indexes (source TEXT NOT NULL, name TEXT NOT NULL, metadata_location TEXT NOT NULL, PRIMARY KEY (source, name));
CREATE TABLE IF NOT EXISTS tombstones (metadata_location TEXT PRIMARY KEY, unreachable_since_ms INTEGER NOT NULL);
CREATE TABLE IF NOT EXISTS centroids (source TEXT NOT NULL, fingerprint TEXT NOT NULL, owner TEXT, lease_until REAL, metadata_location TEXT, PRIMARY KEY (source, fingerprint));
"""


class Catalog:
    def __init__(self, path: str | Path):
        self.lock = threading.RLock()
        self.db = sqlite3.connect(str(path), check_same_thread=False, timeout=30, isolation_level=None)
        self.db.executescript(_SCHEMA)

    def close(self) -> None:
        self.db.close()

    def _write(self, *steps: tuple[str, tuple]) -> list[int]:
        with self.lock:
            self.db.execute("BEGIN IMMEDIATE")
            try:
                out = [self.db.execute(sql, args).rowcount for sql, args in steps]
                self.db.execute("COMMIT")
                return out
            except BaseException:
                self.db.execute("ROLLBACK")
                raise

    def _read(self, sql: str, *args) -> list[tuple]:
        with self.lock:
            return self.db.execute(sql, args).fetchall()

    def create_table(self, name: str, uri: str, definition: dict) -> None:
        """A name is never silently bound to another table."""
        try:
            self._write(("INSERT INTO tables VALUES (?, ?, ?)", (name, uri, json.dumps(definition, sort_keys=True))))
        except sqlite3.IntegrityError:
            if self.load_table(name) != (uri, definition):
                raise AlreadyExists(f"table exists with another definition: {name}") from None

    def load_table(self, name: str) -> tuple[str, dict]:
        if not (got := self._read("SELECT uri, definition FROM tables WHERE name = ?", name)):
            raise NotFound(f"table not found: {name}")
        return got[0][0], json.loads(got[0][1])

    def list_tables(self) -> list[str]:
        return [r[0] for r in self._read("SELECT name FROM tables ORDER BY name")]

    def drop_table(self, name: str) -> None:
        if not self._write(("DELETE FROM tables WHERE name = ?", (name,)))[0]:
            raise NotFound(f"table not found: {name}")

    def load(self, source: str, name: str) -> str:
        if not (got := self._read("SELECT metadata_location FROM indexes WHERE source = ? AND name = ?", source, name)):
            raise NotFound(f"index not found: {name}")
        return got[0][0]

    def register(self, source: str, name: str, location: str) -> None:
        try:
            self._write(("INSERT INTO indexes VALUES (?, ?, ?)", (source, name, location)))
        except sqlite3.IntegrityError:
            raise AlreadyExists(f"index exists: {name}") from None

    def commit(self, source: str, name: str, base: str, new: str) -> None:
        """Compare and swap; the base becomes a tombstone."""
        with self.lock:
            self.load(source, name)
            self.db.execute("BEGIN IMMEDIATE")
            done = self.db.execute("UPDATE indexes SET metadata_location = ? WHERE source = ? AND name = ? AND metadata_location = ?", (new, source, name, base)).rowcount
            if not done:
                self.db.execute("ROLLBACK")
                raise Conflict(f"index has changed: {name}")
            self.db.execute("INSERT OR IGNORE INTO tombstones VALUES (?, ?)", (base, int(time.time() * 1000)))
            self.db.execute("COMMIT")

    def drop(self, source: str, name: str) -> None:
        location = self.load(source, name)
        self._write(("INSERT OR IGNORE INTO tombstones VALUES (?, ?)", (location, int(time.time() * 1000))), ("DELETE FROM indexes WHERE source = ? AND name = ?", (source, name)))

    def find_by_source(self, source: str) -> dict[str, str]:
        return dict(self._read("SELECT name, metadata_location FROM indexes WHERE source = ? ORDER BY name", source))

    def list(self) -> list[tuple[str, str, str]]:
        return self._read("SELECT source, name, metadata_location FROM indexes ORDER BY source, name")

    def tombstones(self) -> dict[str, int]:
        return dict(self._read("SELECT metadata_location, unreachable_since_ms FROM tombstones"))

    def purge(self, location: str) -> None:
        self._write(("DELETE FROM tombstones WHERE metadata_location = ?", (location,)))

    def claim_centroids(self, source: str, fingerprint: str, owner: str, lease: float = 30.0) -> str | None:
        """The location of a published artifact, or None where ``owner`` now holds the lease; Conflict where another does."""
        now = time.time()
        with self.lock:
            self.db.execute("BEGIN IMMEDIATE")
            row = self.db.execute("SELECT owner, lease_until, metadata_location FROM centroids WHERE source = ? AND fingerprint = ?", (source, fingerprint)).fetchone()
            free = row is None or row[2] is None and (row[0] == owner or row[1] < now)
            if free:
                self.db.execute("INSERT OR REPLACE INTO centroids VALUES (?, ?, ?, ?, NULL)", (source, fingerprint, owner, now + lease))
            self.db.execute("COMMIT")
        if row is not None and row[2] is not None:
            return row[2]
        if not free:
            raise Conflict("the centroids are being trained by another build")
        return None

    def renew_centroids(self, source: str, fingerprint: str, owner: str, lease: float = 30.0) -> bool:
        return self._write(("UPDATE centroids SET lease_until = ? WHERE source = ? AND fingerprint = ? AND owner = ? AND metadata_location IS NULL", (time.time() + lease, source, fingerprint, owner)))[0] == 1

    def publish_centroids(self, source: str, fingerprint: str, owner: str, location: str) -> None:
        if not self._write(("UPDATE centroids SET metadata_location = ? WHERE source = ? AND fingerprint = ? AND owner = ? AND metadata_location IS NULL", (location, source, fingerprint, owner)))[0]:
            raise Conflict("the lease on the centroids was lost")

    def abandon_centroids(self, source: str, fingerprint: str, owner: str) -> None:
        self._write(("DELETE FROM centroids WHERE source = ? AND fingerprint = ? AND owner = ? AND metadata_location IS NULL", (source, fingerprint, owner)))

    def centroid_locations(self) -> list[str]:
        return [r[0] for r in self._read("SELECT metadata_location FROM centroids WHERE metadata_location IS NOT NULL")]

    def purge_centroids(self, location: str) -> None:
        self._write(("DELETE FROM centroids WHERE metadata_location = ?", (location,)))
