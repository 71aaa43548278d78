"""A warehouse folder on any file system that pyarrow knows (file, s3, hdfs) and that all executors share."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

import pyarrow.fs as pafs

from ridgeline.vector.errors import AlreadyExists, InvalidArgument, NotFound
from ridgeline.vector.formats import load, relative


class Warehouse:
    """Locations are relative to the root and cannot leave it. Instances travel to the executors."""

    def __init__(self, root: str):
        self.uri = root.rstrip("/") if "://" in root else Path(root).resolve().as_uri()

    def _at(self, location: str) -> tuple[pafs.FileSystem, str]:
        if location and not relative(location):
            raise InvalidArgument(f"location leaves the warehouse: {location}")
        fs, base = pafs.FileSystem.from_uri(self.uri)
        return fs, f"{base}/{location.rstrip('/')}" if location else base

    def spark_path(self, location: str) -> str:
        return f"{self.uri}/{location.rstrip('/')}"

    def read_bytes(self, location: str) -> bytes:
        fs, path = self._at(location)
        try:
            with fs.open_input_stream(path) as f:
                return f.read()
        except FileNotFoundError:
            raise NotFound(f"object not found: {location}") from None

    def read_json(self, location: str) -> dict:
        return load(self.read_bytes(location).decode())

    def create(self, location: str, data: bytes) -> None:
        """Create if absent."""
        fs, path = self._at(location)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        if isinstance(fs, pafs.LocalFileSystem):
            try:
                handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                raise AlreadyExists(f"object exists: {location}") from None
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            return
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            raise AlreadyExists(f"object exists: {location}")
        with fs.open_output_stream(path) as f:
            f.write(data)

    def create_json(self, location: str, doc: dict) -> None:
        self.create(location, json.dumps(doc, ensure_ascii=False, indent=1).encode())

    def put(self, location: str, write) -> tuple[int, str]:
        """A data object by ``write(stream)``: written aside, then moved, so a repeated task leaves one whole object. (size, sha256)."""
        fs, path = self._at(location)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        aside = f"{path}.{os.getpid()}.tmp"
        with fs.open_output_stream(aside) as f:
            write(f)
        digest, size = hashlib.sha256(), 0
        with fs.open_input_stream(aside) as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
                size += len(chunk)
        fs.move(aside, path)
        return size, digest.hexdigest()

    def files(self, location: str = "") -> list[tuple[str, int, float]]:
        """(location, size, time of change) of all objects below."""
        fs, path = self._at(location)
        _, base = self._at("")
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
        return [(i.path[len(base) + 1 :], i.size, i.mtime.timestamp() if i.mtime else 0) for i in found if i.type == pafs.FileType.File]

    def delete(self, location: str) -> None:
        fs, path = self._at(location)
        fs.delete_file(path)
