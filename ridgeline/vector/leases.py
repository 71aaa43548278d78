"""Leases of sessions and builds as locked files beside the catalog: what holds one may still read or write objects."""

from __future__ import annotations

import contextlib
import fcntl
import os
from collections.abc import Iterator
from pathlib import Path


class Lease:
    def __init__(self, path: Path):
        self.path = path
        self.handle: int | None = os.open(path, os.O_CREAT | os.O_RDWR)
        fcntl.flock(self.handle, fcntl.LOCK_EX)

    def release(self) -> None:
        if self.handle is not None:
            self.path.unlink(missing_ok=True)
            os.close(self.handle)  # which gives the lock up, as the end of the process does
            self.handle = None


class Leases:
    """One file a holder, locked while it lives. A process that dies leaves a file without a lock, which counts for nothing and is removed."""

    def __init__(self, folder: Path):
        self.folder = folder
        folder.mkdir(parents=True, exist_ok=True)

    def session(self, owner: str) -> Lease:
        return Lease(self.folder / f"{owner}.session")

    @contextlib.contextmanager
    def build(self, index_uuid: str) -> Iterator[None]:
        """Objects of the index are kept while it is built."""
        held = Lease(self.folder / f"{index_uuid}.build")
        try:
            yield
        finally:
            held.release()

    def alive(self, kind: str) -> list[str]:
        """Names of the holders of ``session`` or ``build`` leases."""
        out = []
        for path in sorted(self.folder.glob(f"*.{kind}")):
            try:
                handle = os.open(path, os.O_RDWR)
            except FileNotFoundError:
                continue
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
                path.unlink(missing_ok=True)  # its holder is dead
            except BlockingIOError:
                out.append(path.stem)
            finally:
                os.close(handle)
        return out
