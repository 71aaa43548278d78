"""Remove what no index reaches any more, and publish an index elsewhere."""

from __future__ import annotations

import hashlib
import time
from datetime import timedelta
from urllib.parse import quote
from urllib.request import urlopen

from ridgeline.vector.catalog import Catalog
from ridgeline.vector.errors import AlreadyExists, Busy, Corrupt, InvalidArgument
from ridgeline.vector.formats import check_metadata, check_postings, current
from ridgeline.vector.leases import Leases
from ridgeline.vector.storage import Warehouse

LEAST_AGE = timedelta(days=7)


class Maintenance:
    def __init__(self, warehouse: Warehouse, catalog: Catalog, leases: Leases | None = None, owner: str | None = None):
        self.warehouse, self.catalog, self.leases, self.owner = warehouse, catalog, leases, owner

    def reachable(self) -> set[str]:
        """Prefixes and objects that a catalog entry leads to."""
        keep: set[str] = set()
        roots = [location for _, _, location in self.catalog.list()]
        used_centroids: set[str] = set(self.catalog.centroid_locations())
        for location in roots:
            keep.add(location)
            for s in check_metadata(self.warehouse.read_json(location))["snapshots"]:
                for where in s["index-relations"].values():
                    keep.add(where)
                    if where.endswith(".json"):
                        doc = self.warehouse.read_json(where)
                        keep |= {doc["postings"], doc["hierarchy"]["centroids"], doc["hierarchy"]["roots"]}
                if named := s["parameters"].get("ivf_centroids_metadata_location"):
                    used_centroids.add(named)
        for location in used_centroids:
            doc = self.warehouse.read_json(location)
            keep |= {location, doc["centroids"], doc["roots"]}
        return keep

    def remove_orphans(self, older_than: timedelta = LEAST_AGE, dry_run: bool = True) -> list[str]:
        """Objects below ``indexes/`` and ``metadata/`` that nothing reaches and that are older; deleted unless ``dry_run``. Reachability is read again before a deletion.

        While another session is open, whose plans may read a replaced snapshot, nothing is deleted (Busy). Objects of indexes that are being built are kept.
        """
        if older_than < LEAST_AGE:
            raise InvalidArgument("objects are kept for at least 7 days")
        limit = time.time() - older_than.total_seconds()

        def orphans() -> list[str]:
            keep = self.reachable()
            built = self.leases.alive("build") if self.leases else []
            keep |= {f"{part}/{name}/" for u in built for part, name in (("indexes", u.replace("-", "")), ("metadata", u))}
            prefixes = tuple(k for k in keep if k.endswith("/"))
            found = [f for part in ("indexes", "metadata") for f in self.warehouse.files(part)]
            return sorted(f for f, _, changed in found if changed < limit and f not in keep and not f.startswith(prefixes or ("\0",)))

        out = orphans()
        if not dry_run and out:
            if self.leases and set(self.leases.alive("session")) - {self.owner}:
                raise Busy("another session is open")
            out = sorted(set(out) & set(orphans()))
            for f in out:
                self.warehouse.delete(f)
                self.catalog.purge(f)
        return out


def verify_http(url: str, objects: dict[str, tuple[int, str]], timeout: float = 60) -> None:
    """Read every object, given with its size and digest, from where readers will: ``url`` and its location."""
    for location, (size, digest) in objects.items():
        at = f"{url.rstrip('/')}/{quote(location)}"
        seen, got = hashlib.sha256(), 0
        try:
            with urlopen(at, timeout=timeout) as f:  # noqa: S310
                while chunk := f.read(1 << 20):
                    seen.update(chunk)
                    got += len(chunk)
        except OSError as e:
            raise Corrupt(f"an object cannot be read: {at}: {e}") from e
        if got != size or seen.hexdigest() != digest:
            raise Corrupt(f"an object differs: {at}")


def publish(source: Warehouse, metadata_location: str, target: Warehouse, verify_url: str | None = None) -> list[str]:
    """Copy an index to another, empty warehouse: data first, verified by size and digest, the metadata last; ``verify_url``: where all of it is read again over HTTP."""
    if target.files():
        raise AlreadyExists("the target is not empty")
    doc = check_metadata(source.read_json(metadata_location))
    s = current(doc)
    relations = s["index-relations"]
    objects: list[str] = []
    if "artifact_manifest" in relations:
        inner = source.read_json(relations["artifact_manifest"])
        prefixes, last = [inner["hierarchy"]["centroids"], inner["hierarchy"]["roots"], inner["postings"]], [relations["artifact_manifest"]]
        where = inner["postings"]
    else:
        named = s["parameters"]["ivf_centroids_metadata_location"]
        inner = source.read_json(named)
        prefixes, last, where = [inner["centroids"], inner["roots"], relations["ivf_postings"]], [named], relations["ivf_postings"]
    digests = {f"{where}{f['path']}": f["sha256"] for f in check_postings(source.read_json(f"{where}manifest.json"))["files"]}
    for p in prefixes:
        objects += sorted((f for f, _, _ in source.files(p.rstrip("/"))), key=lambda f: (f.endswith("manifest.json"), f))
    written: dict[str, tuple[int, str]] = {}
    for f in [*objects, *last, metadata_location]:
        data = source.read_bytes(f)
        if f in digests and hashlib.sha256(data).hexdigest() != digests[f]:
            raise Corrupt(f"an object has changed: {f}")
        target.create(f, data)
        written[f] = (len(data), hashlib.sha256(data).hexdigest())
    if verify_url is not None:
        verify_http(verify_url, written)
    return [*objects, *last, metadata_location]
