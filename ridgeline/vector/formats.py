"""Metadata, centroid and postings documents: writing and strict reading."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from ridgeline.vector.errors import Corrupt

FINGERPRINT_SPACE = uuid.UUID("2fb71e63-a27c-4fc5-9d6d-5070698dc398")  # fixed value of the format
_SNAPSHOT = {"snapshot-id", "sequence-number", "timestamp-ms", "summary", "vector-field", "source-key-fields", "indexed-rows", "index-family", "index-schema-version", "metric", "parameters", "index-relations"}
_METADATA = {"format-version", "index-uuid", "last-updated-ms", "last-sequence-number", "current-snapshot-id", "snapshots", "snapshot-log", "properties"}
_POSTINGS = {"format-version", "nlist", "ntotal", "cid-offsets", "files"}
_FILE = {"path", "cid-bucket", "min-cid", "max-cid", "rows", "size", "sha256"}
_ROLES = {"source": {"ivf_centroids", "ivf_postings"}, "lvq4": {"artifact_manifest"}, "lvq8": {"artifact_manifest"}}
_PARAMETERS = {
    "source": {"dimension", "nlist", "ntotal", "posting_encoding", "ivf_centroids_fingerprint", "ivf_centroids_uuid", "ivf_centroids_metadata_location"},
    "lvq4": {"artifact_uuid", "dimension", "nlist", "ntotal", "posting_encoding"},
    "lvq8": {"artifact_uuid", "dimension", "nlist", "ntotal", "posting_encoding"},
}


def need(ok: Any, message: str) -> None:
    if not ok:
        raise Corrupt(message)


def load(text: str) -> dict:
    """JSON without duplicate keys."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        keys = [k for k, _ in pairs]
        need(len(set(keys)) == len(keys), "a key comes twice")
        return dict(pairs)

    try:
        out = json.loads(text, object_pairs_hook=once)
    except ValueError as e:
        raise Corrupt(f"not JSON: {e}") from e
    need(isinstance(out, dict), "a document is an object")
    return out


def fields(doc: Any, names: set[str], what: str) -> None:
    need(isinstance(doc, dict), f"{what}: not an object")
    need(doc.keys() == names, f"{what}: fields differ: {sorted(doc.keys() ^ names)}")


def is_int(x: Any, least: int = 0) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def uuid_ok(x: Any) -> bool:
    try:
        return isinstance(x, str) and str(uuid.UUID(x)) == x and uuid.UUID(x).int != 0
    except ValueError:
        return False


def relative(x: Any) -> bool:
    """A location below the warehouse: no scheme, not absolute, no empty or dot segment."""
    return isinstance(x, str) and bool(x) and ":" not in x and not x.startswith("/") and all(p not in ("", ".", "..") for p in x.rstrip("/").split("/"))


def check_metadata(doc: dict) -> dict:
    """The document itself, or Corrupt."""
    fields(doc, _METADATA, "metadata")
    need(doc["format-version"] == 1, "unsupported format-version")
    need(uuid_ok(doc["index-uuid"]), "index-uuid is not canonical")
    need(is_int(doc["last-updated-ms"]) and is_int(doc["last-sequence-number"], 1) and is_int(doc["current-snapshot-id"], 1), "a number is out of range")
    snaps, log = doc["snapshots"], doc["snapshot-log"]
    need(isinstance(snaps, list) and snaps and isinstance(log, list) and log and isinstance(doc["properties"], dict), "snapshots or log are empty")
    for s in snaps:
        fields(s, _SNAPSHOT, "snapshot")
        need(is_int(s["snapshot-id"], 1) and is_int(s["sequence-number"], 1) and s["sequence-number"] <= doc["last-sequence-number"] and is_int(s["timestamp-ms"]), "a snapshot number is out of range")
        keys = s["source-key-fields"]
        need(isinstance(keys, list) and keys and len(set(keys)) == len(keys), "source keys are empty or repeat")
        need(is_int(s["indexed-rows"], 1), "indexed-rows must be positive")
        need(s["index-family"] == "ivf" and s["index-schema-version"] == 1, "unsupported family or schema version")
        need(s["metric"] in ("l2_squared", "cosine"), "unsupported metric")
        p, r = s["parameters"], s["index-relations"]
        need(isinstance(p, dict) and p.get("posting_encoding") in _ROLES, "unsupported posting_encoding")
        fields(p, _PARAMETERS[p["posting_encoding"]], "parameters")
        fields(r, _ROLES[p["posting_encoding"]], "index-relations")
        need(all(relative(v) for v in r.values()), "an index relation leaves the warehouse")
        for n in ("dimension", "nlist", "ntotal"):
            need(isinstance(p[n], str) and re.fullmatch(r"[1-9][0-9]*", p[n]), f"{n} is not a canonical positive number")
        need(int(p["ntotal"]) == s["indexed-rows"] and int(p["nlist"]) <= int(p["ntotal"]), "row counts differ")
    ids = [s["snapshot-id"] for s in snaps]
    need(len(set(ids)) == len(ids) and len({s["sequence-number"] for s in snaps}) == len(snaps), "a snapshot id or sequence comes twice")
    need(doc["current-snapshot-id"] in ids, "the current snapshot is not retained")
    for name in ("vector-field", "source-key-fields", "index-family", "metric"):
        need(all(s[name] == snaps[0][name] for s in snaps), f"{name} changes between snapshots")
    for e in log:
        fields(e, {"timestamp-ms", "snapshot-id"}, "log entry")
        need(e["snapshot-id"] in ids, "a log entry has no snapshot")
    times = [e["timestamp-ms"] for e in log]
    need(times == sorted(times) and log[-1]["snapshot-id"] == doc["current-snapshot-id"], "the log is out of order")
    return doc


def current(doc: dict) -> dict:
    return next(s for s in doc["snapshots"] if s["snapshot-id"] == doc["current-snapshot-id"])


def check_postings(doc: dict) -> dict:
    fields(doc, _POSTINGS, "postings manifest")
    need(doc["format-version"] == 1 and is_int(doc["nlist"], 1) and is_int(doc["ntotal"], 1), "postings manifest: a number is out of range")
    o = doc["cid-offsets"]
    need(isinstance(o, list) and len(o) > 1 and o[0] == 0 and o[-1] == doc["nlist"] and all(a < b for a, b in zip(o, o[1:])), "cid-offsets are not a cover")
    rows = 0
    for f in doc["files"]:
        fields(f, _FILE, "file entry")
        need(is_int(f["cid-bucket"]) and f["cid-bucket"] < len(o) - 1, "a bucket is unknown")
        need(o[f["cid-bucket"]] <= f["min-cid"] <= f["max-cid"] < o[f["cid-bucket"] + 1], "a file leaves the interval of its bucket")
        need(is_int(f["rows"], 1) and is_int(f["size"], 1) and re.fullmatch("[0-9a-f]{64}", f["sha256"]), "a file entry is out of range")
        need(re.fullmatch(rf"cid_bucket={f['cid-bucket']:06d}/part-\d{{5,}}\.parquet", f["path"]), "a path is not canonical")
        rows += f["rows"]
    need(rows == doc["ntotal"], "the files do not hold ntotal rows")
    need(len({f["path"] for f in doc["files"]}) == len(doc["files"]), "a file comes twice")
    return doc


def fingerprint(vector_field: str, dimension: int, metric: str, nlist: int) -> str:
    name = json.dumps({"vector-field": vector_field, "dimension": dimension, "metric": metric, "nlist": nlist, "clustering-profile-version": 1}, ensure_ascii=False, separators=(",", ":"))
    return str(uuid.uuid5(FINGERPRINT_SPACE, name))


def successor(base: dict | None, snapshot: dict, index_uuid: str, now_ms: int) -> dict:
    """Metadata with ``snapshot`` (its id and sequence filled in) as the current one."""
    snapshot = snapshot | {"sequence-number": base["last-sequence-number"] + 1 if base else 1, "timestamp-ms": max(now_ms, base["snapshot-log"][-1]["timestamp-ms"] if base else 0)}
    return check_metadata({
        "format-version": 1, "index-uuid": base["index-uuid"] if base else index_uuid, "last-updated-ms": snapshot["timestamp-ms"], "last-sequence-number": snapshot["sequence-number"],
        "current-snapshot-id": snapshot["snapshot-id"], "snapshots": [*(base["snapshots"] if base else []), snapshot],
        "snapshot-log": [*(base["snapshot-log"] if base else []), {"timestamp-ms": snapshot["timestamp-ms"], "snapshot-id": snapshot["snapshot-id"]}], "properties": base["properties"] if base else {},
    })
