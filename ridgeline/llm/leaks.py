"""Find held-out passages inside a large corpus.

MinHash containment over windows. A passage leaks where a document contains a run of ``run`` consecutive words of an item.
The run's word shingles form a small set, and every such set, of the items and of the documents, is represented by its
minimum hash. Equal windows have equal minima, so the search for contained windows misses nothing; a document's sketch holds only
the distinct minima of its windows. Size partitions: texts shorter than a run cannot contain one; others are cut into segments of
about equal size that overlap by a run, so that short items are compared with windows of their own size in documents of any length.
Each candidate is verified by the exact words of the window.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.lineage import cut_lineage
from ridgeline.plans.ship import ship

SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")
_FORMAT = dict.fromkeys(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without case, format characters and differences of compatibility or composition."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_FORMAT))
        return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))
    return _WORD.findall(text.lower())


def window_minima(h: np.ndarray, run: int) -> np.ndarray:
    """The minimum shingle hash of each window of ``run`` words."""
    g = min(SHINGLE, run)
    if len(h) < run:
        return np.zeros(0, np.uint64)
    n = len(h) - g + 1
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(g):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
    m = s[: len(h) - run + 1].copy()
    for j in range(1, run - g + 1):
        np.minimum(m, s[j : j + len(m)], out=m)
    return m


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each stretch of ``width`` hashes."""
    n = len(h) - width + 1
    s = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width if n > 0 else 0):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
            s ^= s >> np.uint64(32)
    return s


class _Items:
    """All windows of the items: their minima, and each distinct window, by its hash and its exact words, with the items that have it.

    Words are numbers of a vocabulary, so a window takes a few bytes whatever its length, and equal numbers are equal words.
    """

    def __init__(self, ids: list, texts: list[str], run: int):
        self.ids, self.run, self.vocabulary = ids, run, {}
        words, starts, owner, at = [], [], [], 0
        for i, text in enumerate(texts):
            w = words_of(text)
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)  # 0 is a word of no item
            words.append(np.fromiter(map(self.vocabulary.__getitem__, w), np.int32, len(w)))
            n = max(0, len(w) - run + 1)
            starts.append(np.arange(at, at + n, dtype=np.int64))
            owner.append(np.full(n, i, np.int64))
            at += len(w)
        self.hashes = np.fromiter(map(word_hash, self.vocabulary), np.uint64, len(self.vocabulary))
        self.hashes = np.concatenate([np.zeros(1, np.uint64), self.hashes])
        self.words = np.concatenate([*words, np.zeros(0, np.int32)])
        start, owner = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        h = self.hashes[self.words]
        key, low = _rolled(h, run)[start], window_minima(h, run)[start]
        self.minima = np.unique(low)
        # A bitmap of the minima's lowest bits passes over most windows before the exact search.
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.minima & np.uint64(0xFFFFF)).astype(np.int64)] = True
        o = np.lexsort((owner, key))
        key, start, owner = key[o], start[o], owner[o]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        group = np.searchsorted(first, np.arange(len(key)), "right") - 1
        same = np.ones(len(key), bool)
        for j in range(run):
            same &= self.words[start + j] == self.words[start[first[group]] + j] if len(key) else same
        # Windows whose hash is that of another window, should there be any, are kept by their words.
        self.odd: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for x in np.flatnonzero(~same):
            self.odd[tuple(self.words[start[x] : start[x] + run].tolist())].add(int(owner[x]))
        self.keys, self.first = key[first], start[first].astype(np.int32 if at < 1 << 31 else np.int64)
        pairs = np.unique(np.stack([group[same], owner[same]], 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        self.begin, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1].astype(np.int32)

    def found(self, words: list[str]) -> set[int]:
        """Numbers of the items that share a window with a text."""
        run = self.run
        code = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(code > 0)])
        spots = np.flatnonzero(known[run:] - known[:-run] == run) if len(words) >= run else ()
        if not len(spots):
            return set()
        h = self.hashes[code]
        m = window_minima(h, run)[spots]
        maybe = np.flatnonzero(self.mask[(m & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(maybe):
            return set()
        m = m[maybe]
        spots = spots[maybe[self.minima[np.minimum(np.searchsorted(self.minima, m), len(self.minima) - 1)] == m]]
        if not len(spots):
            return set()
        key = _rolled(h, run)[spots]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[at] == key
        for j in range(run):
            ok &= code[spots + j] == self.words[self.first[at] + j]
        out = {int(x) for a in set(at[ok].tolist()) for x in self.owners[self.begin[a] : self.begin[a + 1]]}
        if self.odd:
            for k in spots[~ok]:
                out |= self.odd.get(tuple(code[k : k + run].tolist()), set())
        return out


def word_hash(word: str) -> int:
    """The same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _segments(words: list[str], run: int, size: int) -> Iterator[list[str]]:
    """Parts of at most ``size`` words that overlap by ``run - 1``: every window lies in exactly one."""
    for at in range(0, max(1, len(words) - run + 1), size - run + 1):
        yield words[at : at + size]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, run: int = 10, segment_words: int = 4096, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Rows (doc_id, item_id), each pair once: the document has ``run`` consecutive words of the item.

    Items whose texts together are within ``broadcast_bytes`` (measured first) are indexed once, on the driver, the index is sent to
    each worker, and the corpus is read once, without a shuffle. Beyond it, both sides' windows are joined by minimum and words with a
    shuffle; of the corpus only windows go in whose minimum some item may have. Both ways give the same pairs.

    Defined cases: null, empty and short texts, of documents or items, contain nothing; repeated rows give a pair once;
    null ids come out as they are; texts of any length are searched whole; a run of words that comes twice counts once; an empty table on
    either side gives no rows; further columns are ignored.
    """
    if run < 1 or segment_words < 2 * run:
        raise ValueError("run must be positive and segments at least twice as long")
    ship(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    i = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = i.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    out = _broadcast_search(d, i, run, segment_words) if size <= broadcast_bytes else _shuffled_search(d, i, run, segment_words)
    return out.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def _broadcast_search(d: DataFrame, i: DataFrame, run: int, size: int) -> DataFrame:
    rows = i.collect()  # its size was measured
    shared = d.sparkSession.sparkContext.broadcast(_Items([r["item"] for r in rows], [r["text"] for r in rows], run))
    doc_type, item_type = d.schema["doc"].dataType.simpleString(), i.schema["item"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            took, found = [], []
            for at, t in enumerate(b.column(1).to_pylist()):
                hits: set[int] = set()
                for words in _segments(words_of(t), run, size):
                    hits |= index.found(words)
                took += [at] * len(hits)
                found += [index.ids[x] for x in hits]
            if took:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(took, pa.int64())), pa.array(found, arrow_item)], names=["doc", "item"])

    return d.mapInArrow(search, f"doc {doc_type}, item {item_type.simpleString()}")


BITS = 1 << 23  # of the bitmap of the items' minima: its size is fixed, a full one passes every window on to the exact join


def _shuffled_search(d: DataFrame, i: DataFrame, run: int, size: int) -> DataFrame:
    """Join on (minimum, window); windows travel as their words, so that equality is exact."""

    def sketch(df: DataFrame, key: str, bits: Broadcast | None) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, int] = {}
            for b in batches:
                for at, t in enumerate(b.column(1).to_pylist()):
                    if len(cache) > 500_000:
                        cache.clear()
                    for words in _segments(words_of(t), run, size):
                        for w in set(words).difference(cache):
                            cache[w] = word_hash(w)
                        m = window_minima(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), run)
                        spots = np.arange(len(m)) if bits is None else np.flatnonzero(bits.value[(m % np.uint64(BITS)).astype(np.int64)])
                        if not len(spots):
                            continue
                        text = [" ".join(words[k : k + run]) for k in spots.tolist()]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([at] * len(spots), pa.int64())), pa.array(m[spots].view(np.int64)), pa.array(text, pa.string())], names=[key, "minimum", "window"])

        return df.select(key, "text").mapInArrow(windows, f"{key} {kind}, minimum bigint, window string")

    items = cut_lineage(sketch(i, "item", None).distinct())
    set_bits = items.select(F.pmod("minimum", F.lit(BITS)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()  # at most BITS numbers
    bitmap = np.zeros(BITS, bool)
    bitmap[set_bits] = True
    minima = items.select("minimum").distinct()
    docs = sketch(d, "doc", d.sparkSession.sparkContext.broadcast(bitmap)).join(minima, "minimum", "left_semi").distinct()
    return docs.join(items, ["minimum", "window"]).select("doc", "item")
