"""Byte-level BPE through a sentencepiece model that is serialised directly from a public vocabulary.

Each token's bytes are mapped to printable characters, one character a byte, and become a piece whose score is the negative
rank, so that sentencepiece merges in rank order. Normalisation is the identity: no dummy prefix, no white-space handling.
The text is cut into pre-tokens first; the model encodes each mapped pre-token, and decoding inverts the byte map.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.plans.names import fresh
from ridgeline.plans.ship import ship

#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if not all(out):
        raise ValueError(f"{path}: ranks have gaps")
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model (protocol buffer wire format) whose piece i is token i; the unknown piece comes last."""
    table = byte_characters()
    parts = []
    for rank, token in enumerate(tokens):
        piece = "".join(table[b] for b in token).encode()
        parts.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + np.float32(-rank).tobytes() + _field(3, 1)))
    parts.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Text to ids and back. Words are cached, up to ``cache_words``; then the cache starts anew."""

    def __init__(self, path: str = VOCABULARY, cache_words: int = 400_000):
        self.tokens = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.map = byte_characters()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pre: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def _plain(self, text: str) -> list[int]:
        """Ids by pre-tokens; the model encodes those not met lately, in one call where they are many (a call has fixed costs)."""
        cache = self.pre
        if len(cache) > self.cache_words:
            cache.clear()
        pres = self.pattern.findall(text)
        if new := [p for p in dict.fromkeys(pres) if p not in cache]:
            mapped = ["".join([self.map[b] for b in p.encode()]) for p in new]
            ids = self.model.encode(mapped, num_threads=1) if len(mapped) > 64 else [self.model.EncodeAsIds(m) for m in mapped]
            cache.update(zip(new, map(tuple, ids)))
        return list(chain.from_iterable([cache[p] for p in pres]))

    def _fill(self, words: list[str]) -> None:
        if len(self.words) > self.cache_words:
            self.words.clear()
        cache = self.words
        for w in set(words):
            if w and w not in cache and len(w) < 64 and not w[0].isspace() and not w[-1].isspace():
                cache[w] = tuple(self._plain(" " + w))

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; strings that look like special tokens are ordinary text; the empty text has none.

        A single space between two characters that aren't white space always begins a pre-token, so there the text can be
        cut and each word, with its space, looked up. Elsewhere the pattern runs over the whole stretch.
        """
        head, *words = text.split(" ")
        cache = self.words
        for _ in range(2):
            try:
                found = [cache[w] for w in words]
                break
            except KeyError:
                self._fill(words)
        else:
            return self._mixed(head, words)
        if words and (not head or head[-1].isspace()):
            return self._mixed(head, words)
        return [*self._plain(head), *chain.from_iterable(found)]

    def _mixed(self, head: str, words: list[str]) -> list[int]:
        out: list[int] = []
        cache, stretch, safe = self.words, head, bool(head) and not head[-1].isspace()
        for w in words:
            if safe and (ids := cache.get(w)) is not None:
                if stretch:
                    out += self._plain(stretch)
                    stretch = ""
                out += ids
            else:
                # A long word without white space at its ends still is a stretch of its own.
                if safe and w and not w[0].isspace():
                    if stretch:
                        out += self._plain(stretch)
                    stretch = " " + w
                else:
                    stretch += " " + w
                safe = bool(w) and not w[-1].isspace()
        return out + self._plain(stretch) if stretch else out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of ``ids``: pieces of the model, mapped back to bytes."""
        back = _byte_values()
        return bytes(back[c] for c in chain.from_iterable(self.model.id_to_piece(int(i)) for i in ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(1)
def _byte_values() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def shared_vocabulary(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send the vocabulary file to every executor; the result tells a task where it lies there."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


def token_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (id_col, ids): the ids of each row's text, one row in, one row out, without a shuffle.

    Defined cases: a null text and an empty text both give an empty list, never null; white space is encoded as it is;
    null and repeated ids pass through; further columns are ignored; an empty table gives no rows.
    ``vocabulary`` is a file of the driver, which is sent to the executors.
    """
    ship(df.sparkSession)
    find = shared_vocabulary(df.sparkSession, vocabulary)
    (tid,) = fresh(["ids", "text"], "id")
    rows = df.select(F.col(id_col).alias(tid), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[tid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(find())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = [enc.encode(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
                values = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], names=[tid, "ids"])

    return rows.mapInArrow(run, f"`{tid}` {kind}, ids array<int>").select(F.col(tid).alias(id_col), "ids")
