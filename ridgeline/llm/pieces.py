"""Cut texts that are larger than a token limit into overlapping pieces at natural boundaries.

Lexical cohesion: at each paragraph, line or sentence end the words of the block before and the block after are compared.
Where their similarity has a valley the topic changes; each piece ends at the deepest valley that its size window holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.bpe import VOCABULARY, Encoder, encoder, shared_vocabulary
from ridgeline.plans.names import fresh
from ridgeline.plans.ship import ship

_ENDS = re.compile(r"\n[ \t\r]*\n\s*|\n\s*|[.!?…][\"'”’»)\]]*(?=\s)|[。！？]+")
#: Scripts without spaces between words: a run of them counts as its pairs of neighbouring characters.
_WORDS = re.compile(r"([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+)|[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


@dataclass(frozen=True)
class Cutting:
    """``limit`` tokens a piece at most, ``overlap`` tokens between neighbours, no cut at a boundary before ``least``
    tokens where a later one exists; ``block`` words on each side are compared, in ``buckets`` hashed counts;
    ``bonus`` is added to the depth of a sentence end, a line end and a paragraph end."""

    limit: int = 1024
    overlap: int = 64
    least: int = 512
    block: int = 60
    buckets: int = 256
    bonus: tuple[float, float, float] = (0.0, 0.05, 0.15)

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.least <= self.limit - 8:
            raise ValueError("0 <= overlap < least <= limit - 8 is needed")


def depths(words: np.ndarray, at: np.ndarray, c: Cutting) -> np.ndarray:
    """Depth of the similarity valley at each boundary; ``words`` hashed words, ``at`` the number of words before it."""
    sims = np.ones(len(at))
    for lo in range(0, len(at), 256):  # a block of boundaries at a time: memory stays small for any length of text
        cut = at[lo : lo + 256]
        first, last = max(0, cut[0] - c.block), min(len(words), cut[-1] + c.block)
        span = (words[first:last] * 0x9E3779B1 >> 15) % c.buckets  # neighbouring code points spread over all buckets
        seen = np.zeros((len(span) + 1, c.buckets), np.float32)
        seen[np.arange(1, len(span) + 1), span] = 1
        np.cumsum(seen, axis=0, out=seen)
        mid = cut - first
        left, right = seen[mid] - seen[np.maximum(mid - c.block, 0)], seen[np.minimum(mid + c.block, len(span))] - seen[mid]
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sims[lo : lo + 256] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)

    def climb(s: np.ndarray) -> np.ndarray:
        top = np.empty_like(s)
        for i in range(len(s)):
            top[i] = s[i] if i == 0 or s[i - 1] <= s[i] else top[i - 1]
        return top

    return climb(sims) + climb(sims[::-1])[::-1] - 2 * sims


def cut_text(text: str, enc: Encoder, c: Cutting) -> list[tuple[int, int, str]]:
    """(first token, end token, text) of each piece; one piece where the text is not larger than the limit.

    A piece starts ``overlap`` tokens before the end of the one before it, or up to three tokens earlier where a token
    starts inside a character. No piece has more than ``limit`` tokens, neither in the text's own encoding nor on its own.
    """
    ids = enc.encode(text)
    n = len(ids)
    if n <= c.limit:
        return [(0, n, text)]
    raw = np.frombuffer(text.encode(), np.uint8)
    edge = np.concatenate([[0], np.cumsum(enc.lengths[ids])])  # bytes before each token
    starts = np.concatenate([(raw & 0xC0) != 0x80, [True]])  # bytes that begin a character, and the end
    whole = starts[edge]  # token indexes at character bounds
    char_byte = np.flatnonzero(starts)
    found = [(m.end(), 0 if m.group()[0] != "\n" else 2 if m.group().count("\n") > 1 else 1) for m in _ENDS.finditer(text)]
    spots = np.array([f[0] for f in found], np.int64)
    kinds = np.array([f[1] for f in found], np.int64)
    token = np.searchsorted(edge, char_byte[spots], "right") - 1
    while len(token) and not whole[token].all():
        token = np.where(whole[token], token, token - 1)
    matches = word_hashes(text)
    hashed = np.array([h for _, h in matches], np.int64)
    before = np.searchsorted(np.array([s for s, _ in matches], np.int64), spots)
    score = depths(hashed, before, c) + np.array(c.bonus)[kinds] if len(spots) else np.zeros(0)
    spaces = None
    out: list[tuple[int, int, str]] = []
    start = 0
    while True:
        top = min(n, start + c.limit)
        while True:
            end = top
            if end < n:
                lo, hi = np.searchsorted(token, [start + c.least, top + 1])
                if hi > lo:
                    end = int(token[hi - 1 - np.argmax(score[lo:hi][::-1])])  # of equal depths the last
                elif (early := int(np.searchsorted(token, start + c.overlap + 8))) < hi:
                    end = int(token[hi - 1])  # only before the window: its last boundary
                else:
                    if spaces is None:
                        spaces = np.flatnonzero(whole & np.isin(np.concatenate([raw, [32]])[edge], (9, 10, 13, 32)))
                    k = np.searchsorted(spaces, top, "right") - 1
                    end = int(spaces[k]) if k >= 0 and spaces[k] >= start + c.least else top
                    while not whole[end]:
                        end -= 1
            piece = raw[edge[start] : edge[end]].tobytes().decode()
            excess = len(enc.encode(piece)) - c.limit
            if excess <= 0 or top <= start + c.overlap + 8:
                break
            top = end - max(1, min(excess, 8))
        out.append((start, end, piece))
        if end >= n:
            return out
        start = end - c.overlap
        while not whole[start]:
            start -= 1


def word_hashes(text: str) -> list[tuple[int, int]]:
    """(place, hash) of each word; of each pair of neighbouring characters where words have no spaces between them."""
    out = []
    for m in _WORDS.finditer(text):
        if m.group(1) is None:
            out.append((m.start(), hash_word(m.group())))
        else:
            run, at = m.group(), m.start()
            out += [(at + i, hash_word(run[i : i + 2])) for i in range(max(1, len(run) - 1))]
    return out


@lru_cache(200_000)
def hash_word(word: str) -> int:
    """A stable small hash (Python's own differs between processes)."""
    h = 0
    for x in word.lower().encode():
        h = (h * 31 + x) & 0x7FFFFFFF
    return h


def split_documents(df: DataFrame, id_col: str, text_col: str, cutting: Cutting = Cutting(), vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (id_col, piece_no, first_token, end_token, piece): the pieces of each text in order, without a shuffle.

    Defined cases: a null text has no piece; an empty text, or one within the limit, is one piece; a text without any
    natural boundary is cut at white space, else between characters; texts of any length are cut whole; repeated rows
    are cut each; further columns are ignored; an empty table gives no rows.
    """
    ship(df.sparkSession)
    find = shared_vocabulary(df.sparkSession, vocabulary)
    (tid,) = fresh(["text", "piece_no", "first_token", "end_token", "piece"], "id")
    rows = df.select(F.col(id_col).alias(tid), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    kind = rows.schema[tid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(find())
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                took, no, first, end, pieces = [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for k, (s, e, piece) in enumerate(cut_text(text, enc, cutting)):
                        took.append(i)
                        no.append(k)
                        first.append(s)
                        end.append(e)
                        pieces.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(took, pa.int64())), pa.array(no, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(pieces, pa.string())],
                    names=[tid, "piece_no", "first_token", "end_token", "piece"],
                )

    out = rows.mapInArrow(run, f"`{tid}` {kind}, piece_no int, first_token bigint, end_token bigint, piece string")
    return out.withColumnRenamed(tid, id_col)
