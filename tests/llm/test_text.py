"""Tokenizer, piece cutting and leak search."""

import base64
import os
import random
import unicodedata

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import leaks
from ridgeline.llm.bpe import PATTERN, VOCABULARY, encoder, token_ids
from ridgeline.llm.leaks import leaked_items, words_of
from ridgeline.llm.pieces import Cutting, cut_text, hash_word, split_documents, word_hashes

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


SPACES = [" ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", " "]
BITS = [*SPACES, "a", "É", "中文", "12", "²", "½", "٣", "'s", "'", "'ll", "...", "<|endoftext|>", "Word", "﻿", "😀", "́", "x" * 70]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_ids_equal_those_of_another_library(text):
    ranks = test_ids_equal_those_of_another_library.__dict__.setdefault("enc", None) or tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}, special_tokens={})
    test_ids_equal_those_of_another_library.__dict__["enc"] = ranks
    ids = encoder().encode(text)
    assert ids == ranks.encode_ordinary(text)
    assert encoder().decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    assert encoder().decode_bytes(encoder().encode(text)) == text.encode()


def test_whole_table(spark, data, other):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in token_ids(docs, "doc_id", "text").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got == {k: other.encode_ordinary(v or "") for k, v in texts.items()}


def test_token_cases(spark, other):
    long = "many words here " * 20_000 + "z" * 5000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "same", 1), (3, "same", 1), (None, " ", 2), (5, long, 3)], "id long, ids string, text int")
    rows = token_ids(df, "id", "ids").collect()
    assert sorted((r["id"] or 0, len(r["ids"])) for r in rows) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (5, len(other.encode_ordinary(long)))]
    assert token_ids(df.limit(0), "id", "ids").count() == 0


def check_pieces(text, pieces, c):
    enc = encoder()
    ids = enc.encode(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(ids)
    for s, e, piece in pieces:
        assert enc.decode(ids[s:e]) == piece
        assert len(enc.encode(piece)) <= c.limit and e - s <= c.limit
    for (_, e, _), (s, _, _) in zip(pieces, pieces[1:]):
        assert c.overlap <= e - s <= c.overlap + 3


def test_pieces_cover_overlap_and_fit():
    r = random.Random(3)
    c = Cutting(limit=96, overlap=8, least=48)
    words = ["alpha", "beta", "索引", "naïve", "Größe", "x1", "😀", "y" * 40]
    for _ in range(40):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "。", ""]) for _ in range(r.randint(0, 900)))
        check_pieces(text, cut_text(text, encoder(), c), c)
    for text in ("z" * 4000, "中" * 3000, " " * 3000, "\n" * 2000, "😀" * 1500):
        check_pieces(text, cut_text(text, encoder(), c), c)


def test_cut_falls_on_the_change_of_topic():
    a = " ".join("The index stores vector lists in sorted pages." for _ in range(9))
    b = " ".join("Der Fluss friert im Winter langsam zu." for _ in range(12))
    c = Cutting(limit=150, overlap=8, least=40, block=24)
    pieces = cut_text(a + "\n" + b, encoder(), c)
    assert pieces[0][2] == a + "\n"


def test_topics_without_spaces_between_words():
    r = random.Random(3)
    one, two = [chr(c) for c in range(0x4E00, 0x4E08)], [chr(c) for c in range(0x5E00, 0x5E08)]
    sentence = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(8, 14))) + "。"
    text = "".join(sentence(one) for _ in range(30)) + "".join(sentence(two) for _ in range(60))
    change = next(i for i, c in enumerate(text) if c in two)
    c = Cutting(limit=1400, overlap=16, least=300, bonus=(0.0, 0.0, 0.0))
    (_, _, first), *_ = cut_text(text, encoder(), c)
    assert abs(len(first) - change) <= 15  # at the change or one sentence beside it
    assert [h for _, h in word_hashes("ab 中文字x")] == [hash_word(w) for w in ("ab", "中文", "文字", "x")] and word_hashes("中") == [(0, hash_word("中"))]


def test_a_boundary_before_the_window_is_better_than_none():
    c = Cutting(limit=100, overlap=8, least=80)
    text = " ".join(["word"] * 40) + ". " + "z9" * 400
    pieces = cut_text(text, encoder(), c)
    check_pieces(text, pieces, c)
    assert pieces[0][2].endswith("word.")


def test_piece_cases(spark):
    long = "One sentence of the text. " * 3000
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "short", 1), (4, long, 1), (4, long, 1)], "piece int, text string, piece_no int")
    rows = split_documents(df, "piece", "text").collect()
    count = {}
    for r in rows:
        count[r[0]] = count.get(r[0], 0) + 1
    n = len(cut_text(long, encoder(), Cutting()))
    assert count == {2: 1, 3: 1, 4: 2 * n} and n > 10
    with pytest.raises(ValueError):
        Cutting(limit=100, overlap=90, least=80)


def brute(docs, items, run=10):
    windows = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - run + 1):
            windows.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + run]), ())}
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_leaks_against_brute_force(spark, limit):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "a b c")]
    docs = [(0, None), (1, ""), (2, "w1 w2")]
    for d in range(3, 90):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if d % 2:
            src = r.choice(items[:30])[1].split()
            n = r.randint(6, 14)
            at = r.randint(0, max(0, len(src) - n))
            words[len(words) // 2 : len(words) // 2] = [x.upper() if r.random() < 0.5 else f"{x}," for x in src[at : at + n]]
        docs.append((d, " ".join(words)))
    docs += [docs[5], (200, "x " * 30_000 + items[3][1] + " y" * 30_000)]
    dd = spark.createDataFrame(docs, "doc int, item string").withColumnRenamed("item", "text")
    ii = spark.createDataFrame(items, "doc int, text string")
    got = {tuple(x) for x in leaked_items(dd, "doc", "text", ii.withColumnRenamed("doc", "item"), "item", "text", segment_words=50, broadcast_bytes=limit).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 10
    assert leaked_items(dd.limit(0), "doc", "text", ii.withColumnRenamed("doc", "item"), "item", "text", broadcast_bytes=limit).count() == 0
    assert leaked_items(dd, "doc", "text", ii.withColumnRenamed("doc", "item").limit(0), "item", "text", broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_short_texts_that_normalisation_lengthens(spark, limit):
    long = "\ufdfa" * 6  # six characters, 19 words
    docs = spark.createDataFrame([(1, long), (2, "\ufdfa" * 2), (3, "z " + long)], "doc int, text string")
    items = spark.createDataFrame([(7, long), (8, long + " end")], "item int, text string")
    got = {tuple(x) for x in leaked_items(docs, "doc", "text", items, "item", "text", broadcast_bytes=limit).collect()}
    assert got == {(1, 7), (1, 8), (3, 7), (3, 8)}


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    r = random.Random(9)
    items = [(i, " ".join(r.choice("abcdef") for _ in range(25))) for i in range(40)]
    docs = [(d, " ".join(r.choice("abcdefz") for _ in range(60)) + " " + items[d % 40][1][4:30]) for d in range(60)]
    for bad in (False, True):
        if bad:
            monkeypatch.setattr(leaks, "_rolled", lambda h, width: np.zeros(max(0, len(h) - width + 1), np.uint64))
        index = leaks._Items([i for i, _ in items], [t for _, t in items], 6)
        assert {(d, i) for d, t in docs for i in index.found(words_of(t))} == brute(docs, items, 6)


def test_words_ignore_case_form_and_format_characters():
    assert words_of("Ｖec​tor_x  É-2­3") == words_of("vector x é 23") == ["vector", "x", unicodedata.normalize("NFC", "é"), "23"]
