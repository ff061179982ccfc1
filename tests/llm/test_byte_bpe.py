"""Ids as the reference library gives them, and exact round trips."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import byte_bpe, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.whole, special_tokens={})


TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("abc '\n\t 019.!")), st.sampled_from(["▁", "Ġ", "é", "日", "😀"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_and_round_trip(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_entry_is_reached_by_merges(codec):
    for i, word in enumerate(codec.vocabulary[::37]):
        assert codec.model.encode(word.decode("latin-1").translate(codec.shown)) == [37 * i]


def test_other_vocabularies():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = byte_bpe.codec(path, PATTERN)
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=c.whole, special_tokens={})
    for text in ("Größe und Länge", "los niños", "l'été à la plage", "x" * 300):
        assert c.encode(text) == t.encode_ordinary(text) and c.decode(c.encode(text)) == text.encode()


def test_forgetting_changes_nothing(monkeypatch, codec, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    text = "one two three four five six seven one two three"
    assert codec.encode(text) == library.encode_ordinary(text)


def test_operator(spark, library):
    texts = {1: "Hello, world", 2: "", 3: None, 4: "word " * 40_000, 5: "Hello, world"}
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, PATH, PATTERN).collect()}
    for k, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = byte_bpe.encoded(docs, PATH, PATTERN)
    assert {r.doc_id: bytes(r.raw) for r in byte_bpe.decoded(tokens, PATH, PATTERN).collect()} == {k: (t or "").encode() for k, t in texts.items()}
    assert byte_bpe.round_trip(docs.where("false"), PATH, PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 30), TEXTS), max_size=4))
def test_counts_follow_edits(codec, library, text, edits):
    tree = token_counts.TokenTree(token_counts.Counter(codec), text)
    for start, size, new in edits:
        tree.edit(start, start + size, new)
        a = min(start, len(text))
        text = text[:a] + new + text[min(start + size, len(text)) :]
        assert tree.text() == text
        assert tree.n_tokens == len(library.encode_ordinary(text))
        assert [p for b in tree.blocks for p in b] == codec.split(text)


def test_few_pretokens_are_counted_again(codec):
    tree = token_counts.TokenTree(token_counts.Counter(codec), "some words in a row " * 20_000)
    first = tree.encoded
    tree.edit(200_000, 200_004, "WORD")
    assert tree.encoded - first < 40


def test_count_operator(spark, sf, library):
    docs = spark.createDataFrame([(1, "abc def"), (2, None), (3, ""), (1, "abc def")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 0, 3, "xyz "), (1, 2, 99, 99, "!"), (2, 1, 0, 0, "new text"), (9, 1, 0, 0, "x")], "doc_id long, seq int, start int, end int, text string")
    got = sorted((r.doc_id, r.n_edits, r.n_tokens, r.n_tokens_after) for r in token_counts.recounted(token_counts.with_edits(docs, edits), PATH, PATTERN).collect())
    n = lambda t: len(library.encode_ordinary(t))
    assert got == [(1, 2, n("abc def"), n("xyz  def!")), (1, 2, n("abc def"), n("xyz  def!")), (2, 1, 0, n("new text")), (3, 0, 0, 0)]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from tallyforge.llm import queries

    note = "\nEditor's note: see 2nd ed.\n"
    for r in queries.QUERIES["op1_token_counts"](spark, sf).collect():
        t = texts[r.doc_id]
        m, q = len(t) // 2, len(t) // 4
        after = t[:m] + note + t[m:]
        after = after[:q] + " [...]" + after[q + 3 :]
        after = after[: max(len(t) - 5, 0) + len(note)] + after[len(t) + len(note) + 6 :]
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (n(t), n(after), len(after))
