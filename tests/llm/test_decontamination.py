"""Windows of benchmark items against a plain search, and the defined cases."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import decontamination as d
from tallyforge.llm.common import NOT_ALNUM, hash_words, utf8, words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, items string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, size=10):
    """What each document has, by comparing every window with every place."""
    windows = []
    for i, t in items:
        w = WORDS.findall(lower(t))
        n = min(size, len(w))
        windows += [(str(i), w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for doc, t in docs:
        w = WORDS.findall(lower(t))
        hit, found = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc  ", max_size=60), min_size=1, max_size=6), st.lists(st.text("abc  ", max_size=40), max_size=4))
def test_a_shard_finds_what_a_plain_search_finds(texts, items):
    import pyarrow as pa

    buf, at = utf8(pa.array(texts, pa.string()))
    s, e, row = words(buf, at, NOT_ALNUM)
    every = [d.Queries(*d.hashed(list(range(a, b)), items[a:b]), 3) for a, b in ((0, 2), (2, len(items))) if a < b]
    found = d.Found(hash_words(buf, s, e), row, len(texts), max((q.deepest for q in every), default=0))
    for q in every:
        found.add(q)
    for r, f, want in zip(found.ranges, found.items, plain(list(enumerate(texts)), list(enumerate(items)), 3), strict=True):
        assert sum(b - a for a, b in r) == want[2]
        assert len(f) == want[3]


@pytest.mark.parametrize("block", [8 << 20, 8])
def test_defined_cases(spark, block):
    ten = "One two three four five six seven eight nine ten"
    docs = [(1, f"x {ten} y", None, "a"), (2, None, "en", None), (3, "", "en", "b"), (4, f"pre {ten.upper()} {ten}", "en", "c"), (5, "one two three", None, None), (6, "short item", None, None), (7, f"{ten[:-3]}", None, None), (8, "zz " * 5000 + ten + " zz" * 5000, None, None), (1, f"x {ten} y", None, "a"), (1, "other", None, None), (None, ten, None, None), (None, "no", None, None)]
    items = [(10, f"{ten} eleven"), (2, ten), (7, "Short, item!"), (8, ""), (9, None), (11, "..."), (2, ten)]
    got = d.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    rows = sorted((tuple(r)[:6] for r in got.collect()), key=str)
    assert rows == sorted(plain([x[:2] for x in docs], list(dict.fromkeys(items))), key=str), "one row each, in any number of blocks"
    kept = d.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7] and kept.columns == ["doc_id", "text", "lang", "items"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in d.report(docs, none).collect()] == [False]
    assert d.report(docs.where("false"), none).count() == 0
    assert d.clean(docs, none).count() == 1


def test_longest_match_and_places(spark):
    docs = spark.createDataFrame([(1, "q a b c d e z a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    r = d.matches(docs, items, 2).first()
    assert r.longest == 5 and r.ranges == [[1, 6], [7, 9]]


def test_query(spark, sf):
    from oracles import same_rows

    from tallyforge.llm import queries

    same_rows(queries.QUERIES["op8_decontamination"](spark, sf), queries.ORACLES["op8_decontamination"], sf)
    assert F is not None
