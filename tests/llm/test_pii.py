"""Base kinds as the patterns give them; the added kinds; redaction."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PIECES = st.sampled_from(["a", "1", "2", "0", "25", "255", "4111111111111111", "@", ".", "-", " ", "+", "+1", "(", ")", "://", "b.c", "x@y.z", "1.2.3.4", "%", "é", "\n", "٣", "123-4567"])


@settings(max_examples=3000, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_base_kinds_equal_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == plain(text)


def test_driver_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert [s for s in pii.spans(r.text) if s[0] in pii.BASE] == plain(r.text)


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, iban DE00 1234 5678 9012 3456 78, https://bob:pw@host.com/x token = \"0123456789abcdef0123\" password: short api_key=abcdefghijklmnopqrst"
    got = [(k, text[a:b]) for k, a, b in pii.spans(text) if k not in pii.BASE]
    assert got == [("login", "https://bob:pw@host.com/x"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("secret", "0123456789abcdef0123")]


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1" * 200_000, "1 " * 200_000, "://" * 100_000, "a" * 100_000 + "://", "@" * 300_000):
        began = time.perf_counter()
        pii.spans(text)
        assert time.perf_counter() - began < 5


def test_report_and_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 (212) 555-0100", 31), (2, None, None), (3, "", 0), (1, "x", 1), (4, "é 10.0.0.1; 4111 1111 1111 1111", 0)], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.report(docs).collect()}
    assert got == {(1, "email:5:11,phone:15:32", 1, 0, 0, 1), (2, "", 0, 0, 0, 0), (3, "", 0, 0, 0, 0), (1, "", 0, 0, 0, 0), (4, "ip:2:10,card:12:31", 0, 1, 1, 0)}
    assert {r.base_sha256 for r in pii.report(docs).where("doc_id = 3").collect()} == {hashlib.sha256(b"").hexdigest()}
    out = {(r.doc_id, r.text, r.n_chars) for r in pii.redacted(docs).collect()}
    assert out == {(1, "mail [EMAIL] or [PHONE]", 23), (2, None, None), (3, "", 0), (1, "x", 1), (4, "é [IP]; [CARD]", 14)}
    assert pii.report(docs.where("false")).count() == 0
