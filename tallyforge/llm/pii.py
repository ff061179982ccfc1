"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, schemes
and identifier cues. At each anchor a local parser expands to the boundaries of
an email, an IP address, a card, a phone number, a URL with credentials, a
bank account or a secret, and validates it. Every parser is linear in what it
reads, and starts again only after the end of what it read.

Kinds: the base kinds ``email ip card phone``, leftmost and non-overlapping for
each kind, then ``login`` (a URL with user information), ``iban`` (after a cue,
check digits hold) and ``secret`` (a quoted or bare value after a cue).

Defined results: null and empty texts have no spans; offsets count code points,
ends are exclusive; extra columns pass through ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.common import chunks, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "secret")
#: Identifier cues, found in lower, upper and title case.
IBAN_CUES = ("iban",)
SECRET_CUES = ("api_key", "apikey", "passwd", "password", "secret", "token")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"[\x20().0-9-]*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_IBAN = re.compile(r"[\s:=#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_SECRET = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/=.-]{16,})")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for d in "0123456789":
        out.add_word(d, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    out.add_word("://", ("scheme", 3))
    for what, cues in (("iban", IBAN_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                out.add_word(form, (what, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def spans(text: str) -> list[Span]:
    """All spans, by kind as KINDS lists them, then by start."""
    found: list[Span] = []
    done = dict.fromkeys(KINDS, 0)
    card_end = ip_end = 0
    for last, (what, size) in anchors().iter(text):
        end = last + 1
        if what == "digit":
            if last >= card_end:
                card_end = _DIGITS.match(text, last).end()
                if card_end - last >= 16:
                    digits = text[last:card_end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", last, card_end))
            if last >= ip_end:
                m = _DOTTED.match(text, last)
                ip_end = m.end()
                if ip_end - last >= 7:
                    parts, at = m[0].split("."), last
                    for k in range(0, len(parts) - 3, 4):
                        stop = at + sum(map(len, parts[k : k + 4])) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                            found.append(("ip", at, stop))
                        at = stop + 1
        elif what == "at":
            start = last
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, end)):
                found.append(("email", start, m.end()))
                done["email"] = m.end()
            else:
                done["email"] = end
        elif what == "plus":
            if text[end : end + 1].isascii() and text[end : end + 1].isdigit():
                stop = _DIALLED.match(text, end + 1).end()
                while stop > end + 1 and not (text[stop - 1].isdigit()):
                    stop -= 1
                if stop > end + 2 and 8 <= sum(c.isdigit() for c in text[end:stop]) <= 15:
                    found.append(("phone", last, stop))
        elif what == "scheme":
            if m := _LOGIN.match(text, end):
                start = end - size
                while start > done["login"] and text[start - 1] in _SCHEME:
                    start -= 1
                if start < end - size:
                    found.append(("login", start, m.end()))
                    done["login"] = m.end()
        elif what == "iban":
            if end - size >= done["iban"] and (m := _IBAN.match(text, end)):
                run = m[1]
                for n in range(len(run), 14, -1):  # at most 20 lengths: the run holds at most 34 letters and as many spaces
                    if run[n - 1] != " " and iban(run[:n]):
                        found.append(("iban", m.start(1), m.start(1) + n))
                        done["iban"] = m.start(1) + n
                        break
        elif what == "secret" and end - size >= done["secret"] and (m := _SECRET.match(text, end)):
            value = m[1]
            if any(c.isdigit() for c in value):
                found.append(("secret", m.start(1), m.end(1)))
                done["secret"] = m.end(1)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (order[s[0]], s[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str) -> str:
    """The text with each span (those that overlap merged, named by the first) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256 and spans."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [spans(t) if t else [] for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; null texts stay null; an ``n_chars`` column follows the new text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [redact(t) if t else t for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(n, batch.schema.field(n), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
