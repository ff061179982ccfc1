"""Token counts that follow edits.

A document's pre-tokens stand in blocks, and a segment tree over the blocks sums
their characters and tokens. An edit is found by descending the tree; only the
pre-tokens that it touches, and those whose match could have looked at it, are
split and encoded again, until a new boundary falls on an old one. Then the
block and the sums above it are updated, and the root is the document's count.

The split pattern may look LOOKAHEAD characters past a match; the pattern of the
public vocabularies looks at no more than two.

Defined results: null and empty texts are trees without leaves; an edit past the
end counts as at the end; equal rows give equal counts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.byte_bpe import REMEMBERED, Codec, codec
from tallyforge.llm.common import chunks, tidy

BLOCK = 64
LOOKAHEAD = 2


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, c: Codec) -> None:
        self.split = c.split
        self.codec = c
        self.known: dict[str, int] = {}

    def count(self, pretoken: str) -> int:
        n = self.known.get(pretoken)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = len(self.codec._ids(pretoken))
            if len(pretoken) < 64:
                self.known[pretoken] = n
        return n

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        return [n if (n := known.get(p)) is not None else self.count(p) for p in pretokens]


class TokenTree:
    """A document's pre-tokens with sums of characters and tokens."""

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter = counter
        #: Pre-tokens counted so far, the first time included.
        self.encoded = 0
        self._blocks_of(counter.split(text))

    def _blocks_of(self, pretokens: list[str]) -> None:
        counts = self.counter.counts(pretokens)
        self.encoded += len(pretokens)
        self.blocks = [pretokens[k : k + BLOCK] for k in range(0, len(pretokens), BLOCK)]
        self._build([sum(counts[k : k + BLOCK]) for k in range(0, len(counts), BLOCK)])

    def _build(self, tokens: list[int]) -> None:
        """The tree over the blocks: node 1 is the root, nodes 2i and 2i + 1 are below node i."""
        self.width = 1
        while self.width < len(self.blocks):
            self.width *= 2
        spare = [0] * (self.width - len(self.blocks))
        self.chars = [0] * self.width + [sum(map(len, b)) for b in self.blocks] + spare
        self.tokens = [0] * self.width + tokens + spare
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(b) for b in self.blocks)

    def _find(self, char: int) -> tuple[int, int, int]:
        """Block and place of the pre-token that holds a character, and where that pre-token starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for place, p in enumerate(self.blocks[block]):
            if char < start + len(p):
                return block, place, start
            start += len(p)
        raise IndexError(char)

    def _after(self, block: int, place: int) -> Iterator[str]:
        for b in range(block, len(self.blocks)):
            yield from self.blocks[b][place if b == block else 0 :]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces characters ``start`` to ``end`` (exclusive)."""
        size = self.n_chars
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not size:
            self._blocks_of(self.counter.split(replacement))
            return
        block, place, at = self._find(max(0, min(start - LOOKAHEAD, size - 1)))
        delta = len(replacement) - (end - start)
        old = self._after(block, place)
        window: list[str] = []
        upto = at
        reach = BLOCK // 8
        while True:
            last = False
            while upto < end + reach and not last:
                if (p := next(old, None)) is None:
                    last = True
                else:
                    window.append(p)
                    upto += len(p)
            last = last or upto == size
            joined = "".join(window)
            fresh = joined[: start - at] + replacement + joined[end - at :]
            cut = self._meet(window, fresh, at, end, delta, last)
            if cut:
                self._swap(block, place, *cut)
                return
            reach *= 2

    def _meet(self, window: list[str], fresh: str, at: int, end: int, delta: int, last: bool) -> tuple[int, list[str]] | None:
        """The old pre-tokens to replace and the new ones, up to the first boundary of both after the edit."""
        new = self.counter.split(fresh)
        safe = len(fresh) if last else len(fresh) - LOOKAHEAD
        i = j = 0
        x = y = at  # boundaries in old and in new characters, the latter shifted back by delta once past the edit
        while True:
            if x >= end and y - delta == x and y - at <= safe:
                return i, new[:j]
            if y - delta < x or y - delta < end:
                if j == len(new):
                    return (len(window), new) if last else None
                y += len(new[j])
                j += 1
            else:
                if i == len(window):
                    return (len(window), new) if last else None
                x += len(window[i])
                i += 1

    def _swap(self, block: int, place: int, n_old: int, new: list[str]) -> None:
        """Puts ``new`` in the place of ``n_old`` pre-tokens and updates the sums."""
        touched = [block]
        self.encoded += len(new)
        left = n_old
        mine = self.blocks[block]
        take = min(left, len(mine) - place)
        self.blocks[block] = mine[:place] + new + mine[place + take :]
        left -= take
        b = block + 1
        while left:
            take = min(left, len(self.blocks[b]))
            self.blocks[b] = self.blocks[b][take:]
            left -= take
            touched.append(b)
            b += 1
        if len(self.blocks[block]) > 4 * BLOCK:
            out, tokens = [], []
            for k, b in enumerate(self.blocks):
                if len(b) > 4 * BLOCK:
                    parts = [b[s : s + BLOCK] for s in range(0, len(b), BLOCK)]
                    out += parts
                    tokens += [sum(self.counter.counts(p)) for p in parts]
                elif b:
                    out.append(b)
                    tokens.append(sum(self.counter.counts(b)) if k in touched else self.tokens[self.width + k])
            self.blocks = out
            self._build(tokens)
            return
        for b in touched:
            node = self.width + b
            self.chars[node] = sum(map(len, self.blocks[b]))
            self.tokens[node] = sum(self.counter.counts(self.blocks[b]))
            while node > 1:
                node //= 2
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def recounted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts before and after the edits of ``docs(doc_id, text, edits)``.

    ``edits`` is an array of structs (start, end, text), applied in order, each
    to the text that the ones before it left. Returns doc_id, n_tokens, n_edits,
    n_chars_after, n_tokens_after and n_reencoded (pre-tokens counted for the edits).
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(codec(path, pattern))
        for batch in chunks(batches, "text"):
            rows = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree(counter, text or "")
                before, first = tree.n_tokens, tree.encoded
                for e in edits or []:
                    tree.edit(e["start"], e["end"], e["text"] or "")
                rows.append((before, len(edits or []), tree.n_chars, tree.n_tokens, tree.encoded - first))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_reencoded"])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_reencoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the ``edits`` column of ``recounted``, from rows (doc_id, seq, start, end, text)."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("found"))
    joined = docs.select("doc_id", "text").join(each, "doc_id", "left")
    return joined.select("doc_id", "text", F.transform(F.coalesce("found", F.array()), lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].alias("text"))).alias("edits"))


def editorial(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits each: a note put in the middle, a few characters replaced at a quarter, the last word cut off."""
    n = F.coalesce(F.length("text"), F.lit(0))
    note = "\nEditor's note: see 2nd ed.\n"
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    middle, quarter = F.floor(n / 2), F.floor(n / 4)
    return docs.select("doc_id", "text", F.array(edit(middle, middle, note), edit(quarter, quarter + 3, " [...]"), edit(F.greatest(n - 5, F.lit(0)) + len(note), n + len(note) + 6, "")).alias("edits"))
