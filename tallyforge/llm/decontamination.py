"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its documents into shards of bounded size, sorts every word
suffix of a shard (prefix doubling on word ranks, as deep as the longest
benchmark item), and binary-searches every suffix of every benchmark item: the
interval narrows by one word at a time, which gives its longest verbatim match
and where the matches are. A document lies whole in one shard, so nothing is
shuffled. Benchmark items reach the tasks in blocks of bounded size; more items
mean more blocks, not a larger broadcast, and each shard is searched for all blocks
in one pass, so every input row gives one output row.

Defined results: null and empty texts have no words and are never hit; items
without words match nothing; very long texts are a shard of their own; repeated
rows and repeated or null doc_ids are each marked; items of one item_id count
once; an empty table gives no rows, an empty benchmark no hits; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import NOT_ALNUM, chunks, hash_words, tidy, utf8, words

WINDOW = 10
#: Characters of benchmark text in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 4 << 20


class Queries:
    """The suffixes of a block of benchmark items, as word hashes."""

    def __init__(self, ids: list[int], hashes: np.ndarray, row: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        self.hashes = hashes
        n = len(self.hashes)
        count = np.bincount(row, minlength=len(ids))
        self.ids = ids
        self.item = row
        #: Words from each suffix to the end of its item.
        self.left = np.cumsum(count)[row] - np.arange(n)
        #: Matched words that make a window, for the suffixes that begin one.
        self.need = np.minimum(count[row], window)
        self.begins = self.left >= self.need
        self.deepest = int(self.left.max(initial=0))


def hashed(ids: list[int], texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The items' word hashes and the item of each."""
    buf, at = utf8(pa.array(texts, pa.string()))
    starts, ends, row = words(buf, at, NOT_ALNUM)
    return ids, hash_words(buf, starts, ends), row


class SuffixArray:
    """All word suffixes of a shard in order, as far as ``depth`` words tell them apart."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, rows: int, depth: int) -> None:
        n = len(hashes)
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        # Word 0 ends each document, so no match crosses its end.
        count = np.bincount(row, minlength=rows)
        self.words = np.zeros(n + rows, np.int64)
        self.words[np.arange(n) + row] = rank + 1
        self.ends = np.cumsum(count) + np.arange(rows)
        key = self.words
        self.order = np.argsort(key)
        step = 1
        while step < depth:
            ahead = np.zeros_like(key)
            ahead[:-step] = key[step:]
            both = key * (int(key.max(initial=0)) + 1) + ahead
            both[self.words == 0] = 0
            self.order = np.argsort(both)
            ranked = both[self.order]
            fresh = np.zeros_like(key)
            np.cumsum(ranked[1:] != ranked[:-1], out=fresh[1:])
            if fresh[-1] == n:
                break  # all suffixes differ
            key = np.empty_like(key)
            key[self.order] = fresh
            step *= 2

    def search(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match of each suffix of ``q`` in words; the interval of ``order`` at its window's depth (empty: none)."""
        n = len(q.hashes)
        longest = np.zeros(n, np.int64)
        from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.vocabulary):
            return longest, from_, to
        found = np.minimum(np.searchsorted(self.vocabulary, q.hashes), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[found] == q.hashes, found + 1, -1)
        alive = np.arange(n)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        padded = np.concatenate([self.words, np.zeros(q.deepest + 1, np.int64)])
        for depth in range(q.deepest):
            alive = alive[q.left[alive] > depth]
            want = word[alive + depth]
            alive, want = alive[want > 0], want[want > 0]
            if not len(alive):
                break
            a = self._bound(padded, low[alive], high[alive], depth, want)
            b = self._bound(padded, a, high[alive], depth, want + 1)
            hit = b > a
            alive = alive[hit]
            low[alive], high[alive] = a[hit], b[hit]
            longest[alive] = depth + 1
            done = alive[q.begins[alive] & (q.need[alive] == depth + 1)]
            from_[done], to[done] = low[done], high[done]
        return longest, from_, to

    def _bound(self, padded: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        """The first place in each interval whose word at ``depth`` is at least ``want``."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            less = padded[self.order[mid] + depth] < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low


def _covered(ranges: list[list[int]]) -> list[list[int]]:
    """The ranges (end exclusive) in order, with those that touch merged."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


class Found:
    """What a shard's documents hold: ranges of words that are hit, items, and the longest match of a found item's suffixes."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, rows: int, depth: int) -> None:
        self.ranges: list[list[list[int]]] = [[] for _ in range(rows)]
        self.items: list[set[str]] = [set() for _ in range(rows)]
        self.longest = np.zeros(rows, np.int64)
        self.array = SuffixArray(hashes, row, rows, depth)

    def add(self, q: Queries) -> None:
        """Searches every suffix of a block of items."""
        array = self.array
        longest, low, high = array.search(q)
        sizes = high - low
        if not sizes.any():
            return
        which = np.repeat(np.arange(len(sizes)), sizes)
        at = array.order[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)]
        doc = np.searchsorted(array.ends, at, "left")
        np.maximum.at(self.longest, doc, longest[which])
        pairs = np.unique(doc * len(q.ids) + q.item[which])
        for d, i in zip((pairs // len(q.ids)).tolist(), (pairs % len(q.ids)).tolist(), strict=True):
            self.items[d].add(str(q.ids[i]))
        begin = np.concatenate([[0], array.ends[:-1] + 1])[doc]
        for d, s, e in zip(doc.tolist(), (at - begin).tolist(), (at - begin + q.need[which]).tolist(), strict=True):
            self.ranges[d].append([s, e])
        for d in np.unique(doc).tolist():
            self.ranges[d] = _covered(self.ranges[d])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items that have text, in blocks of about ``block_bytes``; each item is in one block."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if ids and size + len(r.text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


class Sent:
    """The blocks of a benchmark, sent to the tasks. The driver and a task hold one at a time, however many there are."""

    def __init__(self, benchmark: DataFrame, window: int, block_bytes: int) -> None:
        sc = benchmark.sparkSession.sparkContext
        self.window, self.depth, self.parts = window, 0, []
        for block in _blocks(benchmark, block_bytes):
            packed = hashed(*block)
            self.depth = max(self.depth, Queries(*packed, window).deepest)
            self.parts.append(sc.broadcast(packed))
        self._only: Queries | None = None

    def blocks(self) -> Iterator[Queries]:
        if self._only is not None:
            yield self._only
            return
        for part in self.parts:
            q = Queries(*part.value, self.window)
            if len(self.parts) == 1:
                self._only = q
            vars(part).pop("_value", None)  # read again from the executor's disk when it is needed again
            yield q

    def search(self, batch: pa.RecordBatch) -> tuple[Found, np.ndarray]:
        """What the batch's texts hold of all blocks, and their numbers of words. The suffix array is built once."""
        buf, at = utf8(batch.column("text"))
        starts, ends, row = words(buf, at, NOT_ALNUM)
        found = Found(hash_words(buf, starts, ends), row, batch.num_rows, self.depth)
        for q in self.blocks():
            found.add(q)
        return found, np.bincount(row, minlength=batch.num_rows).astype(np.int64)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, ranges of hit words (end exclusive), items found (strings, sorted) and longest match."""
    sent = Sent(benchmark, window, block_bytes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            found, n_words = sent.search(batch)
            columns = [batch.column("doc_id"), pa.array(n_words), pa.array(found.ranges, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(i) for i in found.items], pa.list_(pa.string())), pa.array(found.longest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "ranges", "items", "longest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, ranges array<array<long>>, items array<string>, longest long")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``matches`` with the digest columns: n_hit, n_items, items_sha256, contaminated."""
    found = matches(docs, benchmark, window, block_bytes)
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + r[1] - r[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"), "longest")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of any benchmark item, with all their columns."""
    sent = Sent(benchmark, window, block_bytes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            yield batch.filter(pa.array([not r for r in sent.search(batch)[0].ranges], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
