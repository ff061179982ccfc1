"""Context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, then an end byte.
Each byte is eight binary decisions, and each decision has a context tree of its
own over the preceding bytes. A node's estimate is Krichevsky-Trofimov's; with
weight one half it mixes with the product of its children, from DEPTH bytes back
to none, so the probability of a byte mixes the estimates of all depths by
weights that the training counts set. Every context of the training texts is a
node: nothing is pruned or pooled, and the tree grows with the input.

The tree never stands in one place. Documents are read once, into parts of
bounded size; a part asks for the (DEPTH + 1)-grams and words it holds, with how
often its training texts hold them. The questions are dealt by the last UNIT
bytes of context, so that whole subtrees meet in one task, which adds them up and
weighs them. Only the sums over subtrees of the contexts shorter than UNIT bytes
(at most 256 ** (UNIT - 1) contexts of 255 decisions) reach the driver; what it
makes of them goes back with the second pass, which answers each part with
the log probability of its grams. A part's texts then meet its answers.

Defined results: null and empty texts are the end alone; very long texts are
scored whole, as a part of their own; no training text gives an untrained tree
(8 bits a byte) and c = 0 for all tokens; a gram that training lacks is predicted
by its longest known context; repeated rows and repeated or null ids are scored
alike, one row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACES, U64, chunks, hash_words, own_folder, tidy, utf8, whole_groups, words

DEPTH = 5
UNIT = 3
SPACE, END = 0x20, 0x0A
#: Text bytes, and distinct grams, that fill a part.
PART_BYTES, PART_GRAMS = 64 << 20, 4 << 20
#: Grams that a task weighs at a time; subtrees are kept whole.
WEIGHED = 400_000
GRAM, WORD, TEXTS, ENDS = 0, 1, 2, 3
_ASKED = "kind byte, part long, unit long, keys array<int>, hashes array<long>, n array<int>, texts binary"
_ANSWERED = "kind byte, part long, unit long, keys array<int>, hashes array<long>, log array<float>, count array<long>, texts binary"


def stream(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, ``depth`` end bytes before each, and where each text's own bytes start (rows + 1 places)."""
    lengths = ends - starts
    size = lengths + 1
    own = np.bincount(row, weights=size, minlength=rows).astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(own + depth)]) + depth
    out = np.full(int(first[-1]) - depth, END, np.uint8)
    if len(starts):
        to = np.cumsum(size) - size + row * (depth + 1) + depth
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at + np.repeat(to, lengths)] = buf[at + np.repeat(starts, lengths)]
        out[to + lengths] = SPACE
    return out, first


def grams(out: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """For each own byte of the texts its context, nearest byte highest, and the byte itself lowest."""
    key = out.astype(U64)
    for k in range(1, depth + 1):
        key[k:] |= out[:-k].astype(U64) << U64(8 * (depth + 1 - k))
    own = np.ones(len(out), bool)
    for k in range(1, depth + 1):
        own[first[:-1] - k] = False
    return key[own]


class Counts:
    """Counts by key: sorted arrays, merged when what came since outgrows them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh = self.settled = 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        """Counts the keys at which ``train`` holds; the others are noted with none."""
        for some, one in ((keys[train], 1), (keys[~train], 0)):
            if len(some):
                found, n = np.unique(some, return_counts=True)
                self.parts.append((found, n * one))
                self.fresh += len(found)
        if self.fresh > max(4 << 20, self.settled):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[at], np.add.reduceat(n, at))]
        self.fresh, self.settled = 0, len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def _rows(kind: int, part: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"unit": pa.int64(), "keys": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "n": pa.list_(pa.int32()), "texts": pa.binary()}
    every = {"kind": pa.array(np.full(n, kind, np.int8)), "part": pa.array(np.full(n, part, np.int64))} | {c: columns.get(c, pa.nulls(n, t)) for c, t in types.items()}
    return pa.RecordBatch.from_arrays(list(every.values()), list(every))


def _by_unit(kind: int, part: int, unit: np.ndarray, n: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each unit (sorted), in batches."""
    at = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
    cut = np.append(at, len(unit))
    for s in range(0, len(at), 4096):
        some = cut[s : s + 4097]
        listed = lambda x: pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(x[some[0] : some[-1]]))  # noqa: B023, E731
        yield _rows(kind, part, unit=pa.array(unit[some[:-1]].astype(np.int64)), n=listed(n.astype(np.int32)), **{c: listed(x) for c, x in values.items()})


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ask(batches: Iterator[pa.RecordBatch], depth: int, part_bytes: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    unit = min(UNIT, depth)
    low = U64(8 * (depth + 1 - unit))
    gram, word, ends, size = Counts(), Counts(), 0, 0

    def asked() -> Iterator[pa.RecordBatch]:
        keys, n = gram.merged()
        rest = (keys & ((U64(1) << low) - U64(1))).astype(np.uint32).view(np.int32)
        yield from _by_unit(GRAM, part, keys >> low, n, keys=rest)
        keys, n = word.merged()
        yield from _by_unit(WORD, part, keys >> U64(52), n, hashes=keys.view(np.int64))
        yield _rows(ENDS, part, n=pa.array([[ends]], pa.list_(pa.int32())))

    for batch in chunks(batches, "text", 2 << 20):
        rows = batch.num_rows
        buf, at = utf8(batch.column("text"))
        starts, stops, row = words(buf, at, SPACES)
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        word.add(hash_words(buf, starts, stops), train[row])
        out, first = stream(buf, starts, stops, row, rows, depth)
        gram.add(grams(out, first, depth), np.repeat(train, np.diff(first) - depth))
        ends += int(train.sum())
        size += len(buf)
        yield _rows(TEXTS, part, texts=pa.array([_packed(batch)], pa.binary()))
        if size > part_bytes or max(x.fresh + x.settled for x in (gram, word)) > 2 * PART_GRAMS:
            if size > part_bytes or max(len(x.merged()[0]) for x in (gram, word)) > PART_GRAMS:
                yield from asked()
                part += 1
                gram, word, ends, size = Counts(), Counts(), 0, 0
    if size or ends or gram.parts:
        yield from asked()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after a shift of 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)


class Level:
    """The nodes of one depth, for one of the eight decisions of a byte: key (context, then the byte's first bits), counts of zeros and ones.

    ``further`` is the sum of the children's log probabilities; none at the last depth.
    """

    def __init__(self, bits: int, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, further: np.ndarray | None) -> None:
        self.bits, self.key, self.zeros, self.ones = bits, key, zeros, ones
        own = _log_kt(zeros, ones)
        if further is None:
            self.log, self.share = own, np.ones(len(key))
        else:
            self.log = np.logaddexp(own, further) - np.log(2)
            self.share = np.exp(own - np.log(2) - self.log)
        self.gained = self.left = self.one = np.zeros(0)

    def parents(self) -> np.ndarray:
        """The key of each node's context less its farthest byte."""
        j = U64(self.bits)
        return self.key >> (j + U64(8)) << j | self.key & ((U64(1) << j) - U64(1))

    def above(self) -> Level:
        """The nodes one byte shorter."""
        up = self.parents()
        key, at = np.unique(up, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(key))
        return Level(self.bits, key, add(self.zeros), add(self.ones), add(self.log))

    def settle(self, gained: np.ndarray | float, left: np.ndarray | float) -> None:
        """Adds this depth to what the shorter contexts gave: the mixed probability of a one so far, and the weight that is left."""
        self.one = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        self.gained = gained + left * self.share * self.one
        self.left = left * (1 - self.share)


def leaves(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """The nodes of the last depth, for each of the eight decisions, from sorted grams and their counts."""
    out = []
    for j in range(8):
        key = keys >> U64(8 - j)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        bit = (keys >> U64(7 - j) & U64(1)).astype(bool)
        add = lambda x: np.add.reduceat(np.where(x, n, 0).astype(float), at) if len(at) else np.zeros(0)  # noqa: B023, E731
        out.append(Level(j, key[at], add(~bit), add(bit), None))
    return out


def subtrees(keys: np.ndarray, n: np.ndarray, depth: int) -> list[list[Level]]:
    """For each decision its levels from the contexts of UNIT bytes to those of ``depth``."""
    out = []
    for last in leaves(keys, n):
        found = [last]
        for _ in range(depth - min(UNIT, depth)):
            found.insert(0, found[0].above())
        out.append(found)
    return out


def _place(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key stands, and whether it does."""
    if not len(sorted_):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return at, sorted_[at] == asked


class Top:
    """The contexts shorter than UNIT bytes."""

    def __init__(self, depth: int, sums: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """sums: for each decision the keys, zeros, ones and summed logs of the contexts of UNIT - 1 bytes."""
        self.depth, self.unit = depth, min(UNIT, depth)
        self.levels: list[list[Level]] = []
        for j, (key, zeros, ones, log) in enumerate(sums):
            order = np.argsort(key)
            found = [Level(j, key[order], zeros[order], ones[order], log[order])]
            for _ in range(self.unit - 1):
                found.insert(0, found[0].above())
            self._settle(found, 0.0, 1.0)
            self.levels.append(found)

    @staticmethod
    def _settle(found: list[Level], gained: np.ndarray | float, left: np.ndarray | float) -> None:
        for k, level in enumerate(found):
            if k:
                at, _ = _place(found[k - 1].key, level.parents())
                gained, left = found[k - 1].gained[at], found[k - 1].left[at]
            level.settle(gained, left)

    def log10(self, trained: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each asked gram, from the sorted training grams of the same units."""
        out = np.zeros(len(asked))
        below = subtrees(trained, n, self.depth)
        for j, (top, sub) in enumerate(zip(self.levels, below, strict=True)):
            at, _ = _place(top[-1].key, sub[0].parents())
            some = len(top[-1].key) > 0
            self._settle(sub, top[-1].gained[at] if some else 0.0, top[-1].left[at] if some else 1.0)
            gained, left, one = np.zeros(len(asked)), np.ones(len(asked)), np.full(len(asked), 0.5)
            first = asked >> U64(8 - j) & ((U64(1) << U64(j)) - U64(1))
            for k, level in enumerate([*top, *sub]):
                context = asked >> U64(8 * (self.depth + 1 - k)) if k else np.zeros(len(asked), U64)
                at, known = _place(level.key, context << U64(j) | first)
                if len(level.key):
                    gained, left, one = (np.where(known, x[at], y) for x, y in ((level.gained, gained), (level.left, left), (level.one, one)))
            p = gained + left * one
            out += np.log10(np.where(asked >> U64(7 - j) & U64(1), p, 1 - p))
        return out


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The column's values and the row of each."""
    lists = table[column].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _gathered(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of the questions, how often training holds them, and which of them each question asks."""
    keys, row = _flat(table, "keys")
    low = U64(8 * (depth + 1 - min(UNIT, depth)))
    key = table["unit"].to_numpy().astype(U64)[row] << low | keys.view(np.uint32).astype(U64)
    every, which = np.unique(key, return_inverse=True)
    return every, np.bincount(which, weights=_flat(table, "n")[0], minlength=len(every)), which


def _dealt(asked: DataFrame, kind: int) -> DataFrame:
    return asked.where(F.col("kind") == kind).repartition("unit").sortWithinPartitions("unit")


def top(asked: DataFrame, depth: int = DEPTH) -> Top:
    """The shorter contexts, from the questions of all parts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", "keys", WEIGHED):
            every, n, _ = _gathered(table, depth)
            for j, levels in enumerate(subtrees(every[n > 0], n[n > 0], depth)):
                up = levels[0].above()  # its own counts are partial; they are added up by key
                at, _ = _place(up.key, levels[0].parents())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(up.key), j, np.int8)), pa.array(up.key.view(np.int64)), pa.array(up.zeros), pa.array(up.ones), pa.array(np.bincount(at, weights=levels[0].log, minlength=len(up.key)))], ["bits", "key", "zeros", "ones", "log"])

    part = _dealt(asked, GRAM).select("unit", "keys", "n").mapInArrow(run, "bits byte, key long, zeros double, ones double, log double")
    # At most 256 ** (UNIT - 1) contexts of 255 decisions.
    sums = part.groupBy("bits", "key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log"))).toArrow()
    bits = sums["bits"].to_numpy()
    columns = [sums["key"].to_numpy().view(U64), *(sums[c].to_numpy() for c in ("zeros", "ones", "log"))]
    return Top(depth, [tuple(c[bits == j] for c in columns) for j in range(8)])


def _answer(table: pa.Table, **values: np.ndarray) -> pa.RecordBatch:
    """The questions with ``values``, one for each key."""
    table = table.combine_chunks()
    n = table.num_rows
    types = {"keys": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "log": pa.list_(pa.float32()), "count": pa.list_(pa.int64()), "texts": pa.binary()}
    columns = {c: table[c].combine_chunks() for c in table.column_names if c != "n"}
    cut = np.concatenate([[0], np.cumsum(columns["keys" if "keys" in columns else "hashes"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    columns |= {c: pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for c, x in values.items()}
    names = ["kind", "part", "unit", *types]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[c]) for c in names], names)


def _answers(asked: DataFrame, model: Top) -> DataFrame:
    """Each part's grams with their log10 probability."""
    sent = asked.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", "keys", WEIGHED):
            every, n, which = _gathered(table, sent.value.depth)
            yield _answer(table, log=sent.value.log10(every[n > 0], n[n > 0], every).astype(np.float32)[which])

    return _dealt(asked, GRAM).select("kind", "part", "unit", "keys", "n").mapInArrow(run, _ANSWERED)


def _word_answers(asked: DataFrame) -> DataFrame:
    """Each part's words with their count in training; rows without part tell how many words there are, and how many times in all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", "hashes", WEIGHED):
            every, which = np.unique(_flat(table, "hashes")[0], return_inverse=True)
            n = np.bincount(which, weights=_flat(table, "n")[0], minlength=len(every)).astype(np.int64)
            out = _answer(table, count=n[which])
            yield out
            total = {"kind": pa.array([WORD], pa.int8()), "count": pa.array([[int((n > 0).sum()), int(n.sum())]], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([total.get(f.name, pa.nulls(1, f.type)) for f in out.schema], out.schema.names)

    return _dealt(asked, WORD).select("kind", "part", "unit", "hashes", "n").mapInArrow(run, _ANSWERED)


class Known:
    """Values by 64-bit key, in a table of open addressing; for keys that aren't there, 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = U64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.keys, self.values = np.zeros(1 << (64 - int(self.shift)), U64), np.zeros(1 << (64 - int(self.shift)), values.dtype)
        self.mask = len(self.keys) - 1
        keys = keys + U64(1)  # 0 marks a free place
        at, todo = self._first(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & self.mask
        self.values[at] = values

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys + U64(1)
        at = self._first(keys)
        todo = np.flatnonzero(self.keys[at] != keys)
        while len(todo):
            todo = todo[self.keys[at[todo]] != 0]
            at[todo] = at[todo] + 1 & self.mask
            todo = todo[self.keys[at[todo]] != keys[todo]]
        return np.where(self.keys[at] == keys, self.values[at], self.values.dtype.type(0))


def _score(batches: Iterator[pa.RecordBatch], depth: int, n_ends: int) -> Iterator[pa.RecordBatch]:
    """Answers of a part, then its texts -> doc_id, held_out, n_tokens, n_known, base, score, size."""
    low = U64(8 * (depth + 1 - min(UNIT, depth)))
    part = None
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}
    known: dict[int, Known] = {}
    for batch in batches:
        kinds, parts = batch.column("kind").to_numpy(), batch.column("part").to_numpy()
        cut = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(kinds)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if parts[a] != part:
                part, held, known = parts[a], {GRAM: [], WORD: []}, {}
            table = pa.Table.from_batches([batch.slice(a, b - a)])
            if kinds[a] == GRAM:
                keys, row = _flat(table, "keys")
                held[GRAM].append((table["unit"].to_numpy().astype(U64)[row] << low | keys.view(np.uint32).astype(U64), _flat(table, "log")[0]))
            elif kinds[a] == WORD:
                held[WORD].append((_flat(table, "hashes")[0].view(U64), _flat(table, "count")[0]))
            else:
                if not known:
                    none = {GRAM: np.float32, WORD: np.int64}
                    known = {k: Known(*(np.concatenate(x) for x in zip(*v, strict=True))) if v else Known(np.zeros(0, U64), np.zeros(0, none[k])) for k, v in held.items()}
                    held = {GRAM: [], WORD: []}
                for packed in table["texts"].to_pylist():
                    for docs in pa.ipc.open_stream(packed):
                        yield _scored(docs, known[GRAM], known[WORD], depth, n_ends)


def _scored(docs: pa.RecordBatch, gram: Known, word: Known, depth: int, n_ends: int) -> pa.RecordBatch:
    rows = docs.num_rows
    buf, at = utf8(docs.column("text"))
    starts, ends, row = words(buf, at, SPACES)
    count = word[hash_words(buf, starts, ends)]
    out, first = stream(buf, starts, ends, row, rows, depth)
    size = np.diff(first) - depth
    each = gram[grams(out, first, depth)].astype(float)
    score = np.add.reduceat(each, np.cumsum(size) - size) if rows else np.zeros(0)
    n_known = np.bincount(row, weights=count > 0, minlength=rows).astype(np.int64) + (n_ends > 0)
    base = np.bincount(row, weights=np.log10(count + 1.0), minlength=rows) + np.log10(n_ends + 1.0)
    columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(np.bincount(row, minlength=rows).astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(size)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "size"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def questions(docs: DataFrame, depth: int = DEPTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """What the parts of (doc_id, text, held_out) ask, with their packed texts; written once."""
    folder = own_folder(docs.sparkSession, "asked")
    docs.select("doc_id", "text", "held_out").mapInArrow(tidy(lambda batches: _ask(batches, depth, part_bytes)), _ASKED).write.parquet(folder)
    return docs.sparkSession.read.schema(_ASKED).parquet(folder)


def scored(docs: DataFrame, depth: int = DEPTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if not 1 <= depth <= 6:
        raise ValueError("a gram has to fit 56 bits: depth 1 to 6")
    spark = docs.sparkSession
    asked = questions(docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")), depth, part_bytes)
    parts = asked.where(F.col("kind") == ENDS).agg(F.coalesce(F.sum(F.element_at("n", 1).cast("long")), F.lit(0)).alias("n"), F.count("*").alias("parts")).first()
    n_ends = parts.n
    folder = own_folder(spark, "words")
    _word_answers(asked).write.parquet(folder)
    word = spark.read.schema(_ANSWERED).parquet(folder)
    total = word.where("part is null").agg(*(F.coalesce(F.sum(F.element_at("count", i)), F.lit(0)).alias(c) for i, c in ((1, "v"), (2, "n")))).first()
    n_train, v = total.n + n_ends, total.v + (n_ends > 0)
    texts = asked.where(F.col("kind") == TEXTS).select("kind", "part", *(F.lit(None).cast(t).alias(c) for c, t in (("unit", "long"), ("keys", "array<int>"), ("hashes", "array<long>"), ("log", "array<float>"), ("count", "array<long>"))), "texts")
    every = _answers(asked, top(asked, depth)).unionAll(word.where("part is not null")).unionAll(texts)
    # As many tasks as parts, so that a task's share doesn't grow with the input.
    every = every.repartition(max(1, parts.parts), "part").sortWithinPartitions("part", "kind")
    out = every.mapInArrow(tidy(lambda batches: _score(batches, depth, n_ends)), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, size long")
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n_train + v + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("size")).alias("bits_per_byte"))
