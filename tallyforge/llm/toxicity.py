"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (letters, A-Z in lower case) and their prefixes of 4 to 6 letters.
All terms that a share FLOOR of the examples holds are indexed; labels play no part in which.
Vectors are L2-normalised (1 + log tf) * idf ** POWER, with the document frequency
of all labelled texts as the sample estimates it, so what a text shares with all
others weighs little; the rest of a text's words lie outside the index. The
examples stand in an inverted index whose postings are cut into blocks of BLOCK
examples that keep their largest weight: a search scores the blocks with the
highest bounds, then all whose bound reaches the k-th best so far, so neighbours
are exact. Their similarity-weighted votes, corrected for the sampling rate of
each class and calibrated on leave-one-out votes of the examples, give the score.

The examples are a bounded sample (MAX_TOXIC, MAX_CLEAN: the smallest hashes of
the text in each class) of the labelled texts that aren't held out. All documents
are scored, on whole texts. Only a text decides its score: examples of the same
text are left out of its vote, and ties go by the example's text hash.

Defined results: null and empty texts, and texts without indexed terms, score the
toxic rate of such examples; no labels at all score 0; a text labelled 0 and 1,
under one id or several, is a toxic example; labels other than 0 and 1 don't
count; repeated rows and repeated or null ids are scored alike; very long texts
are scored whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import U64, checkpointed, chunks, hash_words, splitmix, tidy, utf8, words

#: The bound of the sample of labelled rows. More toxic ones validated no better, fewer clean ones worse.
MAX_TOXIC, MAX_CLEAN = 1024, 3072
#: Chosen by validation on parts of the rows that labels may be learned from: the share of examples that holds an indexed term, power of idf, neighbours.
FLOOR, POWER, NEIGHBOURS = 1 / 120, 2, 32
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Examples of a block, blocks scored at first, postings of a short list, queries searched at a time, and what single precision may be off by.
BLOCK, FIRST_BLOCKS, SHORT, QUERIES, SLACK = 64, 8, 400, 256, 1e-5
EVIDENCE = 3

#: Terms and their weights.
Vector = tuple[np.ndarray, np.ndarray]

#: Bytes that separate words: all of ASCII but letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term hash and how often, of each term of each text; by row, then hash."""
    buf, at = utf8(column)
    starts, ends, row = words(buf, at, NOT_LETTER)
    hashes = hash_words(buf, starts, ends)
    word, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    pair, n = np.unique(row * max(1, len(word)) + which, return_counts=True)
    row, which = pair // max(1, len(word)), pair % max(1, len(word))
    rows, keys, counts = [row], [word[which]], [n]
    # Prefixes are taken once for each distinct word.
    starts, ends = starts[one], ends[one]
    letter = np.flatnonzero((buf & 0xC0) != 0x80)
    first, last = np.searchsorted(letter, starts), np.searchsorted(letter, ends)
    for size in PREFIXES:
        long = last - first > size
        prefix = np.zeros(len(word), U64)
        prefix[long] = splitmix(hash_words(buf, starts[long], letter[first[long] + size]) + U64(size))
        some = long[which]
        rows.append(row[some])
        keys.append(prefix[which[some]])
        counts.append(n[some])
    row, key, n = (np.concatenate(x) for x in (rows, keys, counts))
    order = np.lexsort((key, row))
    row, key, n = row[order], key[order], n[order]
    fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    return row[fresh], key[fresh], np.add.reduceat(n, fresh) if len(fresh) else n


class Vocabulary:
    """Indexed terms by hash, and their idf."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.idf = np.log((n + 1) / (df[order] + 1)) ** POWER

    def vectors(self, column: pa.Array) -> list[Vector]:
        """Each text's indexed terms and their normalised weights."""
        row, key, n = terms(column)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        row, at, n = row[known], at[known], n[known]
        weight = (1 + np.log(n)) * self.idf[at]
        cut = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            norm = np.sqrt((weight[a:b] ** 2).sum())
            out.append((at[a:b], weight[a:b] / norm) if norm > 0 else (at[:0], weight[:0]))
        return out


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Exact top-k inner products of sparse non-negative vectors.

    Lists of at most SHORT postings are added up as they are. Longer ones are
    kept by blocks of vectors, with the largest weight of each term in each block;
    a block is scored for the queries whose bound there, with what the short lists
    gave, reaches their k-th best.
    """

    def __init__(self, vectors: list[Vector], n_terms: int) -> None:
        size = np.array([len(t) for t, _ in vectors], np.int64)
        self.n = len(vectors)
        self.term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int32)
        self.weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        self.first, self.size = np.cumsum(size) - size, size
        self.n_terms, self.n_blocks = n_terms, -(-self.n // BLOCK)

    def __getstate__(self) -> dict:
        return {c: x for c, x in vars(self).items() if c not in ("long", "most", "place", "listed", "vector", "posted")}

    def _built(self) -> None:
        """The postings; made where they are used, so that only the vectors are sent."""
        if hasattr(self, "long"):
            return
        df = np.bincount(self.term, minlength=self.n_terms)
        vector = np.repeat(np.arange(self.n), self.size)
        #: Where each term stands among the long ones, or -1.
        self.place = np.full(self.n_terms, -1)
        often = np.flatnonzero(df > SHORT)
        self.place[often] = np.arange(len(often))
        self.long = np.zeros((self.n_blocks, len(often), BLOCK), np.float32)
        at = self.place[self.term]
        self.long[vector[at >= 0] // BLOCK, at[at >= 0], vector[at >= 0] % BLOCK] = self.weight[at >= 0]
        self.most = self.long.max(axis=2).T if self.n_blocks else np.zeros((len(often), 0), np.float32)
        seldom = np.flatnonzero(at < 0)
        seldom = seldom[np.argsort(self.term[seldom], kind="stable")]
        self.listed = np.searchsorted(self.term[seldom], np.arange(self.n_terms + 1))
        self.vector, self.posted = vector[seldom], self.weight[seldom]

    def search(self, queries: list[Vector], k: int, without: list[np.ndarray] | None = None) -> list[Vector]:
        """For each query vectors and scores of at least the k best with a positive score, ties at the k-th place included; those in its ``without`` take no part."""
        self._built()
        out: list[Vector] = []
        for s in range(0, len(queries), QUERIES):
            out += self._search(queries[s : s + QUERIES], k, without[s : s + QUERIES] if without else None)
        return out

    def _search(self, queries: list[Vector], k: int, without: list[np.ndarray] | None) -> list[Vector]:
        n, width = len(queries), self.n_blocks * BLOCK
        score = np.zeros((n, width), np.float32)
        dense = np.zeros((n, self.long.shape[1]), np.float32)
        for r, (t, w) in enumerate(queries):
            at = self.place[t]
            dense[r, at[at >= 0]] = w[at >= 0]
            t, w = t[at < 0], w[at < 0]
            size = self.listed[t + 1] - self.listed[t]
            post = _spread(self.listed[t], size)
            score[r] = np.bincount(self.vector[post], np.repeat(w, size) * self.posted[post], width)
        blocks = score.reshape(n, self.n_blocks, BLOCK)
        bound = (dense @ self.most + blocks.max(axis=2, initial=0)) * (1 + 1e-4)
        done = np.zeros((n, self.n_blocks), bool)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        todo = np.zeros_like(done)
        np.put_along_axis(todo, first, True, axis=1)
        for last in (False, True):
            if last:
                todo = ~done & (bound >= np.maximum(self._least(blocks, done, k, without), 0)[:, None]) & (bound > 0)
            for b in np.flatnonzero(todo.any(axis=0)).tolist():
                some = np.flatnonzero(todo[:, b])
                blocks[some, b] += dense[some] @ self.long[b]
            done |= todo
        least = self._least(blocks, done, k, without)
        out, full = [], np.zeros(self.n_terms)
        for r, (t, w) in enumerate(queries):
            near = np.flatnonzero(np.where(done[r, :, None], blocks[r], -1).ravel()[: self.n] >= max(least[r] - SLACK, 1e-9))
            full[t] = w
            at = _spread(self.first[near], self.size[near])
            exact = np.add.reduceat(np.append(full[self.term[at]] * self.weight[at], 0), np.cumsum(self.size[near]) - self.size[near]) if len(near) else np.zeros(0)
            full[t] = 0
            if len(near) > k:
                best = exact >= np.partition(exact, len(exact) - k)[len(exact) - k] - 1e-12
                near, exact = near[best], exact[best]
            out.append((near[exact > 0], exact[exact > 0]))
        return out

    def _least(self, blocks: np.ndarray, done: np.ndarray, k: int, without: list[np.ndarray] | None) -> np.ndarray:
        """Each query's k-th best among the scored blocks; 0 where there are fewer."""
        if without:
            for r, none in enumerate(without):
                blocks[r].reshape(-1)[none] = -1
        seen = np.where(done[:, :, None], blocks, -1).reshape(len(blocks), -1)
        if seen.shape[1] < k:
            return np.zeros(len(blocks))
        return np.maximum(np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k], 0)


class Model:
    """The index of labelled examples and the calibration of its votes."""

    def __init__(self, vocabulary: Vocabulary, examples: list[tuple[int, int, int | None, Vector]], totals: tuple[int, int]) -> None:
        """examples: (text hash, label, a doc_id for evidence, vector); totals: clean and toxic labelled texts they were drawn from."""
        examples = sorted(examples, key=lambda x: x[0])
        drawn = [sum(y == z for _, y, *_ in examples) for z in (0, 1)]
        self.weight = np.array([totals[y] / drawn[y] if drawn[y] else 0.0 for y in (0, 1)])
        self.prior = totals[1] / max(1, sum(totals))
        self.vocabulary = vocabulary
        # Neighbours in the index share their heaviest term, which keeps the blocks' bounds low.
        top = lambda v: int(v[0][np.argmax(v[1])]) if len(v[0]) else -1
        examples.sort(key=lambda x: top(x[3]))
        self.hashes = np.array([x[0] for x in examples], np.int64)
        self.labels = np.array([x[1] for x in examples], np.int64)
        self.docs = [x[2] for x in examples]
        self.index = BlockMaxIndex([x[3] for x in examples], len(vocabulary.keys))
        self._calibrate([(x[0], x[1], x[3]) for x in examples])

    def votes(self, hashes: list[int], vectors: list[Vector]) -> list[tuple[float, list[tuple[int | None, float]]]]:
        """Each text's vote of the nearest examples of other texts, and the nearest as evidence."""
        sorter = np.argsort(self.hashes)
        low, high = (np.searchsorted(self.hashes[sorter], hashes, side) for side in ("left", "right"))
        out = []
        for found, score in self.index.search(vectors, NEIGHBOURS, [sorter[a:b] for a, b in zip(low, high, strict=True)]):
            order = np.lexsort((self.hashes[found], -np.round(score, 12)))[:NEIGHBOURS]
            found, score = found[order], score[order]
            weight = score * self.weight[self.labels[found]]
            pull = self.weight.max()
            vote = (float(weight[self.labels[found] == 1].sum()) + pull * self.prior) / (float(weight.sum()) + pull)
            out.append((vote, [(self.docs[i], s) for i, s in zip(found[:EVIDENCE].tolist(), score[:EVIDENCE].tolist(), strict=True)]))
        return out

    def _calibrate(self, examples: list[tuple[int, int, Vector]]) -> None:
        none = [0.0, 0.0]
        for _, y, v in examples:
            none[y] += 0.0 if len(v[0]) else float(self.weight[y])
        some = [x for x in examples if len(x[2][0])]
        votes = [(vote, y) for (vote, _), (_, y, _) in zip(self.votes([h for h, *_ in some], [v for *_, v in some]), some, strict=True)]
        self.without = (none[1] + self.prior) / (sum(none) + 1)
        # Pool adjacent violators over (vote, label), weighted by class.
        pools: list[list[float]] = []
        for x, y in sorted(votes):
            w = float(self.weight[y])
            pools.append([w * x, w * y, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = [p[0] / p[2] for p in pools]
        self.rate = [(p[1] + self.prior) / (p[2] + 1) for p in pools]

    def calibrated(self, vote: float) -> float:
        """Between the pools' rates; the vote itself moves the score by up to a hundredth, which keeps its order in a pool."""
        rate = float(np.interp(vote, self.at, self.rate)) if self.at else self.prior
        return min(1.0, max(0.0, 0.99 * rate + 0.01 * vote))

    def scores(self, hashes: list[int], column: pa.Array) -> list[tuple[float, list[tuple[int | None, float]]]]:
        """Score and evidence of each text; equal texts are looked up once."""
        some = {h: v for h, v in zip(hashes, self.vocabulary.vectors(column), strict=True) if len(v[0])}
        known = {h: (self.calibrated(vote), evidence) for h, (vote, evidence) in zip(some, self.votes(list(some), list(some.values())), strict=True)}
        return [known.get(h, (self.without, [])) for h in hashes]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled texts that aren't held out, from at most MAX_TOXIC and MAX_CLEAN of them."""
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.select("doc_id", _text_hash().alias("h")).join(usable, "doc_id").groupBy("h").agg(F.max("toxic").alias("label"), F.min("doc_id").alias("doc_id"))
    hashed = checkpointed(hashed)
    totals = {r.label: r.n for r in hashed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    drawn = [r for y, n in ((0, MAX_CLEAN), (1, MAX_TOXIC)) for r in hashed.where(F.col("label") == y).orderBy("h").limit(n).collect()]
    sent = docs.sparkSession.createDataFrame([(r.h, int(r.label), r.doc_id) for r in drawn], "h long, label int, doc_id long")  # at most MAX_TOXIC + MAX_CLEAN
    rows = checkpointed(docs.select(_text_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sent), "h").dropDuplicates(["h"]))

    rate = np.array([totals.get(y, 0) / max(1, sum(r.label == y for r in drawn)) for y in (0, 1)])

    @tidy
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, key, _ = terms(batch.column("text"))
            label = batch.column("label").to_numpy()
            term, which, n = np.unique(key, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n), pa.array(np.bincount(which, rate[label[row]], len(term)))], ["term", "n", "df"])

    df = rows.select("label", "text").mapInArrow(held, "term long, n long, df double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("n") >= max(2, FLOOR * len(drawn))).toArrow()
    vocabulary = Vocabulary(df["term"].to_numpy().view(U64), df["df"].to_numpy(), sum(totals.values()))

    @tidy
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            each = vocabulary.vectors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), batch.column("doc_id"), pa.array([t.astype(np.int32) for t, _ in each], pa.list_(pa.int32())), pa.array([w for _, w in each], pa.list_(pa.float64()))], ["h", "label", "doc_id", "terms", "weights"])

    found = rows.mapInArrow(vectors, "h long, label int, doc_id long, terms array<int>, weights array<double>").toArrow()
    lists = lambda c, t: [np.asarray(x.values, t) for x in found[c]]
    return Model(vocabulary, list(zip(found["h"].to_pylist(), found["label"].to_pylist(), found["doc_id"].to_pylist(), zip(lists("terms", np.int64), lists("weights", float), strict=True), strict=True)), (totals.get(0, 0), totals.get(1, 0)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and evidence (nearest examples with their similarity)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            out = model.value.scores(batch.column("h").to_pylist(), batch.column("text")) if model.value else [(0.0, [])] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array([",".join(f"{d}:{s:.4f}" for d, s in e) for _, e in out], pa.string())], ["doc_id", "score", "evidence"])

    found = docs.select("doc_id", "text", _text_hash().alias("h")).mapInArrow(run, "doc_id long, score double, evidence string")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    h = "h" + "_" * max(map(len, names))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            if model.value:
                keep = [s < THRESHOLD for s, _ in model.value.scores(batch.column(h).to_pylist(), batch.column("text"))]
                batch = batch.filter(pa.array(keep, pa.bool_()))
            yield batch.select(names)

    return docs.withColumn(h, _text_hash()).mapInArrow(run, docs.schema)
