"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has its own codebook; a vector's cell is its pair of
centroids. A query walks the pairs of centroids by the sum of two distances
(each the negated inner product with a half, as nearness is the inner product)
with a heap. The first cells, up to FIRST times k entries, are ranked by the exact
inner product; the k-th best of them then rules out every further cell whose bound
(the centroids' inner product and the cell's radii times the query's norms) is
below it. The walk ends when the cells it has passed hold SHARE of the distinct
vectors and k entries besides the query's own, or all are passed.

The codebooks are fitted on at most SAMPLE vectors (smallest hashes of vec_id) and
grow with the table (``centroids``); every vector is indexed. Entries are dealt once
a phase by groups of first-half centroids, large groups in chunks; queries go to
the groups they visit and stream past the entries there, each group giving its best
k for each query. Vectors with clusters need few cells; unclustered vectors of 64
dimensions need a large SHARE, and there no cell is ruled out.

Defined results: vectors that are null, zero, hold null or non-finite components,
or have no vec_id take no part; vectors of different lengths aren't compared, so
each length is an index of its own; ties go to the smaller vec_id; repeated
vectors are all entries, and rows of the query's own vec_id none; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed, tidy

SAMPLE = 20_000
SHARE = 0.6
FIRST = 8
#: Entries of a chunk, and queries that one task walks for.
ENTRIES, WALKED = 8192, 256


def centroids(n: int) -> int:
    """The size of each codebook for ``n`` vectors: a power of two near n ** 0.4, 64 at least and no more than SAMPLE vectors can tell apart."""
    return int(min(512, max(64, 2 ** round(0.4 * np.log2(max(2, n))))))


def codebook(half: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the rows, from evenly spaced rows as the start."""
    size = min(size, len(half))
    centres = half[np.linspace(0, len(half) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(half, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, half)
        count = np.bincount(near, minlength=size)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * half @ centres.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs of centroids by summed distance."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


class Index:
    """The codebooks and, by cell, its rows, distinct vectors and the radii of its halves: at most ``centroids`` ** 2 cells, whatever the table holds."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        self.one, self.two, self.cut = one, two, one.shape[1]
        self.shape = len(one), len(two)

    def cells(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both centroids of each vector, and the distances to them."""
        a, b = m[:, : self.cut], m[:, self.cut :]
        u, v = nearest(a, self.one), nearest(b, self.two)
        return u, v, np.sqrt(((a - self.one[u]) ** 2).sum(axis=1)), np.sqrt(((b - self.two[v]) ** 2).sum(axis=1))

    def fill(self, cells: list, share: float, k: int) -> None:
        self.rows, self.distinct = np.zeros(self.shape, np.int64), np.zeros(self.shape, np.int64)
        self.radius = np.zeros((2, *self.shape))
        for c in cells:
            self.rows[c.cu, c.cv], self.distinct[c.cu, c.cv] = c.n, c.distinct
            self.radius[:, c.cu, c.cv] = c.ru, c.rv
        self.want, self.k = float(share * self.distinct.sum()), k
        self.queries = sum(c.nq for c in cells)
        #: Rows, distinct vectors and radii as lists: the walk takes one cell at a time.
        self.listed = [x.tolist() for x in (self.rows, self.distinct, *self.radius)]
        held = self.rows.sum(axis=1)
        self.n_groups = max(1, min(self.shape[0], -(-int(held.sum()) // ENTRIES)))
        self.chunks = [max(1, -(-int(held[g :: self.n_groups].sum()) // ENTRIES)) for g in range(self.n_groups)]

    def plan(self, q: np.ndarray, least: float | None = None) -> list[tuple[int, int]]:
        """The cells to rank for a query: the first ones, or those after them whose bound reaches ``least``."""
        first, second = self.one @ q[: self.cut], self.two @ q[self.cut :]
        a, b = float(np.linalg.norm(q[: self.cut])), float(np.linalg.norm(q[self.cut :]))
        one, two = first.tolist(), second.tolist()
        rows, distinct, ru, rv = self.listed
        early_rows, begun = FIRST * self.k, least is not None
        out = []
        held = met = 0
        for u, v in walk(-first, -second):
            n = rows[u][v]
            if not n:
                continue
            early = met < early_rows
            if not begun:
                if not early:
                    break
                out.append((u, v))
            elif not early and one[u] + two[v] + a * ru[u][v] + b * rv[u][v] >= least - 1e-9:
                out.append((u, v))
            held += distinct[u][v]
            met += n
            if held >= self.want and met > self.k:
                break
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)).select("vec_id", e.cast("array<double>").alias("v"))


def best(q_ids: np.ndarray, q: np.ndarray, masks: np.ndarray, ids: np.ndarray, e: np.ndarray, u: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best entries among the cells of its masks (bit v of word u), its own rows left out."""
    out: tuple[list, list, list] = ([], [], [])
    word, bit = u * masks.shape[2] + v // 8, (np.uint8(1) << (v % 8).astype(np.uint8))
    masks = masks.reshape(len(masks), -1)
    for s in range(0, len(q), 256):
        score = q[s : s + 256] @ e.T
        score[(masks[s : s + 256][:, word] & bit == 0) | (q_ids[s : s + 256, None] == ids)] = -np.inf
        if len(ids) > k:
            least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            near = (score >= np.where(least > -np.inf, least - 1e-9 * np.maximum(1.0, np.abs(least)), -np.inf)[:, None]) & (score > -np.inf)
        else:
            near = score > -np.inf
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            at = np.flatnonzero(near[r])
            exact = (e[at] * q[s + r]).sum(axis=1)  # the same order of additions for equal vectors
            top = np.lexsort((ids[at], -exact))[:k]
            out[0].append(np.full(len(top), q_ids[s + r]))
            out[1].append(ids[at][top])
            out[2].append(exact[top])
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, float), strict=True))


_DEALT = "g int, c int, asks boolean, vec_id long, v array<double>, cu int, cv int, mask binary"


def _ranked(entries: DataFrame, asked: DataFrame, shape: tuple[int, int], k: int) -> DataFrame:
    """The best k of each query in each chunk: entries of a chunk come first, then queries stream past them."""
    width = -(-shape[1] // 8)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, held = None, [], None
        for batch in batches:
            key = batch.column("g").to_numpy().astype(np.int64) << 33 | batch.column("c").to_numpy().astype(np.int64) << 1 | batch.column("asks").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if key[a] >> 1 != place:
                    place, parts, held = key[a] >> 1, [], None
                if not key[a] & 1:
                    parts.append(some)
                    continue
                if held is None:
                    table = pa.Table.from_batches(parts) if parts else None
                    held = (table["vec_id"].to_numpy(), _matrix(table["v"]), table["cu"].to_numpy(), table["cv"].to_numpy()) if table else ()
                    parts = []
                if held:
                    masks = np.frombuffer(b"".join(some.column("mask").to_pylist()), np.uint8).reshape(some.num_rows, shape[0], width)
                    found = best(some.column("vec_id").to_numpy(), _matrix(some.column("v")), masks, *held, k)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["query_id", "vec_id", "score"])

    both = entries.unionAll(asked).repartition("g", "c").sortWithinPartitions("g", "c", "asks")
    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _search(rows: DataFrame, is_query: Column, k: int, share: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    rows = rows.withColumn("q", F.coalesce(is_query, F.lit(False)))
    fitted = _matrix(rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"])
    cut, size = max(1, fitted.shape[1] // 2), centroids(rows.count())
    index = Index(codebook(fitted[:, :cut], size), codebook(fitted[:, cut:], size) if fitted.shape[1] > cut else np.zeros((1, 0)))
    books = spark.sparkContext.broadcast(index)

    @tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v, ru, rv = books.value.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("q"), pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(ru), pa.array(rv)], ["vec_id", "v", "q", "cu", "cv", "ru", "rv"])

    placed = checkpointed(rows.mapInArrow(assign, "vec_id long, v array<double>, q boolean, cu int, cv int, ru double, rv double"))
    # Equal vectors count once, so that a common vector doesn't end the walk early.
    index.fill(placed.groupBy("cu", "cv").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v"), 0.02).alias("distinct"), F.max("ru").alias("ru"), F.max("rv").alias("rv"), F.count_if("q").alias("nq")).collect(), share, k)
    filled = spark.sparkContext.broadcast(index)

    @tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = filled.value
        for batch in batches:
            keys, masks, source = [], [], []
            bounds = batch.column("least").to_pylist()
            for r, q in enumerate(_matrix(batch.column("v")) if batch.num_rows else []):
                cells = it.plan(q, bounds[r])
                if not cells:
                    continue
                mask = np.zeros((it.shape[0], -(-it.shape[1] // 8)), np.uint8)
                u, v = np.array(cells).T
                np.bitwise_or.at(mask, (u, v // 8), np.uint8(1) << (v % 8).astype(np.uint8))
                packed = mask.tobytes()
                for g in np.unique(u % it.n_groups).tolist():
                    for c in range(it.chunks[g]):
                        keys.append((g, c))
                        masks.append(packed)
                        source.append(r)
            at = pa.array(source, pa.int64())
            none = pa.nulls(len(keys), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array([True] * len(keys), pa.bool_()), batch.column("vec_id").take(at), batch.column("v").take(at), none, none, pa.array(masks, pa.binary())], ["g", "c", "asks", "vec_id", "v", "cu", "cv", "mask"])

    n_chunks = F.element_at(F.array(*map(F.lit, index.chunks)), F.col("g") + 1)
    entries = placed.withColumn("g", F.col("cu") % index.n_groups).select("g", F.pmod(F.xxhash64("vec_id", F.lit(1)), n_chunks).cast("int").alias("c"), F.lit(False).alias("asks"), "vec_id", "v", "cu", "cv", F.lit(None).cast("binary").alias("mask"))
    # Walks take long for their few bytes, so queries are dealt by number.
    spread = max(1, -(-index.queries // WALKED))
    asks = placed.where("q").dropDuplicates(["vec_id"]).select("vec_id", "v")
    begun = checkpointed(_top(_ranked(entries, asks.withColumn("least", F.lit(None).cast("double")).repartition(spread).mapInArrow(probe, _DEALT), index.shape, k), k).drop("rank"))
    least = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
    further = asks.join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    more = _ranked(entries, further.repartition(spread).mapInArrow(probe, _DEALT), index.shape, k)
    return _top(begun.unionAll(more), k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found."""
    rows = usable(vectors)
    lengths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().collect()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for k_th, n in enumerate(sorted(lengths)):
        found = _search(rows.where(F.size("v") == n), is_query, k, share)
        out = found if not k_th else out.unionAll(found)
    return out
