"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds the hashes of its distinct 5-word shingles. One random
permutation (the hash to UNIVERSE places) orders the shingles; a second one,
shifted by k places, gives coordinate k of the signature as the smallest value
at the set's places. Since the shifts of one table lie side by side, all
coordinates of a shingle are one contiguous slice.

Documents with equal sets are one class, so copies are never paired. Classes
that share a band form candidate clusters. Each text of a cluster moves once to
the task that verifies it on full sets; large clusters are cut into chunks that
also get the cluster's hub, and only what is still apart from the main component
is then compared, block by block, with the rest. Nothing is sampled or capped.

With 16 bands of 4 coordinates a pair at Jaccard 0.85 is missed with
probability 8e-6, and less above; below PERCENT there are 24 bands, which miss a
pair at 0.80 with 3e-6.

Defined results: null texts and texts without words have an empty set, link with
nothing and are their own component; a null doc_id has no component and is kept;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACES, U64, checkpointed, chunks, counted, hash_windows, hash_words, splitmix, tidy, utf8, words
from tallyforge.llm.components import components

SHINGLE = 5
BANDS, ROWS = 16, 4
#: Bands where links are asked for below PERCENT.
MORE_BANDS = 24
UNIVERSE = 1 << 20
#: Links need 100 * intersection >= percent * union; PERCENT where none is asked for.
PERCENT = 85
#: Distinct shingles and documents of one group of a verification task; larger clusters are cut.
CHUNK_WORDS, CHUNK_DOCS = 1_000_000, 4_000


@lru_cache(2)
def circulant(coordinates: int) -> np.ndarray:
    """Row s: the second permutation at s, shifted by 0 to ``coordinates`` - 1."""
    table = np.random.default_rng(20).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The circulant MinHash coordinates of a set of shingle hashes."""
    table = circulant(bands * ROWS)
    place = (shingles >> U64(44)).astype(np.int64)
    out = table[place[:2048]].min(axis=0)
    for k in range(2048, len(place), 2048):
        np.minimum(out, table[place[k : k + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words, the whole sequence is one."""
    buf, at = utf8(column)
    starts, ends, row = words(buf, at, SPACES)
    hashes = hash_words(buf, starts, ends)
    bound = np.searchsorted(row, np.arange(len(column) + 1))
    every = hash_windows(hashes, size) if len(hashes) >= size else np.zeros(0, U64)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - size + 1] if b - a >= size else hash_windows(hashes[a:b], size)))
    return out


def features(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), bands; the last two are null for empty sets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list[np.ndarray | None] = [None] * len(sets)
            if full:
                rows = np.stack([signature(sets[i], n_bands) for i in full]).astype(U64).reshape(-1, n_bands, ROWS)
                mixed = np.zeros((len(full), n_bands), U64) + np.arange(n_bands, dtype=U64)
                for k in range(ROWS):
                    mixed = splitmix(mixed * U64(0x9E3779B97F4A7C15) + rows[:, :, k])
                for i, b in zip(full, mixed.view(np.int64), strict=True):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def link_sets(ids: np.ndarray, sets: list[np.ndarray], hub: int = 0, against: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (id, id) that join what is linked, found on full sets.

    Each set outside the hub's component is compared with all others through an
    inverted index; pairs inside that component need no comparison. ``against``
    marks sets that are compared only with the unmarked ones.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    root = np.arange(n)
    links = []
    queue = [hub, *(i for i in range(n) if i != hub)] if against is None else np.flatnonzero(~against).tolist()
    for i in queue:
        if against is None and i != hub and root[i] == root[hub]:
            continue
        low = np.searchsorted(every, sets[i], "left")
        counts = np.searchsorted(every, sets[i], "right") - low
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        shared = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))
        for j in near.tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((int(ids[i]), int(ids[j])))
    return links


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, hub, against, text), those of a group side by side -> links (a, b)."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        group = table["grp"].to_numpy()
        cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        ids, hub, against = table["node"].to_numpy(), table["hub"].to_numpy(), table["against"].to_numpy()
        sets = shingle_sets(table["text"].combine_chunks())
        links = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                at = np.flatnonzero(ids[a:b] == hub[a])
                links += link_sets(ids[a:b], sets[a:b], int(at[0]) if len(at) else 0, against[a:b] if against[a:b].any() else None, percent)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chunks(batches, "text", 1 << 20):
        group = batch.column("grp").to_numpy(zero_copy_only=False)
        if held and size > 2 << 20:
            last = held[-1].column("grp")[-1].as_py()
            stop = int(np.argmax(group != last)) if (group != last).any() else len(group)
            if stop < len(group):
                yield solve([*held, batch.slice(0, stop)])
                held, size, batch = [], 0, batch.slice(stop)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield solve(held)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    return rows.repartition("grp").sortWithinPartitions("grp").select("grp", "node", "hub", "against", "text").mapInArrow(tidy(lambda batches: _verify(batches, percent)), "a long, b long")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    found = checkpointed(features(docs, BANDS if percent >= PERCENT else MORE_BANDS))
    full = found.where("set_key is not null and doc_id is not null")
    # Written out, so that the join below is between two plain exchanges, which Spark can split where one set is in many documents.
    classes = checkpointed(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    member = checkpointed(full.join(classes, "set_key").select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"), "n_shingles"))
    reps = member.where("bands is not null")
    band = reps.select("rep", F.explode("bands").alias("band"))
    lead = band.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("band", "lead")
    shared = checkpointed(band.join(lead, "band").where("rep <> lead").groupBy("lead", "rep").agg(F.count("*").alias("n")))
    cluster = components(shared.select(F.col("lead").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("component", "cluster")
    # The hub is the leader that shares bands with the most classes; it decides the order of work, not the result.
    degree = shared.groupBy("lead").agg(F.count("*").alias("degree"))
    sized = cluster.join(reps.select(F.col("rep").alias("node"), "n_shingles").distinct(), "node").join(degree.withColumnRenamed("lead", "node"), "node", "left")
    plan = sized.groupBy("cluster").agg(F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), "n_shingles")).alias("hub"), F.ceil(F.greatest(F.sum(F.col("n_shingles") + 4) / CHUNK_WORDS, F.count("*") / CHUNK_DOCS)).cast("int").alias("n_chunks"))
    placed = cluster.join(plan, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int"))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    cand, seen = counted(placed.join(texts, "node").withColumn("cut", F.col("n_chunks") > 1), "cut")
    spread = cand.where("cut").drop("cut")
    group = lambda *c: F.xxhash64(*c).alias("grp")
    no = F.lit(False).alias("against")
    first = cand.select(group("cluster", "chunk"), "node", "hub", no, "text")
    hubs = spread.where("node = hub").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).where("to <> chunk").select(group("cluster", "to"), "node", "hub", no, "text")
    links = _links(first.unionAll(hubs) if seen["cut"] else first, percent)
    if seen["cut"]:
        links = checkpointed(links)
        links = links.unionAll(_rest(spread, links, percent))
    joined = components(links)
    label = joined.withColumnRenamed("node", "rep")
    some = member.select("doc_id", "rep", "n_shingles").join(label, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    none = found.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionAll(none).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _rest(spread: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of what is not yet in the main component of its large cluster, compared with all of the cluster in blocks."""
    found = components(links)
    label = spread.drop("text").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = label.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", "count").alias("main"))
    apart = checkpointed(label.join(main, "cluster").where("component <> main").select("node", "cluster"))
    many = apart.groupBy("cluster").agg(F.count("*").alias("n_apart"))
    whole = spread.join(many, "cluster").join(apart.select("node", F.lit(True).alias("is_apart")), "node", "left")
    whole = whole.withColumn("n_parts", F.ceil(F.col("n_apart") / 500).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_parts")).cast("int"))
    group = lambda *c: F.xxhash64(*c).alias("grp")
    rows = whole.where("is_apart").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).select(group("cluster", "part", "to"), "node", F.lit(-1).cast("long").alias("hub"), F.lit(False).alias("against"), "text")
    others = whole.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).where("is_apart is null or part <> from").select(group("cluster", "from", "chunk"), "node", F.lit(-1).cast("long").alias("hub"), F.lit(True).alias("against"), "text")
    return _links(rows.unionAll(others), percent)


def unique(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The kept document of each component, with all its columns."""
    return docs.join(groups(docs, percent).where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
