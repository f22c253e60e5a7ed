"""Near-duplicate texts, by vantage-point trees over fingerprints.

A text has two fingerprints. The routing one is a 1024-bit sign hash of its words,
which small edits and reordering hardly move; vantage-point trees partition it by
Hamming distance, each node splitting at the median distance from its vantage
point. The triangle inequality keeps the distances of two near-duplicates from a
vantage point close together, so a text is put on both sides of a split only when
it lies within half of ``MARGIN`` of it: all pairs whose distances differ by no
more meet in a shard, and the farther branches are pruned. The hard bound (the
distance of the pair itself) would prune nothing, as unrelated texts lie at nearly
the same distance from any point; the margin is what the distances of
near-duplicates differ by in practice, and ``TREES`` trees with their own vantage
points leave few pairs apart in all of them. Within a shard the sizes bound
the similarity once more, the Hamming distance of 256 one-bit minhashes filters,
and what remains is verified on the exact shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.text import Lexicon, mixed, shingles, word_hashes, words
from stratamem.llm.vectors import binary, matrix
from stratamem.operators.components import connected_components
from stratamem.storage import latest, materialize, width

LEAST, SHINGLE = 0.6, 3
BITS, ROUTE_BITS = 256, 1024
TREES, MARGIN, SHARD = 4, 10, 2048
#: A split must leave at most this share of the comparisons.
WORTH = 0.85
#: The trees are built on so many fingerprints at most; shards beyond TASK_ROWS are compared in blocks.
FIT_ROWS, TASK_ROWS = 20_000, 16_384
#: Copies of one text that one task takes from a side when they are paired.
COPY_ROWS = 20_000
MULTIPLIERS = mixed(np.arange(1, BITS + 1, dtype=np.uint64)) | np.uint64(1)


LANES = np.arange(1, ROUTE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def routing_bits(hashes: np.ndarray) -> np.ndarray:
    """Sign hash of the words, each counting as the root of its frequency."""
    ordered = np.sort(hashes)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    signs = np.unpackbits(mixed(ordered[first, None] + LANES).view(np.uint8), axis=1)
    weight = np.sqrt(np.diff(np.r_[first, len(ordered)])).astype(np.float32)
    return weight @ signs.astype(np.float32) > weight.sum() / 2


def minhash_bits(items: np.ndarray) -> np.ndarray:
    """One bit of each of 256 minhashes."""
    low = np.full(BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), 128):  # small enough for the cache
        low = np.minimum(low, (items[i : i + 128, None] * MULTIPLIERS).min(axis=0))
    return (mixed(low) & np.uint64(1)).astype(bool)


def fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lambda word: 0)
        for batch in batches:
            ids, keys, sizes, route, check = [], [], [], [], []
            hashes, _, ends = lexicon.look_up([words(t) for t in batch.column(1).to_pylist()])
            every = shingles(hashes, shingle)
            for i, a, b in zip(batch.column(0).to_pylist(), np.r_[0, ends[:-1]], ends, strict=True):
                s = every[a : max(a, b - shingle + 1)]
                if not len(s):
                    continue
                unique = np.unique(s)
                ids.append(i)
                # of the whole sequence, so that equal texts and only those share it
                order = mixed(s + np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                keys.append((np.bitwise_xor.reduce(order), order.sum(dtype=np.uint64)))
                sizes.append(len(unique))
                route.append(routing_bits(hashes[a:b]))
                check.append(minhash_bits(unique))
            if ids:
                pack = lambda rows: binary(np.packbits(np.array(rows), axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), binary(np.array(keys, dtype=np.uint64)), pa.array(sizes, pa.int32()), pack(route), pack(check)], ["id", "same", "n", "route", "bits"])

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of packed rows (uint64 lanes), broadcast."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def grow(sample: np.ndarray, total: int, seed: int) -> list[tuple[np.ndarray | None, float, int, int]]:
    """A vantage-point tree as ``(vantage point, split, left, right)``; leaves have no point. A shard is to hold about ``SHARD`` rows."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[np.ndarray | None, float, int, int]] = []

    def build(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append((None, 0.0, -1, -1))
        if len(rows) < 32 or len(rows) * total / max(1, len(sample)) <= SHARD:
            return at
        seen = rows if len(rows) <= 3000 else rows[rng.choice(len(rows), 3000, replace=False)]
        choice = []
        for point in seen[rng.choice(len(seen), min(24, len(seen)), replace=False)]:
            d = distances(seen, point)
            split = float(np.median(d)) + 0.5
            choice.append(((d <= split + MARGIN / 2).mean() ** 2 + (d > split - MARGIN / 2).mean() ** 2, split, point))
        cost, split, point = min(choice, key=lambda c: c[0])
        if cost > WORTH:
            return at  # too many rows at one distance: no branch could be pruned
        d = distances(rows, point)
        left, right = rows[d <= split + MARGIN / 2], rows[d > split - MARGIN / 2]
        nodes[at] = (point, split, build(left), build(right))
        return at

    build(sample)
    return nodes


def route_to_shards(nodes: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, leaf)`` of every shard a row belongs to."""
    out, open_ = [], [(0, np.arange(len(rows)))]
    while open_:
        at, members = open_.pop()
        point, split, left, right = nodes[at]
        if point is None:
            out.append((members, np.full(len(members), at)))
        elif len(members):
            d = distances(rows[members], point)
            open_ += [(left, members[d <= split + MARGIN / 2]), (right, members[d > split - MARGIN / 2])]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def far_bits(least: float) -> int:
    """Hamming distance of one-bit minhashes that pairs at ``least`` exceed once in 50,000 (four deviations)."""
    p = (1 - least) / 2
    return round(BITS * p + 4.1 * (BITS * p * (1 - p)) ** 0.5)


def in_shards(least: float):
    """Candidate pairs of each shard, rows sorted by shard."""
    most = far_bits(least)

    def pairs(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool) -> tuple[np.ndarray, np.ndarray]:
        (ai, an, ab), (bi, bn, bb) = left, right
        a_out, b_out = [], []
        for i in range(0, len(ai), 256):
            # sizes are sorted; two sets whose sizes differ more cannot be similar enough
            lo = np.searchsorted(bn, an[i] * least - 1e-9)
            hi = np.searchsorted(bn, an[min(i + 255, len(an) - 1)] / least + 1e-9, side="right")
            lo = max(lo, i + 1) if same else lo
            if lo >= hi:
                continue
            d = np.zeros((len(ai[i : i + 256]), hi - lo), dtype=np.uint16)
            for lane in range(ab.shape[1]):
                d += np.bitwise_count(ab[i : i + 256, lane, None] ^ bb[None, lo:hi, lane])
            r, c = np.nonzero(d <= most)
            if same:
                keep = c + lo > r + i
                r, c = r[keep], c[keep]
            a_out.append(ai[r + i])
            b_out.append(bi[c + lo])
        empty = np.zeros(0, dtype=np.int64)
        a, b = np.concatenate([empty, *a_out]), np.concatenate([empty, *b_out])
        keep = a != b
        return np.minimum(a, b)[keep], np.maximum(a, b)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            mark, side, ids, n, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            block = []
            for s in (0, 1):
                rows = np.flatnonzero(side == s)
                rows = rows[np.argsort(n[rows], kind="stable")]
                block.append((ids[rows], n[rows], bits[rows]))
            a, b = pairs(block[0], block[1], False) if mark[0, 1] != mark[0, 2] else pairs(block[0], block[0], True)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mark = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:3]], axis=1)
            rest = [np.asarray(c) for c in batch.columns[3:6]]
            bits = matrix(batch.column(6), "uint64")
            edges = np.r_[0, np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1, len(mark)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and (held[0][0][0] != mark[i]).any():
                    yield close()
                held.append((mark[i:j], *(c[i:j] for c in rest), bits[i:j]))
        if held:
            yield close()

    return run


def candidates(prints: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of distinct texts that share a shard and pass the size and minhash bounds."""
    spark = prints.sparkSession
    n = prints.count()
    share = min(1.0, FIT_ROWS / max(1, n))
    sample = prints.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("route").limit(2 * FIT_ROWS).toArrow()
    rows = matrix(sample.column("route"), "uint64") if len(sample) else np.zeros((0, ROUTE_BITS // 64), np.uint64)
    trees = spark.sparkContext.broadcast([grow(rows, n, seed) for seed in range(TREES)])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            route = matrix(batch.column(2), "uint64")
            found = [(r, leaf * TREES + t) for t, nodes in enumerate(trees.value) for r, leaf in [route_to_shards(nodes, route)]]
            r, leaf = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *(batch.column(i).take(at) for i in (0, 1, 3))], ["shard", "id", "n", "bits"])

    placed = materialize(prints.select("id", "n", "route", "bits").mapInArrow(shard, "shard int, id bigint, n int, bits binary"), "shards")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("rows"))
    total = 0
    deal = {}
    for r in sizes.collect():  # one row per shard
        total += r.rows
        if r.rows > TASK_ROWS:
            deal[r.shard] = -(-r.rows // (TASK_ROWS // 2))
    if deal:
        dealt = spark.createDataFrame([(int(k), v) for k, v in deal.items()], "shard int, parts int")
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        spread = placed.join(dealt, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = spread.select("shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "bits")
    else:
        keyed = placed.select("shard", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "id", "n", "bits")
    ranged = keyed.repartition(width(spark, total, 40_000), "shard", "p", "q").sortWithinPartitions("shard", "p", "q")
    return ranged.mapInArrow(in_shards(least), "a bigint, b bigint").distinct()


def near_duplicates(records: DataFrame, key: str, text: str, least: float = LEAST, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(pairs, copies)``: ``pairs(a, b, similarity)`` between different texts, ``copies(id, rep)`` of equal ones.

    ``similarity`` is the Jaccard similarity of the sets of ``shingle`` consecutive
    words, ignoring case, accents and punctuation. Cases: null, empty and blank
    texts and those of fewer than ``shingle`` words have no shingles and are no
    case; repeated deliveries count once; texts of the same word sequence are
    copies of the one with the smallest id, which alone is compared; an empty table
    gives no rows. Long texts are hashed whole.
    """
    spark = records.sparkSession
    one = materialize(latest(records.where(F.length(text) > 0), key, text).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")), "texts")
    prints = materialize(one.repartition(width(spark, one.count(), 4000)).mapInArrow(fingerprints(shingle), "id bigint, same binary, n int, route binary, bits binary"), "fingerprints")
    reps = prints.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    copies = prints.select("id", "same").join(reps.where("copies > 1").select("same", F.col("id").alias("rep")), "same").where("id <> rep").select("id", "rep")
    distinct = prints.join(reps.select("id"), "id", "left_semi")
    pairs = materialize(candidates(distinct, least), "candidates")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for frame in frames:
            yield pd.DataFrame({"id": frame.id, "set": [np.unique(shingles(word_hashes(words(t), cache), shingle)).view(np.int64) for t in frame.text]})

    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    shingled = materialize(one.join(involved, "id", "left_semi").mapInPandas(sets, "id bigint, set array<bigint>"), "shingle-sets")
    both = pairs.join(shingled.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(shingled.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    exact = both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity")).where(F.col("similarity") >= least)
    return materialize(exact, "near-pairs"), materialize(copies, "text-copies")


def found_pairs(records: DataFrame, key: str, text: str) -> DataFrame:
    """``(a, b)``, ``a < b``: all pairs of near-duplicate records, copies included, each pair once.

    The result is one row a pair by definition, so a text of ``n`` copies gives
    ``n * (n - 1) / 2``; :func:`groups` tells the same in one row a record. The pairs
    come from joins on the group of copies, of which a task holds ``COPY_ROWS`` a side.
    """
    pairs, copies = near_duplicates(records, key, text)
    sizes = copies.groupBy("rep").agg(F.ceil((F.count("*") + 1) / COPY_ROWS).cast("int").alias("shares"))
    member = copies.unionByName(sizes.select(F.col("rep").alias("id"), "rep")).join(sizes, "rep")
    member = materialize(member.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")), "copy-members")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    within = member.select("rep", "share", F.col("id").alias("a")).join(member.select("rep", every.alias("share"), F.col("id").alias("b")), ["rep", "share"]).where("a < b").select("a", "b")
    between = pairs.select("a", "b")
    for side in ("a", "b"):
        own = member.select(F.col("rep").alias(side), "share", "id")
        spread = between.join(sizes.withColumnRenamed("rep", side), side, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
        other = "b" if side == "a" else "a"
        between = spread.join(own, [side, "share"], "left").select(F.coalesce("id", side).alias(side), other)
    return between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)


def groups(records: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, group_id, size, links)``: every record that repeats another, its group and its links to other texts."""
    pairs, copies = near_duplicates(records, key, text)
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    member = connected_components(edges)
    size = member.groupBy("component").agg(F.count("*").alias("size"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return member.join(size, "component").join(links, "node", "left").select(F.col("node").alias("id"), F.col("component").alias("group_id"), "size", F.coalesce("links", F.lit(0)).alias("links"))
