"""The most similar vectors of every vector, by shifted space-filling curves.

Each curve has its own rotation and its own shift: vectors are projected to a
few dimensions, quantised, and put in Hilbert order. Spark range-partitions the
rows by curve and key; within a range windows of neighbouring keys are scored as
one matrix product, each window merging with the end of the one before. A range
also gets the last rows of the range before it, so that the first of its windows
merges like all others. The lists of all curves are merged and ranked again by
exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.llm.vectors import DIM, binary, matrix, unit_vectors, with_copies
from stratamem.storage import materialize, width

K = 5
CURVES = 10
#: Dimensions a curve sees, and bits of each.
SIGHT, BITS = 8, 4
#: Rows of a window, rows of the window before that it also sees, rows of a range partition.
WINDOW, BEFORE, RANGE_ROWS = 4096, 2048, 49152
#: The quantisers are fitted on so many vectors at most.
FIT_ROWS = 20_000
SCALE = 1e9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (integers of ``bits`` bits) on the Hilbert curve through its cube (Skilling 2004)."""
    x = cells.T.astype(np.uint32).copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(x)):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint32(q)) != 0, turn ^ np.uint32(q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << np.uint64(1)) | ((row >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key


def fit(sample: np.ndarray, curves: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rotation and quantiser edges of each curve; the edges of one dimension are shifted by the same share of a cell."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        turn = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))[0][:, :SIGHT]
        at = (np.arange(1, 2**BITS)[:, None] - rng.random(SIGHT)[None, :] * 0.999) / 2**BITS
        seen = np.sort(sample @ turn, axis=0) if len(sample) else np.zeros((1, SIGHT))
        edges = np.take_along_axis(seen, np.minimum((at * len(seen)).astype(int), len(seen) - 1), axis=0)
        out.append((turn.astype(np.float32), edges.astype(np.float32)))
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) that surely hold the ``k`` largest of each row: maxima of column groups bound the k-th from below."""
    rows, columns = scores.shape
    if columns > 32 * k:
        group = max(8, columns // 128)
        top = scores[:, : columns - columns % group].reshape(rows, -1, group).max(axis=2)
        floor = np.partition(top, top.shape[1] - k, axis=1)[:, -k]
    else:
        floor = np.partition(scores, max(0, columns - k), axis=1)[:, max(0, columns - k)] if columns else np.zeros(rows, dtype=scores.dtype)
    return np.nonzero((scores >= floor[:, None]) & (scores > -1.5))


def neighbours_in_windows(k: int, dim: int):
    def pairs(x: np.ndarray, xid: np.ndarray, y: np.ndarray, yid: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = [], []
        for i in range(0, len(x), 128):  # scores of so many rows stay in the cache
            scores = x[i : i + 128] @ y.T
            if same:
                np.fill_diagonal(scores[:, i:], -2)
            r, c = best(scores, k)
            a.append(r + i)
            b.append(c)
        a, b = np.concatenate(a), np.concatenate(b)
        exact = np.einsum("ij,ij->i", x[a].astype(np.float64), y[b].astype(np.float64))
        score, other = np.rint(exact * SCALE).astype(np.int64), yid[b]
        # the bound lets a few more through than the k best, which need not be shuffled
        order = np.lexsort((other, -score, a))
        row = a[order]
        start = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], np.arange(len(row)), 0)) if len(row) else row
        order = order[np.arange(len(row)) - start < k]
        return xid[a[order]], other[order], score[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tail = None, [], None

        def flush(x: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            found = [pairs(x, ids, x, ids, same=True)]
            if tail is not None:
                found += [pairs(x, ids, *tail), pairs(*tail, x, ids)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "other", "score"])

        def windows(last: bool):
            nonlocal held, tail
            while held and (last or sum(len(i) for _, i in held) >= WINDOW):
                x, ids = np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held])
                now, held = (x[:WINDOW], ids[:WINDOW]), [(x[WINDOW:], ids[WINDOW:])] if len(ids) > WINDOW else []
                yield flush(*now)
                tail = (now[0][-BEFORE:], now[1][-BEFORE:])

        for batch in batches:
            marks, lead, ids, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)), matrix(batch.column(3))
            for part in np.split(np.arange(len(marks)), np.flatnonzero((np.diff(marks) != 0) | (np.diff(lead) != 0)) + 1) if len(marks) else []:
                rows = slice(part[0], part[-1] + 1)
                if marks[part[0]] != place:
                    yield from windows(True)
                    place, tail = marks[part[0]], None
                if lead[part[0]] == 0:  # of the range before: seen by the first window, and asked there
                    x, own = (vectors[rows], ids[rows]) if tail is None else (np.concatenate([tail[0], vectors[rows]]), np.concatenate([tail[1], ids[rows]]))
                    tail = (x[-BEFORE:], own[-BEFORE:])
                    continue
                held.append((vectors[rows], ids[rows]))
                yield from windows(False)
        yield from windows(True)

    return run


def curve_keys(x: np.ndarray, model: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Place of each vector on each curve; vectors of one cell are told apart by a hash."""
    low = np.ascontiguousarray(x).view(np.uint64).reshape(len(x), -1)
    low = (np.bitwise_xor.reduce(low * np.arange(1, 2 * low.shape[1], 2, dtype=np.uint64), axis=1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 63 + SIGHT * BITS)
    cells = lambda turn, edges: np.stack([np.searchsorted(e, v, side="right") for e, v in zip(edges.T, (x @ turn).T, strict=True)], axis=1)
    return np.stack([(hilbert(cells(turn, edges), BITS) << np.uint64(63 - SIGHT * BITS)) | low for turn, edges in model], axis=1).astype(np.int64)


def ranges(sample: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve where its ranges begin, and where the rows begin that a range sees of the one before; both from the sample's quantiles."""
    parts = max(1, -(-n // RANGE_ROWS))
    out = []
    for keys in np.sort(sample, axis=0).T:
        at = np.arange(1, parts) * len(keys) // parts
        out.append((keys[at], keys[np.maximum(0, at - int(np.ceil(1.2 * BEFORE * len(keys) / max(1, n))) - 1)]))
    return out


def merged(k: int):
    """The ``k`` best of all lists of an id; a partition holds whole ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[np.asarray(c) for c in b.columns] for b in batches]
        if columns:
            a, b, s = (np.concatenate(c) for c in zip(*columns, strict=True))
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]  # a pair's scores are equal to SCALE, so they are adjacent
            a, b, s = a[fresh], b[fresh], s[fresh]
            first = np.r_[True, a[1:] != a[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            keep = np.arange(len(a)) - start < k
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep] / SCALE)], ["id", "other", "cosine"])

    return run


def nearest_distinct(distinct: DataFrame, k: int, curves: int, dim: int) -> DataFrame:
    spark = distinct.sparkSession
    n = distinct.count()
    share = min(1.0, FIT_ROWS / max(1, n))
    sample = distinct.select("vec").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * FIT_ROWS).toArrow()
    seen = matrix(sample.column("vec")).copy() if len(sample) else np.zeros((0, dim), np.float32)
    model = fit(seen.astype(np.float64), curves)
    starts = ranges(curve_keys(seen, model), n) if len(seen) else [(np.zeros(0, np.int64),) * 2] * curves
    shared = spark.sparkContext.broadcast((model, starts))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, borders = shared.value
        count = len(borders[0][0]) + 1
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            rows, marks, keys, lead = [], [], [], []
            for curve, (own, (first, early)) in enumerate(zip(curve_keys(x, turns).T, borders, strict=True)):
                of = np.searchsorted(first, own, side="right")
                near = np.flatnonzero((of < count - 1) & (own >= early[np.minimum(of, count - 2)])) if count > 1 else np.zeros(0, dtype=int)
                rows += [np.arange(len(x)), near]
                marks += [curve * count + of, curve * count + of[near] + 1]
                keys += [own, own[near]]
                lead += [np.ones(len(x), np.int8), np.zeros(len(near), np.int8)]
            mark, key, side = (np.concatenate(c) for c in (marks, keys, lead))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(mark.astype(np.int32)), pa.array(side), pa.array(key), batch.column(0).take(take), batch.column(1).take(take)], ["place", "lead", "key", "id", "vec"])

    spread = distinct.select("id", "vec").mapInArrow(keyed, "place int, lead tinyint, key bigint, id bigint, vec binary")
    parts = curves * (len(starts[0][0]) + 1)
    ranged = spread.repartitionById(parts, "place").sortWithinPartitions("place", "lead", "key").select("place", "lead", "id", "vec")
    found = ranged.mapInArrow(neighbours_in_windows(k, dim), "id bigint, other bigint, score bigint")
    return found.repartition(width(spark, n, 20_000), "id").mapInArrow(merged(k), "id bigint, other bigint, cosine double")


def most_similar(vectors: DataFrame, key: str, vector: str, k: int = K, curves: int = CURVES, dim: int = DIM) -> DataFrame:
    """``(id, rank, neighbour, cosine)``: the ``k`` most similar other rows of every usable row, best first.

    Cases: unusable vectors (null, of another length, with a NaN or infinity, all
    zero) neither ask nor answer; repeated deliveries count once; exact copies are
    each other's neighbours at cosine 1 and equal scores rank by id; fewer than
    ``k`` other rows give shorter lists; an empty table gives none. Copies are
    indexed once and expanded afterwards: a row needs at most ``k + 1`` of the ids
    of any group, so nothing is lost by keeping the smallest ones. The quantisers
    are fitted on at most about ``FIT_ROWS`` vectors; every vector is indexed.
    """
    base, distinct, copies = with_copies(unit_vectors(vectors, key, vector, dim))
    near = materialize(nearest_distinct(distinct, k, curves, dim), "near")
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1)
    first = first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    # answers, the copies of each neighbour in its place
    answers = near.join(first.withColumnRenamed("rep", "other"), "other", "left").select("id", "cosine", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"))
    own = first.select(F.col("rep").alias("id"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    answers = answers.unionByName(own)
    asking = copies.select(F.col("rep").alias("id"), F.col("id").alias("member"))
    plain = answers.join(first.select(F.col("rep").alias("id")), "id", "left_anti").withColumn("member", F.col("id"))
    every = plain.unionByName(answers.join(asking, "id")).where(F.col("member") != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("cosine"), "neighbour"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("member").alias("id"), "rank", "neighbour", "cosine")


def close_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """``(a, b)``, ``a < b``, of neighbours at ``least`` or more, each once."""
    return neighbours.where(F.col("cosine") >= least).select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()


def recall(vectors: DataFrame, key: str, vector: str, k: int = K, every: int = 20, dim: int = DIM) -> DataFrame:
    """One row: the share of the true ``k`` best that the index finds, for the ids divisible by ``every`` against all rows.

    The truth is exact: the stated queries go in blocks against every row.
    """
    units = materialize(unit_vectors(vectors, key, vector, dim), "recall-units")
    spark = units.sparkSession
    asking = units.where(F.col("id") % every == 0)
    n_blocks = max(1, -(-asking.count() // 2048))
    blocks = materialize(asking.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")), "recall-queries")
    truth = None
    for block in range(n_blocks):
        part = blocks.where(F.col("block") == block).select("id", "vec").toArrow()
        shared = spark.sparkContext.broadcast((np.asarray(part.column("id")), matrix(part.column("vec")).copy() if len(part) else np.zeros((0, dim), np.float32)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            for batch in batches:
                if len(ids) and batch.num_rows:
                    other, y = np.asarray(batch.column(0)), matrix(batch.column(1))
                    scores = x @ y.T
                    scores[ids[:, None] == other[None, :]] = -2
                    a, b = best(scores, k)
                    exact = np.einsum("ij,ij->i", x[a].astype(np.float64), y[b].astype(np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(other[b]), pa.array(np.rint(exact * SCALE).astype(np.int64))], ["id", "other", "score"])

        found = units.select("id", "vec").mapInArrow(scan, "id bigint, other bigint, score bigint")
        truth = found if truth is None else truth.unionByName(found)
    true = truth.repartition(width(spark, units.count(), 20_000), "id").mapInArrow(merged(k), "id bigint, other bigint, cosine double")
    got = most_similar(vectors, key, vector, k, dim=dim)
    floor = true.groupBy("id").agg(F.min("cosine").alias("floor"), F.count("*").alias("due"))
    # ties at the k-th place are as good as each other
    hit = got.join(floor, "id").where(F.col("cosine") >= F.col("floor") - 1e-9).groupBy("id").agg(F.count("*").alias("hits"))
    return floor.join(hit, "id", "left").agg(F.count("*").alias("queries"), F.sum("due").alias("due"), (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("due")).alias("recall"))
