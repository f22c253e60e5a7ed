"""Clusters of mutually similar vectors: banding by nearest directions, verification, components, medoids.

A band has one or more sets of random directions; the key of a vector is the
direction of each set it is nearest to, or opposite to. The chance that two vectors
share a key follows from their angle alone, so the number of bands follows from the
threshold. Vectors of one key share a bucket. Within a bucket every pair is verified
and the links found are reduced to one link per member; connected components over
those links are the groups. The bands are taken a few at a time, so that only a few
copies of the vectors are on disk at once.

Where only the groups are asked for, every vector is first compared with a sample,
the leaders. What one leader or linked leaders are similar to is one group, so pairs
within it are compared no more; all others are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.llm.vectors import DIM, binary, matrix, unit_vectors, with_copies
from stratamem.operators.components import connected_components
from stratamem.storage import materialize, release, shuffles_deleted, stored, width

LEAST = 0.80
#: Directions of a set at most, and sets of a band at most.
AXES_MOST, SETS_MOST = 1024, 3
#: Prices in microseconds, for choosing the number of directions: a copy of a vector in a band, a comparison, a direction.
COPY_US, PAIR_US, AXIS_US = 6.0, 0.0025, 0.0025
#: Pairs just similar enough that are tried to tell how often they are nearest to the same direction.
TRIES = 8192
#: Bands taken at once: their copies of the vectors, half as large as the vectors, are on disk together. Copies for overfull buckets count as well; small tables take as many bands as make ``ROUND_ROWS``.
ROUND_BANDS, ROUND_ROWS = 3, 3_000_000
#: Leaders at most, and vectors for each at least; rows by which overfull buckets are found.
LEADERS, LEADER_SHARE, COUNTED = 2048, 64, 1_000_000
#: Rows expected in a bucket of unrelated vectors at most: a thirty-second of all, within these bounds. Fewer
#: rows a bucket need more bands, so more copies of each vector; more rows need more comparisons.
BUCKET, BUCKET_SHARE, BUCKET_MOST = 8192, 32, 32768
#: A bucket of more than so many times that is compared in blocks, every part with every other.
TASK_BUCKETS = 2
#: Chance that two vectors just similar enough never meet in a bucket.
MISS = 0.002
#: Half-precision products err by less than this; pairs so near the threshold are looked up exactly.
DOUBT = 5e-4
#: Members of a group that are tried as medoids in the first round, and at most in later ones; members that one task compares with them.
TRIED, TRIED_MOST, SPREAD = 64, 4096, 20_000


def bucket_for(n: int) -> int:
    return min(BUCKET_MOST, max(BUCKET, n // BUCKET_SHARE))


@functools.lru_cache
def meeting(cosine: float) -> dict[int, float]:
    """Chance, by number of directions, that two vectors of this cosine are nearest to the same one; less two standard errors."""
    rng, met = np.random.default_rng(5), dict.fromkeys((2**i for i in range(AXES_MOST.bit_length())), 0)
    for _ in range(TRIES // 1024):
        x = rng.standard_normal((1024, AXES_MOST), dtype=np.float32)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal((1024, AXES_MOST), dtype=np.float32)
        for axes in met:
            met[axes] += int((nearest(x[:, :axes]) == nearest(y[:, :axes])).sum())
    return {axes: m / TRIES - 2 * math.sqrt(m / TRIES * (1 - m / TRIES) / TRIES) for axes, m in met.items()}


def bands_for(n: int, least: float) -> tuple[tuple[int, ...] | int, int]:
    """Directions in each set of a band, so that buckets of unrelated vectors stay bounded, and bands, so that similar ones meet; the cheapest."""
    if n <= BUCKET:
        return 0, 1  # one bucket
    best = (math.inf, 0, 1)
    for axes, chance in meeting(least).items():
        for sets in range(1, SETS_MOST + 1):
            rows, meet = n / (2 * axes) ** sets, chance**sets
            if meet > 0 and (rows <= bucket_for(n) or (axes, sets) == (AXES_MOST, SETS_MOST)):
                bands = math.ceil(math.log(MISS) / math.log1p(-meet))
                best = min(best, (bands * (COPY_US + rows * PAIR_US + sets * axes * AXIS_US), (axes,) * sets, bands))
    return best[1:]


def nearest(along: np.ndarray) -> np.ndarray:
    """The direction each row is nearest or opposite to, by its products with all; twice its place, and one more if opposite."""
    at = np.abs(along).argmax(axis=1)
    return 2 * at + (along[np.arange(len(along)), at] < 0)


def band_keys(x: np.ndarray, sets: tuple[int, ...] | int, bands: int, seed: int = 11) -> np.ndarray:
    """One key per vector and band."""
    rng = np.random.default_rng(seed)
    keys = np.zeros((len(x), bands), dtype=np.int64)
    for band in range(bands):
        for axes in sets or ():
            towards = rng.standard_normal((x.shape[1], axes), dtype=np.float32)
            for i in range(0, len(x), 2048):
                keys[i : i + 2048, band] = keys[i : i + 2048, band] * 2 * axes + nearest(x[i : i + 2048] @ towards)
    return keys


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least place of the group) once the places ``a`` and ``b`` are joined."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def groups_in(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label and number of similar vectors of each row; pairs too near the threshold to tell."""
    n = len(x)
    label, degree, unsure = np.arange(n), np.zeros(n, dtype=np.int64), [np.zeros((2, 0), dtype=np.int64)]
    for i in range(0, n, 512):
        scores = x[i : i + 512] @ x[i:].T  # each pair once
        m = len(scores)
        near, maybe = scores >= least + DOUBT, scores >= least - DOUBT
        at = np.arange(m)
        near[at, at] = maybe[at, at] = False
        degree[i : i + m] += near.sum(axis=1)
        degree[i + m :] += near[:, m:].sum(axis=0)
        some = np.flatnonzero(near.any(axis=1))
        label = settle(label, some + i, near[some].argmax(axis=1) + i)  # most of a dense group at once
        doubt = maybe & ~near
        near &= label[i : i + m, None] != label[None, i:]
        a, b = np.nonzero(near)
        label = settle(label, a + i, b + i)
        if doubt.any():
            a, b = np.nonzero(doubt)
            unsure.append(np.stack([a, b])[:, a < b] + i)
    a, b = np.concatenate(unsure, axis=1)
    open_ = label[a] != label[b]
    return label, degree, a[open_], b[open_]


def groups_across(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``groups_in`` for the rows of ``x`` and then ``y``, of pairs between the two only."""
    n = len(x)
    label, degree, unsure = np.arange(n + len(y)), np.zeros(n + len(y), dtype=np.int64), [np.zeros((2, 0), dtype=np.int64)]
    for i in range(0, n, 512):
        scores = x[i : i + 512] @ y.T
        near, maybe = scores >= least + DOUBT, scores >= least - DOUBT
        doubt = maybe & ~near
        degree[i : i + len(near)] = near.sum(axis=1)
        degree[n:] += near.sum(axis=0)
        some = np.flatnonzero(degree[i : i + len(near)])
        label = settle(label, some + i, near[some].argmax(axis=1) + n)  # most of a dense group at once
        near &= label[i : i + len(near), None] != label[None, n:]
        a, b = np.nonzero(near)
        label = settle(label, a + i, b + n)
        if doubt.any():
            a, b = np.nonzero(doubt)
            unsure.append(np.stack([a + i, b + n]))
    a, b = np.concatenate(unsure, axis=1)
    open_ = label[a] != label[b]
    return label, degree, a[open_], b[open_]


def joined(x: np.ndarray, known: np.ndarray, split: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label of each row once similar ones are joined besides those of one ``known`` group; pairs too near the threshold to tell.

    The first ``split`` rows meet the others; without a split, each row meets all of
    the groups after its own, which takes rows sorted by group.
    """
    _, first, group = np.unique(known, return_index=True, return_inverse=True)
    label, unsure = first[group], [np.zeros((2, 0), dtype=np.int64)]
    for i in range(0, split or len(x), 512):
        end = min(i + 512, split or len(x))
        start = split or (i if known[i] != known[end - 1] else int(np.searchsorted(known, known[i], "right")))
        for j in range(start, len(x), 8192):
            scores = x[i:end] @ x[j : j + 8192].T
            if i == j:
                np.fill_diagonal(scores, -1)
            near = scores >= least - DOUBT
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            best = scores[some].argmax(axis=1)
            sure = scores[some, best] >= least + DOUBT
            label = settle(label, some[sure] + i, best[sure] + j)  # most of a dense group at once
            a, b = np.nonzero(near[some] & (label[some + i, None] != label[None, j : j + 8192]))
            sure = scores[some[a], b] >= least + DOUBT
            a, b = some[a] + i, b + j
            label = settle(label, a[sure], b[sure])
            unsure.append(np.stack([a[~sure], b[~sure]]))
    a, b = np.concatenate(unsure, axis=1)
    open_ = label[a] != label[b]
    return label, a[open_], b[open_]


def in_buckets(least: float, degrees: bool):
    """Over rows sorted by bucket and pair of parts: each member, or each known group, linked to the first of its group, and pairs to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        out: list[tuple[np.ndarray, ...]] = []

        def close() -> None:
            mark, sides, known, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            across = mark[0, 3] != mark[0, 4]
            first = np.lexsort((ids, known, sides))
            first = first[np.r_[True, (np.diff(ids[first]) != 0) | (np.diff(sides[first]) != 0)]]
            known, ids, x, split = known[first], ids[first], x[first].astype(np.float32), int((sides == 0)[first].sum()) if across else 0
            if len(ids) > 1 and not (across and split in (0, len(ids))):
                if degrees:
                    label, degree, a, b = groups_across(x[:split], x[split:], least) if across else groups_in(x, least)
                    linked = np.flatnonzero(degree)
                else:
                    label, a, b = joined(x, known, split, least)
                    start = np.unique(known, return_index=True)[1]
                    linked, degree = start[label[start] != start], np.ones(len(ids), dtype=np.int64)
                level = np.full(len(linked), mark[0, 0])
                out.append((level, ids[linked], ids[label[linked]], degree[linked]))
                if len(a):
                    out.append((np.full(len(a), mark[0, 0]), ids[a], ids[b], np.full(len(a), -1)))

        def emit() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out, strict=True), ("int32", "int64", "int64", "int64"), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["level", "u", "v", "degree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:5]], axis=1)
            sides, known, ids, x = *(np.asarray(batch.column(i)) for i in (5, 6, 7)), matrix(batch.column(8), "float16")
            edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(marks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and (held[0][0][0] != marks[a]).any():
                    close()
                held.append((marks[a:b], sides[a:b], known[a:b], ids[a:b], x[a:b]))
            if len(out) > 512:
                yield emit()
        if held:
            close()
        if out:
            yield emit()

    return run


def leaders(distinct: DataFrame, n: int, least: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By level, about ``LEADERS`` vectors in all, and for each the smallest id among those it is linked to by leaders."""
    share = min(LEADERS, n // LEADER_SHARE) / max(n, 1)
    by: dict[int, list] = {}
    for r in distinct.where(F.pmod(F.xxhash64("id", "level"), F.lit(1 << 30)) < int(share * (1 << 30))).collect():
        by.setdefault(r.level, []).append((r.id, r.vec))
    out = {}
    for level, rows in by.items():
        rows.sort()
        ids, x = np.array([i for i, _ in rows]), np.frombuffer(b"".join(v for _, v in rows), dtype=np.float32).reshape(len(rows), -1)
        out[level] = ids[joined(x, ids, 0, least)[0]], x
    return out


def led(level: np.ndarray, ids: np.ndarray, x: np.ndarray, by: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """For each row the id its nearest leader goes by if that is surely similar, else its own."""
    known = ids.copy()
    for one in np.unique(level):
        if one in by:
            names, heads = by[one]
            at = np.flatnonzero(level == one)
            for i in range(0, len(at), 512):
                scores = x[at[i : i + 512]] @ heads.T
                best = scores.argmax(axis=1)
                near = scores[np.arange(len(best)), best] >= least + DOUBT
                known[at[i : i + 512][near]] = names[best[near]]
    return known


def similar_links(distinct: DataFrame, least: float, dim: int, degrees: bool = True) -> DataFrame:
    """``(level, u, v, degree)``: verified links that keep every group connected.

    With ``degrees`` every pair is compared, and ``degree`` sums ``u``'s similar vectors
    over the bands; else pairs of a group known by its leaders are not, and it is 1.
    """
    spark = distinct.sparkSession
    counts = [r.n for r in distinct.groupBy("level").agg(F.count("*").alias("n")).collect()]
    n = max(counts, default=0)
    sets, bands = bands_for(n, least)
    task_rows = TASK_BUCKETS * bucket_for(n)
    by = {} if degrees or n <= BUCKET else leaders(distinct, sum(counts), least)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column(2)), np.asarray(batch.column(1))
                known = led(np.asarray(batch.column(0)), ids, x, by, least)
                keys = band_keys(x, sets, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known), binary(x.astype(np.float16)), lists], ["level", "id", "known", "half", "keys"])

    signed, signed_path = stored(distinct.select("level", "id", "vec").mapInArrow(banded, "level int, id bigint, known bigint, half binary, keys array<bigint>"), "band-keys")
    where, units = ["level", "band", "key"], ["level", "band", "key", "p", "q"]
    # an overfull bucket is dealt into parts, each of which meets itself and every other; only those of its largest known group meet but the others
    one_in = max(1, n // COUNTED)
    sizes = signed.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("level", "known", F.posexplode("keys").alias("band", "key")).groupBy(*where, "known").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy(*where).agg((F.sum("n") * one_in).alias("n"), (F.max("n") * one_in).alias("most"), F.max_by("known", F.struct("n", "known")).alias("main"))
    part = task_rows // 2
    hot = materialize(sizes.where(F.col("n") > task_rows).select(*where, "main", F.greatest(F.ceil((F.col("n") - F.col("most")) / part), F.lit(1)).cast("int").alias("others"), F.ceil(F.col("most") / part).cast("int").alias("mains"), "n", "most"), "hot-buckets")
    overfull = not hot.isEmpty()
    copied = [sum(counts)] * bands  # rows of each band
    if overfull:
        extra = hot.groupBy("band").agg(F.sum((F.col("n") - F.col("most")) * (F.col("others") + F.col("mains") - 1) + F.col("most") * (F.col("others") - 1)).alias("n"))
        for r in extra.collect():
            copied[r.band] += int(r.n)
    every, low, room = [], 0, max(ROUND_BANDS * sum(counts), ROUND_ROWS)
    while low < bands:
        high = low + 1
        while high < bands and sum(copied[low : high + 1]) <= room:
            high += 1
        total, own_bands = sum(copied[low:high]), F.slice("keys", low + 1, high - low)
        entries = signed.select("level", "id", "known", "half", F.posexplode(own_bands).alias("place", "key")).select("level", (F.col("place") + low).alias("band"), "key", "known", "id", "half")
        if not overfull:
            placed = entries.select(*where, *[F.lit(0).alias(c) for c in ("p", "q", "side")], "known", "id", "half")
        else:
            here = entries.join(F.broadcast(hot.drop("n", "most")), where, "left")
            main = F.col("known") == F.col("main")
            deal = F.xxhash64("id", "band", "key")
            own = F.when(F.col("main").isNull(), 0).when(main, F.col("others") + F.pmod(deal, F.col("mains"))).otherwise(F.pmod(deal, F.col("others"))).cast("int")
            met = F.when(F.col("main").isNull(), 1).when(main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
            spread = here.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
            placed = spread.select(*where, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "known", "id", "half")
        placed = placed.withColumn("unit", F.xxhash64(*units))  # one number to sort by
        ranged = placed.repartition(width(spark, total, 60_000), "unit").sortWithinPartitions("unit", *units)
        links = ranged.select(*units, "side", "known", "id", "half").mapInArrow(in_buckets(least, degrees), "level int, u bigint, v bigint, degree bigint")
        every.append(materialize(links.groupBy("level", "u", "v").agg(F.sum(F.greatest("degree", F.lit(0))).alias("degree")), "links"))
        low = high
    links = functools.reduce(DataFrame.unionByName, every)
    sure = links.where("degree > 0").select("level", "u", "v", "degree")
    doubt = links.where("degree = 0").select("level", "u", "v").distinct()
    if by:
        sure = sure.unionByName(materialize(signed.where("known <> id").select("level", F.col("id").alias("u"), F.col("known").alias("v"), F.lit(1).cast("bigint").alias("degree")), "led"))
    release(spark, signed_path)
    if doubt.isEmpty():
        return sure
    ends = distinct.select("level", "id", "vec")
    both = doubt.join(ends.withColumnsRenamed({"id": "u", "vec": "x"}), ["level", "u"]).join(ends.withColumnsRenamed({"id": "v", "vec": "y"}), ["level", "v"])
    exact = with_cosine(both.select("level", "u", "v", "x", "y"), "level int, u bigint, v bigint").where(F.col("cosine") >= least)
    return sure.unionByName(exact.select("level", "u", "v", F.lit(1).cast("bigint").alias("degree")))


def with_cosine(pairs: DataFrame, schema: str) -> DataFrame:
    """The columns before ``x`` and ``y`` (the last two) with the exact cosine of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (matrix(c).astype(np.float64) for c in batch.columns[-2:])
            score = np.einsum("ij,ij->i", x, y) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(score)], [*batch.schema.names[:-2], "cosine"])

    return pairs.mapInArrow(run, schema + ", cosine double")


def levels(chunk_vectors: DataFrame, super_vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Usable vectors of all levels as ``(id, level, vec)``; chunks are level 0, rows without a level belong to none."""
    base = unit_vectors(chunk_vectors, "chunk_id", "chunk_embedding", dim).select("id", F.lit(0).alias("level"), "vec")
    above = unit_vectors(super_vectors, "node_id", "super_embedding", dim, keep=("level",)).where(F.col("level").isNotNull())
    return base.unionByName(above.select("id", "level", "vec"))


def components(units: DataFrame, least: float = LEAST, dim: int = DIM, degrees: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(distinct, copies, links, groups)``; ``groups(level, node, component)`` are the vectors linked at ``least``, directly or through others.

    Cases: unusable vectors belong to no group; exact copies are linked to the
    smallest id among them and compared once; equal scores need no order; an empty
    level gives no rows. Every pair of a bucket is verified, in an overfull one
    block by block; without ``degrees`` not those already known to be of one group.
    """
    with shuffles_deleted(units.sparkSession):
        return linked(units, least, dim, degrees)


def linked(units: DataFrame, least: float, dim: int, degrees: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    base, distinct, copies = with_copies(units, "level")
    for path in {f.rpartition("/")[0] for f in base.inputFiles()}:
        release(units.sparkSession, path)
    links = materialize(similar_links(distinct, least, dim, degrees), "similar-links")
    edges = links.where("u <> v").select("level", "u", "v").unionByName(copies.where("id <> rep").select("level", F.col("id").alias("u"), F.col("rep").alias("v")))
    return distinct, copies, links, connected_components(edges, ("level",))


def similarity_groups(units: DataFrame, least: float = LEAST, dim: int = DIM) -> DataFrame:
    """``(level, first_id, member_id)``: every member of a group of two or more but the first."""
    groups = components(units, least, dim, degrees=False)[3]
    return groups.where("node <> component").select("level", F.col("component").alias("first_id"), F.col("node").alias("member_id"))


def chosen(least: float):
    """Over members sorted by group and rank: those not similar to a chosen one before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            marks, x = np.stack([np.asarray(c) for c in batch.columns[:2]], axis=1), matrix(batch.column(4)).astype(np.float64)
            kept = []
            for i in range(len(x)):
                if group is None or (marks[i] != group).any():
                    group, held, count = marks[i], np.empty((16, x.shape[1])), 0
                if not count or (held[:count] @ x[i]).max() < least:
                    if count == len(held):
                        held = np.concatenate([held, np.empty_like(held)])
                    held[count] = x[i]
                    count += 1
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def around(least: float):
    """Over rows sorted by group and share, medoids (by rank) before members: each member with the first medoid similar to it, else none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, x, medoids = None, [], [], np.zeros((0, 0))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marks, member = np.stack([np.asarray(c) for c in batch.columns[:3]], axis=1), np.asarray(batch.column(3)) == 1
            own, vecs = np.asarray(batch.column(5)), matrix(batch.column(7)).astype(np.float64)
            medoid, cosine, none = np.zeros(n, dtype=np.int64), np.zeros(n), np.ones(n, dtype=bool)
            edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1) | (member[1:] != member[:-1])) + 1, n]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if group is None or (marks[a] != group).any():
                    group, ids, x = marks[a], [], []
                if not member[a]:
                    ids.append(own[a:b])
                    x.append(vecs[a:b])
                    continue
                names, medoids = np.concatenate(ids), np.concatenate(x)
                for i in range(a, b, 512):
                    scores = vecs[i : min(i + 512, b)] @ medoids.T
                    near = scores >= least
                    near |= own[i : min(i + 512, b), None] == names[None, :]  # a medoid is its own, however its length was rounded
                    at = np.where(near.any(axis=1), near.argmax(axis=1), 0)
                    rows = np.arange(len(at))
                    medoid[i : i + len(at)], cosine[i : i + len(at)], none[i : i + len(at)] = names[at], scores[rows, at], ~near[rows, at]
            rows = pa.array(np.flatnonzero(member))
            columns = [*(batch.column(i) for i in (0, 1, 5, 6, 7)), pa.array(medoid, mask=none), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in columns], ["level", "component", "id", "degree", "vec", "medoid", "cosine"])

    return run


def clusters(units: DataFrame, least: float = LEAST, typical: int = 3, dim: int = DIM) -> DataFrame:
    """``(level, medoid, size, mean_cosine, typical)``: all usable vectors divided into clusters.

    A group whose members are not all similar to its medoid, the member of highest
    degree, is loose: those similar to the medoid stay, and the rest form around the
    next medoid, until all are placed. A round tries the next ``TRIED`` members of
    each group at once, later rounds more, with the result of one at a time.
    Unlinked vectors are clusters of one. ``size`` counts copies; ``typical`` lists
    the ids nearest the medoid, ties by id.
    """
    spark = units.sparkSession
    distinct, copies, links, groups = components(units, least, dim)
    degree = links.groupBy("level", F.col("u").alias("id")).agg(F.sum("degree").alias("degree"))
    member = groups.withColumnRenamed("node", "id").join(distinct, ["level", "id"]).join(degree, ["level", "id"], "left").fillna(0, ["degree"])
    open_ = materialize(member.select("level", "component", "id", "degree", "vec"), "open")
    group = ["level", "component"]
    done, tried = [], TRIED
    while n := open_.count():
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("degree"), "id"))
        first = open_.select(*group, rank.alias("rank"), "id", "vec").where(F.col("rank") <= tried)
        medoids = materialize(first.repartition(*group).sortWithinPartitions(*group, "rank").mapInArrow(chosen(least), "level int, component bigint, rank int, id bigint, vec binary"), "medoids")
        shares = open_.groupBy(*group).agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("shares"))
        asked = medoids.join(shares, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("member"), "rank", "id", F.lit(0).cast("bigint").alias("degree"), "vec")
        rows = open_.join(shares, group).select(*group, F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("member"), F.lit(0).alias("rank"), "id", "degree", "vec")
        order = [*group, "share"]
        both = asked.unionByName(rows).repartition(width(spark, n, 60_000), *order).sortWithinPartitions(*order, "member", "rank")
        scored = materialize(both.mapInArrow(around(least), "level int, component bigint, id bigint, degree bigint, vec binary, medoid bigint, cosine double"), "around-medoids")
        done.append(scored.where("medoid is not null").select("level", "medoid", "id", "cosine"))
        open_ = scored.where("medoid is null").drop("medoid", "cosine")
        tried = min(2 * tried, TRIED_MOST)
    placed = distinct.limit(0).select("level", F.col("id").alias("medoid"), "id", F.lit(1.0).alias("cosine"))
    for part in done:
        placed = placed.unionByName(part)
    alone = distinct.join(groups.select("level", F.col("node").alias("id")), ["level", "id"], "left_anti").select("level", F.col("id").alias("medoid"), "id", F.lit(1.0).alias("cosine"))
    placed = placed.unionByName(alone)
    others = copies.where("id <> rep").select("level", F.col("rep").alias("id"), F.col("id").alias("copy"))
    every = placed.unionByName(placed.join(others, ["level", "id"]).select("level", "medoid", F.col("copy").alias("id"), "cosine"))
    rank = F.row_number().over(Window.partitionBy("level", "medoid").orderBy(F.desc(F.round("cosine", 9)), "id"))
    named = every.withColumn("r", rank).where(F.col("r") <= typical).groupBy("level", "medoid").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    return every.groupBy("level", "medoid").agg(F.count("*").alias("size"), F.round(F.avg("cosine"), 6).alias("mean_cosine")).join(named, ["level", "medoid"])
