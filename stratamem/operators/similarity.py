"""Pair scores, neighbour edges and query retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.storage import materialize, width

#: Rows of a block; a pair of blocks is one matrix product.
BLOCK = 2048
#: The same of a book, whose blocks are sent to each other: fewer copies of it.
BOOK_BLOCK = 16384


def scored_pairs(nodes: DataFrame, weight: float, sigma: float, gamma: float, masked: bool = False) -> DataFrame:
    """``(i, j, sim)``, ``i < j``, of the pairs that reach ``gamma``; ``nodes(id, vec[, doc])``.

    ``sim`` blends the cosine with the nearness of the ids, rounded to six places so
    that thresholds and ranks agree between engines; ``masked`` lets nearness count
    only within a document (null documents count as one). Rows are dealt into
    blocks, each pair of blocks is one task: a block's rows are sent to the blocks
    it meets, never row by row to each other. Where the threshold exceeds
    ``weight``, cosine alone cannot reach it and only blocks of near ids meet.
    """
    band = gamma > weight
    reach = sigma * math.sqrt(2 * math.log((1 - weight) / (gamma - weight))) if band and gamma < 1 else 0.0
    n = nodes.count()
    blocks = max(1, -(-n // BLOCK))
    base = nodes.select("id", F.expr("transform(vec, x -> cast(x as double))").alias("vec"), *(["doc"] if masked else []))
    if band:
        own = F.floor(F.col("id") / F.lit(max(1, math.ceil(reach)) * 64))
        meets = F.array(own, own + 1)
        keyed = base.withColumn("b", own).withColumn("other", F.explode(meets))
        keyed = keyed.select("*", F.col("other").alias("p"), F.lit(0).cast("bigint").alias("q"))
    else:
        own = F.pmod(F.xxhash64("id"), F.lit(blocks))
        keyed = base.withColumn("b", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keyed = keyed.withColumn("p", F.least("b", "other")).withColumn("q", F.greatest("b", "other"))

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id")
        ids = rows.id.to_numpy()
        x = np.stack(rows.vec.to_numpy()) if len(rows) else np.zeros((0, 1))
        norm = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(norm > 0, norm, np.inf)[:, None]
        b = rows.b.to_numpy()
        doc = rows["doc"].astype(object).where(rows["doc"].notna(), "\x00").to_numpy() if masked else None
        out = []
        for s in range(0, len(ids), 1024):
            cos = x[s : s + 1024] @ x.T
            near = np.exp(-((ids[s : s + 1024, None] - ids[None, :]).astype(float) ** 2) / (2 * sigma * sigma))
            if masked:
                near = near * (doc[s : s + 1024, None] == doc[None, :])
            sim = np.round(weight * np.maximum(0.0, cos) + (1 - weight) * near, 6)
            keep = (sim >= gamma) & (ids[s : s + 1024, None] < ids[None, :])
            if key[0] != key[1] and not band:
                keep &= b[s : s + 1024, None] != b[None, :]
            r, c = np.nonzero(keep)
            out.append(pd.DataFrame({"i": ids[r + s], "j": ids[c], "sim": sim[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "sim": []})

    pairs = keyed.groupBy("p", "q").applyInPandas(score, "i bigint, j bigint, sim double")
    return pairs.distinct() if band else pairs


def best(r: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best partners of each ``r``, ties by ascending id."""
    order = np.lexsort((ids, -sim, r))
    start = np.flatnonzero(np.r_[True, np.diff(r[order]) != 0]) if len(r) else np.zeros(0, int)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[place < k]


def picks_of_blocks(p: dict[str, np.ndarray], q: dict[str, np.ndarray], weight: float, sigma: float, gamma: float, k: int) -> tuple[np.ndarray, ...]:
    """``(i, j, sim)``: what the nodes of two blocks (or of one, if they are the same) pick of each other, ``k`` at most.

    Cosines in single precision tell which pairs far apart may reach ``gamma``; these and
    those near each other are scored in double precision.
    """
    same = p is q
    reach = sigma * math.sqrt(2 * math.log(max(1.0, (1 - weight) / 1e-9))) if weight < 1 else 0.0  # beyond it nearness adds less than 1e-9
    least = (gamma - 1e-6) / weight - 1e-4 if weight > 0 else math.inf
    every = gamma <= 2e-6
    by = np.argsort(q["at"], kind="stable")
    low, high = np.searchsorted(q["at"][by], p["at"] - reach), np.searchsorted(q["at"][by], p["at"] + reach, "right")
    x, y = p["x"].astype(np.float32), q["x"].astype(np.float32)
    rows, waiting = [], []

    def kept(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        i, j, sim = (np.concatenate(c) for c in zip(*parts, strict=True))
        at = best(i, j, sim, k)
        return i[at], j[at], sim[at]

    n, step = len(y), max(1, min(512, (1 << 24) // max(1, len(y))))
    for s in range(0, len(x), step):
        e = min(s + step, len(x))
        far = np.arange((e - s) * n) if every else np.flatnonzero(x[s:e] @ y.T >= least)
        m = high[s:e] - low[s:e]
        near = np.repeat(np.arange(e - s) * n, m) + by[np.arange(int(m.sum())) + np.repeat(low[s:e] - (np.cumsum(m) - m), m)]
        key = np.unique(np.concatenate([far, near]))
        r, c = key // n + s, key % n
        if same:
            r, c = r[(up := p["id"][r] < q["id"][c])], c[up]
        if len(r) * 64 > (e - s) * n:
            cos = (p["x"][s:e] @ q["x"].T)[r - s, c]
        else:
            cos = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", p["x"][r[t : t + 65536]], q["x"][c[t : t + 65536]]) for t in range(0, len(r), 65536)]])
        close = np.exp(-((p["at"][r] - q["at"][c]) ** 2) / (2 * sigma * sigma))
        if "doc" in p:
            close = close * (p["doc"][r] == q["doc"][c])
        sim = np.round(weight * np.maximum(0.0, cos) + (1 - weight) * close, 6)
        r, c, sim = r[(reached := sim >= gamma)], c[reached], sim[reached]
        rows.append(kept([(p["id"][r], q["id"][c], sim)]))
        waiting.append((q["id"][c], p["id"][r], sim))
        if sum(len(w[0]) for w in waiting) > 1 << 21:
            waiting = [kept(waiting)]
    parts = [*rows, kept(waiting)] if rows else [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def picks_in_books(nodes: DataFrame, weight: float, sigma: float, gamma: float, k: int, masked: bool = False) -> DataFrame:
    """``(i, j, sim)``: partners of the same book that reach ``gamma``, at least the ``k`` best of every node; ``nodes(book_id, id, at, vec[, doc_id])``.

    As :func:`scored_pairs`, with nearness by the place ``at`` in the book. A book of
    more than ``BOOK_BLOCK`` rows is dealt into blocks of which each pair is a task, so a
    book that holds a tenth of all rows is many tasks; small books share tasks. Of a
    pair of blocks only what is among the ``k`` best there is told. Rows without a
    vector, or of another length than the rest of their book, have no pairs.
    """
    usable = nodes.where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    sizes = usable.groupBy("book_id").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("n") / BOOK_BLOCK).cast("int")), "book-blocks")
    total, books = sizes.agg(F.sum("n"), F.count("*")).first()
    tasks = width(nodes.sparkSession, total or 0, BOOK_BLOCK // 4)
    alone = F.col("n") > BOOK_BLOCK // 8
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    columns = ["book_id", "id", F.col("at").cast("double").alias("at"), F.expr("transform(vec, x -> cast(x as float))").alias("vec"), *([F.col("doc_id").cast("string").alias("doc_id")] if masked else [])]
    base = usable.join(F.broadcast(sizes) if books <= 100_000 else sizes, "book_id").where(F.size("vec") == F.col("dim"))
    group = F.when(alone, F.col("book_id")).otherwise(F.pmod(F.xxhash64("book_id"), F.lit(tasks)).cast("string"))
    keyed = base.select(*columns, alone.alias("alone"), group.alias("task"), own.alias("b"), "blocks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = keyed.withColumn("p", F.least("b", "other")).withColumn("q", F.greatest("b", "other")).drop("other", "blocks")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        book = rows["book_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(book, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(book[order]) != 0])
        ids, at, b = (rows[c].to_numpy() for c in ("id", "at", "b"))
        vectors = rows["vec"].combine_chunks()
        flat, begin = vectors.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())]
        doc = rows["doc_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy() if masked else None
        for own in np.split(order, first[1:]):
            dim = begin[own[0] + 1] - begin[own[0]]
            x = flat[begin[own][:, None] + np.arange(dim)].astype(float)
            x = np.where(np.isfinite(x), x, 0.0)
            norm = np.sqrt((x * x).sum(axis=1))
            x = x / np.where(norm > 0, norm, np.inf)[:, None]
            blocks = []
            for k_ in np.unique(b[own]):
                here = np.flatnonzero(b[own] == k_)
                blocks.append({"id": ids[own][here], "at": at[own][here], "x": x[here], **({"doc": doc[own][here]} if masked else {})})
            if rows["p"][int(own[0])].as_py() == rows["q"][int(own[0])].as_py():
                blocks = [blocks[0], blocks[0]]
            if len(blocks) == 2:
                yield pa.record_batch([pa.array(c) for c in picks_of_blocks(*blocks, weight, sigma, gamma, k)], ["i", "j", "sim"])

    return keyed.repartition(max(tasks, 4 * nodes.sparkSession.sparkContext.defaultParallelism), "alone", "task", "p", "q").groupBy("alone", "task", "p", "q").applyInArrow(score, "i bigint, j bigint, sim double")


def knn_edges(pairs: DataFrame, k: int) -> DataFrame:
    """``(u, v, weight)``: the undirected union of every node's ``k`` best partners, ties by ascending id."""
    return picked_edges(pairs.select(F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j"), "sim"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))).alias("e")).select("e.*"), k)


def picked_edges(both: DataFrame, k: int) -> DataFrame:
    """The same of ``(i, j, sim)`` told from the side of each node."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    picks = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return picks.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col("sim").alias("weight")).distinct()


def query_topk(nodes: DataFrame, queries: DataFrame, k: int, book: str | None = None) -> DataFrame:
    """``(qid, [book,] node, score, rank)``: the ``k`` best nodes of every query by cosine, ties by node id.

    ``nodes(id, vec)``, ``queries(qid, vec)``; with ``book``, a column of both, a query
    only asks the nodes of its own. The queries are a stated set: they go in blocks of
    ``BLOCK`` against all nodes, and each batch of nodes keeps ``k`` per query before
    anything is shuffled. The blocks are parts of one column, so the nodes are read
    once a block by parallel stages of one job.
    """
    spark = nodes.sparkSession
    keep = [book] if book else []
    asked = materialize(queries.select("qid", *keep, "vec").where(F.col("vec").isNotNull()), "queries")
    parts = max(1, -(-asked.count() // BLOCK))
    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in keep]
    out = None
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).toPandas()
        q = np.stack([np.asarray(v, dtype=float) for v in block.vec]) if len(block) else np.zeros((0, 1))
        q = q / np.maximum(np.sqrt((q * q).sum(1)), 1e-150)[:, None]
        shared = spark.sparkContext.broadcast((block.qid.to_numpy(), block[book].to_numpy() if book else None, q))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, own, q = shared.value
            for f in frames:
                f = f[f.vec.map(lambda v: v is not None and len(v) == q.shape[1]).to_numpy(dtype=bool)]
                for name, rows in f.groupby(book, sort=False) if book else [(None, f)]:
                    some = np.flatnonzero(own == name) if book else np.arange(len(qid))
                    if not len(some) or not len(rows):
                        continue
                    x = np.stack([np.asarray(v, dtype=float) for v in rows.vec])
                    x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-150)[:, None]
                    score, ids = np.round(q[some] @ x.T, 6), rows.id.to_numpy()
                    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                    r = np.repeat(np.arange(len(some)), order.shape[1])
                    found = {"qid": qid[some][r], **({book: name} if book else {}), "node": ids[order.ravel()], "score": score[r, order.ravel()]}
                    yield pd.DataFrame(found)

        schema = ", ".join([f"qid {queries.schema['qid'].dataType.simpleString()}", *kinds, "node bigint", "score double"])
        found = nodes.select("id", *keep, "vec").mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
