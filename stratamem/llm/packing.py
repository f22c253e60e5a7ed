"""Filling containers of one capacity, by exact-complement hashing over length counts.

How many items of each length exist is all the plan needs: at most ``capacity``
counters, however many items there are. The plan opens containers with the
longest lengths and looks the remaining gap up among the available singles,
pairs and triples of lengths that fill it exactly; what has no complement goes
best fit. A combination is consumed as often as its counts allow, which uses up
one length at least, so there are never more combinations than lengths. Items
then find their place by their rank among the items of their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.llm.splitting import cuts
from stratamem.storage import materialize

CAPACITY = 4096
#: Rows of one length ranked by one task; longer runs are salted.
RANK_ROWS = 50_000


def complement(available: np.ndarray, gap: int) -> tuple[int, ...]:
    """One to three available lengths that sum to ``gap``, or nothing."""
    left = available[: gap + 1].copy()
    if left[gap] > 0:
        return (gap,)

    have = np.flatnonzero(left[1:]) + 1

    def pair(total: int) -> tuple[int, int] | None:
        low = have[: np.searchsorted(have, total // 2, side="right")]
        good = left[total - low] > (low * 2 == total)
        at = int(good.argmax()) if len(low) else 0
        return (int(total - low[at]), int(low[at])) if len(low) and good[at] else None

    if gap >= 2 and (two := pair(gap)):
        return two
    for first in have[: np.searchsorted(have, gap - 2, side="right")][::-1]:
        # the first is the longest of the three, so that none is looked up twice
        if 3 * first < gap:
            break
        left[first] -= 1
        two = pair(int(gap - first))
        left[first] += 1
        if two:
            return (int(first), *two)
    return ()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(items of each length, number of containers)``; every counted item is placed exactly once."""
    available = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        available[length] += n
    mean = max(1, int((available * np.arange(capacity + 1)).sum() / max(1, available.sum())))
    out: list[tuple[dict[int, int], int]] = []
    while True:
        if not available[1:].any():
            return out
        left = available.copy()
        used: Counter = Counter()
        gap = capacity
        while gap:
            # longest first until three further items can be expected to close the gap
            if used and gap <= 4 * mean and (fill := complement(left, gap)):
                used.update(fill)
                break
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1]) + 1
            used[longest] += 1
            left[longest] -= 1
            gap -= longest
        times = min(int(available[x] // n) for x, n in used.items())
        for x, n in used.items():
            available[x] -= n * times
        out.append((dict(used), times))


def sized(chunks: DataFrame, capacity: int) -> DataFrame:
    """``(chunk_id, piece, n_chars)``: whole texts, and the pieces of those alone longer than a container."""
    one = chunks.where(F.col("chunk_id").isNotNull() & (F.length("text") > 0)).groupBy("chunk_id").agg(
        F.max_by(F.struct(F.length("text").alias("n"), F.when(F.length("text") > capacity, F.col("text")).alias("text")), F.struct("loaded_at", F.xxhash64("text"))).alias("r")
    )
    one = one.select("chunk_id", "r.*")

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, b - a) for k, t in zip(frame.chunk_id, frame.text, strict=True) for i, (a, b) in enumerate(cuts(t, capacity, 0))]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "n_chars"])

    whole = one.where(F.col("n") <= capacity).select("chunk_id", F.lit(0).alias("piece"), F.col("n").cast("int").alias("n_chars"))
    large = one.where(F.col("n") > capacity).select("chunk_id", "text").mapInPandas(parts, "chunk_id bigint, piece int, n_chars int")
    return whole.unionByName(large)


def pack(chunks: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(chunk_id, piece, n_chars, container_id)``: every text in a container, whole unless longer than one.

    Cases: null and empty texts take no room and give no rows; blank texts are
    texts; a text longer than ``capacity`` is first cut at natural boundaries,
    its pieces numbered from 0; repeated deliveries count once; equal lengths are
    told apart by a hash of the id, so the outcome is the same on every run; an
    empty table gives no rows. The driver holds one counter per length
    (``capacity`` at most) and the combinations (no more than that); a look-up tries
    the lengths in use for two of a triple, so a plan costs the square of the number
    of lengths for each combination at worst: seconds at 4,096, not for capacities of
    a million.
    """
    spark = chunks.sparkSession
    items = materialize(sized(chunks, capacity), "pack-items")
    counts = {r.n_chars: r.n for r in items.groupBy("n_chars").agg(F.count("*").alias("n")).collect()}
    combos = plan(counts, capacity)
    salts = {x: -(-n // RANK_ROWS) for x, n in counts.items()}
    # ranks 0.. of a length are dealt to the combinations that use it, in order
    starts: dict[int, list[tuple[int, int, int]]] = {x: [] for x in counts}
    taken: Counter = Counter()
    container = 0
    for used, times in combos:
        for x, n in used.items():
            starts[x].append((taken[x], n, container))
            taken[x] += n * times
        container += times
    runs = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for x, v in starts.items()}
    salt_of = np.ones(capacity + 1, dtype=np.int64)
    for x, k in salts.items():
        salt_of[x] = k
    shared = spark.sparkContext.broadcast(runs)
    salt_map = F.create_map(*[F.lit(int(v)) for x, k in salts.items() if k > 1 for v in (x, k)]) if any(k > 1 for k in salts.values()) else None
    h = F.xxhash64("chunk_id", "piece")
    salt = F.pmod(h, F.coalesce(salt_map[F.col("n_chars")], F.lit(1)).cast("bigint")) if salt_map is not None else F.lit(0).cast("bigint")
    salted = items.withColumn("h", h).withColumn("salt", salt)
    before = salted.groupBy("n_chars", "salt").agg(F.count("*").alias("n"))
    before = before.select("n_chars", "salt", (F.sum("n").over(Window.partitionBy("n_chars").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("n_chars", "salt").orderBy("h", "chunk_id", "piece")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["n_chars", "salt"]).select("chunk_id", "piece", "n_chars", (F.col("rank") + F.col("before")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths, ranks = frame.n_chars.to_numpy(), frame["rank"].to_numpy()
            at = np.empty(len(frame), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                first, each, box = shared.value[int(lengths[x[0]])]
                i = np.searchsorted(first, ranks[x], side="right") - 1
                at[x] = box[i] + (ranks[x] - first[i]) // each[i]
            yield pd.DataFrame({"chunk_id": frame.chunk_id, "piece": frame.piece, "n_chars": frame.n_chars, "container_id": at})

    return ranked.mapInPandas(place, "chunk_id bigint, piece int, n_chars int, container_id bigint")


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, share of the room used, and how full the emptiest is."""
    box = placed.groupBy("container_id").agg(F.sum("n_chars").alias("used"), F.count("*").alias("items"))
    return box.agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"),
        F.sum((F.col("used") == capacity).cast("long")).alias("full"), F.min("used").alias("least_used"), F.max("used").alias("most_used"),
    )
