"""Splitting oversized texts at natural boundaries, by balanced targets.

The least number of pieces is computed, targets of equal length are placed and
each is snapped to the strongest boundary near it. When a limit fails (a cut
finds no sentence end within reach) the text is tried again with more pieces; where
that does not help, each cut is placed at the farthest sentence end instead, so that
none is missed that the limits allow.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary classes, strongest first; a cut is placed after the match.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…](?:[\"'”’»)\]]*)(?=\s|$)|[。！？](?:[”’」』）]*)"),
    re.compile(r"[;:,—–](?=\s)|[，、；：]"),
    re.compile(r"\s+"),
)
#: Up to this class a boundary is one at which text naturally pauses.
PAUSE = 2
PIECES = "chunk_id bigint, title string, piece_index int, n_pieces int, start int, end int, text string"


def joined(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` would part a character from its marks."""
    c = text[at]
    return unicodedata.combining(c) != 0 or c in "‍️︎" or "\U0001f3fb" <= c <= "\U0001f3ff" or text[at - 1] == "‍"


def farthest_cuts(text: str, size: int, overlap: int, found: list[list[int]]) -> tuple[int, list[int]]:
    """Cuts at the farthest sentence end within each piece, weaker places only where there is none; how many those are, and the ends."""
    length, end, weak, ends = len(text), 0, 0, []
    kinds = [sorted(set().union(*found[: PAUSE + 1])), *found[PAUSE + 1 :]]
    while length > (high := end - overlap + size if end else size):
        low = max(end, overlap) + 1
        for rank, places in enumerate(kinds):
            k = bisect_right(places, high)
            if k and places[k - 1] >= low:
                end = places[k - 1]
                weak += rank > 0
                break
        else:
            end, weak = high, weak + 1
            while end > low and end > high - 32 and joined(text, end):
                end -= 1
        ends.append(end)
    return weak, ends


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece: at most ``size`` long, the next starting ``overlap`` before the end.

    An overlap of ``size`` or more is taken as ``size - 1``, a negative or missing
    one as 0; a missing or non-positive size leaves the text whole.
    """
    length = len(text)
    if not size or size <= 0 or length <= size:
        return [(0, length)]
    overlap = max(0, min(overlap or 0, size - 1))
    found = [[m.end() for m in pattern.finditer(text)] for pattern in BOUNDARIES]
    step = size - overlap
    n = least = -(-(length - overlap) // step)
    best: tuple[tuple[int, int], list[tuple[int, int]]] | None = None
    while True:
        ends, weak, end = [], 0, 0
        for i in range(1, n):
            low = max(end + 1, length - size - (n - i - 1) * step + overlap, overlap + 1)
            high = min(size if i == 1 else end - overlap + size, length - 1)
            if low > high:
                break
            target = min(max(round(overlap + i * (length - overlap) / n), low), high)
            for near in (max(24, step // 4), step):
                a, b = max(low, target - near), min(high, target + near)
                for rank, places in enumerate(found):
                    j, k = bisect_left(places, a), bisect_right(places, b)
                    if j < k and (rank <= PAUSE or near == step):
                        m = bisect_left(places, target, j, k)
                        end = min(places[max(j, m - 1) : min(m + 1, k)], key=lambda p: abs(p - target))
                        break
                else:
                    continue
                break
            else:
                rank, end = len(found), target
                while end > low and end > target - 32 and joined(text, end):
                    end -= 1
            weak += rank > PAUSE
            ends.append(end)
        if len(ends) == n - 1:
            if best is None or weak < best[0][0]:
                best = ((weak, n), [*ends, length])
            if weak == 0:
                break
        if n > 2 * least + 2:
            break
        n = max(n + 1, n * 8 // 7)
    assert best is not None
    if best[0][0]:
        weak, ends = farthest_cuts(text, size, overlap, found)
        if weak < best[0][0]:
            best = ((weak, len(ends) + 1), [*ends, length])
    starts = [0, *(e - overlap for e in best[1][:-1])]
    return list(zip(starts, best[1], strict=True))


def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, title, text, size, overlap in zip(frame.chunk_id, frame.title, frame.text, frame.chunk_size, frame.chunk_overlap, strict=True):
            parts = cuts(text, int(size), 0 if pd.isna(overlap) else int(overlap))
            rows += [(key, title, i, len(parts), a, b, text[a:b]) for i, (a, b) in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["chunk_id", "title", "piece_index", "n_pieces", "start", "end", "text"])


def split_oversized(chunks: DataFrame) -> DataFrame:
    """The pieces of every text longer than its ``chunk_size``, in order, under the chunk's title.

    Cases: a null or empty text, and one that fits, gives no rows; a null or
    non-positive size likewise (there is no limit to keep); a null overlap is 0;
    rows delivered more than once count once, the latest delivery holding;
    further columns are ignored. Pieces without their overlaps concatenate to the
    text. Only oversized rows are shuffled and reach Python, each split on its
    own, so a hot document is no hot task.
    """
    over = chunks.where((F.col("chunk_size") > 0) & (F.length("text") > F.col("chunk_size")) & F.col("chunk_id").isNotNull())
    one = over.groupBy("chunk_id").agg(
        F.max_by(F.struct("title", "text", "chunk_size", "chunk_overlap"), F.struct("loaded_at", F.xxhash64("text", "title"))).alias("r")
    )
    return one.select("chunk_id", "r.*").mapInPandas(pieces, PIECES)
