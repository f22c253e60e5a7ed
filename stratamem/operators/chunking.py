"""Packing of paragraphs and turns into chunks of bounded token number.

A book is one text, and a chunk is a span of it. Token starts, sentence ends, clause
ends and blanks are found once per book as sorted offsets; how many tokens a span
holds and where it is best cut are then binary searches, so the work is linear in
the text whatever the number of cuts.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
#: Sentence and clause ends; a quotation mark right after a stop is an end of its own.
SENTENCE, CLAUSE = re.compile(r"""[.?!]|(?<=[.?!])["']"""), re.compile(r"""[.?!,]|(?<=[.?!])["']""")
BLANK = re.compile("[ \n]")
TURN = re.compile(r"([^:\n]{1,40}): (.*)", re.S)


def ws_count(text: str) -> int:
    """Tokens between ASCII blanks, as in :func:`stratamem.functions.text.ws_tokens`."""
    return len(TOKEN.findall(text))


def ws_starts(text: str) -> list[int]:
    """Where the tokens between blanks begin."""
    return [m.start() for m in TOKEN.finditer(text)]


@cache
def bpe_starts(path: str, pattern: str = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""") -> Callable[[str], list[int]]:
    """The same of a public byte-pair vocabulary, one ``base64 rank`` a line; the file must be where the workers run."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.decode_with_offsets(encoding.encode_ordinary(text))[1]


class Ruled:
    """A text with its offsets; spans are ``[a, b)``."""

    def __init__(self, text: str, starts: Callable[[str], list[int]] = ws_starts):
        self.text, self.starts = text, starts(text)
        self.sentences = [m.start() for m in SENTENCE.finditer(text)]
        self.clauses = [m.start() for m in CLAUSE.finditer(text)]
        self.blanks = [m.start() for m in BLANK.finditer(text)]

    def tokens(self, a: int, b: int) -> int:
        """Tokens of a span; the rest of a token that a cut has parted counts as one."""
        i = bisect_left(self.starts, a)
        parted = i > 0 and (i == len(self.starts) or self.starts[i] > a) and a < b and not self.text[a].isspace() and not self.text[a - 1].isspace()
        return bisect_left(self.starts, b) - i + parted

    def reach(self, a: int, size: int) -> int:
        """The farthest end of a span from ``a`` that holds no more than ``size`` tokens."""
        i = bisect_left(self.starts, a) + size - (self.tokens(a, len(self.text)) - (len(self.starts) - bisect_left(self.starts, a)))
        return self.starts[max(0, i)] if i < len(self.starts) else len(self.text)

    def cut(self, a: int, b: int, size: int, before: int = 0, before_tokens: int = 0) -> int:
        """Where to end a piece that begins at ``a``, so that it has at most ``size`` tokens.

        After the last sentence end that fits, the final one of the span left out;
        else the last clause end of the first sentence; else a blank, no farther
        than its share of the characters, and never inside the first token.
        ``before`` characters of ``before_tokens`` tokens stand in front of it.
        """
        far = self.reach(a, max(1, size - before_tokens))
        for ends in (self.sentences, self.clauses):
            first, last = bisect_left(ends, a), bisect_left(ends, b) - 1  # all but the final one
            if last > first:
                fits = bisect_right(ends, far - 1, first, last)
                if fits > first:
                    return ends[fits - 1] + 1
                b = ends[first] + 1
        share = int((before + b - a) * size / (before_tokens + self.tokens(a, b))) - 1 - before + a
        i = bisect_right(self.blanks, min(share, far))
        if i and self.blanks[i - 1] > a and self.tokens(a, self.blanks[i - 1]):
            return self.blanks[i - 1] + 1
        inside = TOKEN.search(self.text, a, b)
        return min(inside.end() + 1, b) if inside else b


def pieces(ruled: Ruled, a: int, b: int, size: int, prefix: str = "", bare: bool = False) -> tuple[list[tuple[str, int, int]], tuple[str, int, int]]:
    """A span over ``size`` in ``(prefix, start, end)`` pieces, and the rest that may still grow; only the first can do without its prefix (``bare``)."""
    out = []
    front, extra = "" if bare else prefix, 0 if bare else ws_count(prefix)
    while a < b and extra + ruled.tokens(a, b) > size:
        end = ruled.cut(a, b, size, len(front), extra)
        if end >= b:
            break
        out.append((front, a, end))
        a, front, extra = end, prefix, ws_count(prefix)
    return out, (front, a, b)


def spans(ruled: Ruled, parts: list[tuple[int, int, int]], size: int, speakers: list[str]) -> Iterator[list[tuple[str, int, int]]]:
    """Chunks as lists of ``(prefix, start, end)``; ``parts(start, content start, end)`` in order, ``speakers`` as they are written."""
    open_: list[tuple[str, int, int]] = []

    def held(end: int) -> int:
        return sum(ws_count(p) + ruled.tokens(x, end if k == len(open_) - 1 else y) for k, (p, x, y) in enumerate(open_))

    for (a, content, b), speaker in zip(parts, speakers, strict=True):
        if ruled.tokens(content, b) > size:
            front, start = (open_[-1][0], open_[-1][1]) if open_ else ("", a)
            # what is open is a part of the first piece: its prefix, if any, stays in front
            done, rest = pieces(ruled, start, b, size, speaker, bare=not front)
            if front and done:
                done[0] = (front, *done[0][1:])
            yield from ([p] for p in done)
            open_ = [rest]
        elif open_ and held(b) > size:
            yield open_
            open_ = [("", a, b)]
        else:
            open_ = [(open_[-1][0], open_[-1][1], b)] if open_ else [("", a, b)]
    if open_ and (open_[-1][0] or open_[-1][1] < open_[-1][2]):
        yield open_


def pack(parts: list[str], size: int, prefixes: list[str] | None = None, starts: Callable[[str], list[int]] = ws_starts) -> list[str]:
    """Greedy chunks of the parts joined by newlines; a part over ``size`` is cut, its speaker repeated on each rest.

    A speaker's own tokens count for the chunk but not for whether a turn is cut, so
    a turn just within ``size`` may exceed it with its speaker; no chunk is empty.
    """
    speakers = [f"{p}: " for p in prefixes] if prefixes else [""] * len(parts)
    ruled = Ruled("\n".join(s + p for s, p in zip(speakers, parts, strict=True)), starts)
    places, at = [], 0
    for s, p in zip(speakers, parts, strict=True):
        places.append((at, at + len(s), at + len(s) + len(p)))
        at += len(s) + len(p) + 1
    return ["".join(p + ruled.text[a:b] for p, a, b in chunk) for chunk in spans(ruled, places, size, speakers)]


def split_turn(role: str, content: str, size: int, starts: Callable[[str], list[int]] = ws_starts) -> list[str]:
    """A turn as ``role: content``, in several of at most ``size`` tokens where it has more; blank rests are dropped."""
    prefix = f"{role}: "
    ruled = Ruled(prefix + content, starts)
    done, rest = pieces(ruled, 0, len(ruled.text), size, prefix, bare=True)
    return [p + ruled.text[a:b] for p, a, b in [*done, rest] if not done or ruled.text[a:b].strip()]


def lines_of(text: str, include_empty: bool) -> list[str]:
    return [p for p in text.split("\n") if include_empty or TOKEN.search(p)]


def chunk_texts(rows: DataFrame, size: int, turns: bool = False, include_empty: bool = False, single: bool = False, starts: Callable[[], Callable[[str], list[int]]] = lambda: ws_starts) -> DataFrame:
    """``(book_id, chunk_id, text, n_tokens)`` of ``rows(book_id, text)``.

    With ``turns`` the lines are ``role: content``; with ``single`` each turn is a
    chunk, cut where it is longer than ``size``. ``starts`` makes the tokenizer, in
    the worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = starts()
        for f in frames:
            out = []
            for book, text in zip(f.book_id, f.text, strict=True):
                lines = lines_of(text, include_empty)
                if turns:
                    said = [(m.group(1), m.group(2)) if (m := TURN.match(p)) else ("Unknown", p) for p in lines]
                    chunks = [c for r, t in said for c in split_turn(r, t, size, tokenizer)] if single else pack([t for _, t in said], size, [r for r, _ in said], tokenizer)
                else:
                    chunks = pack(lines, size, starts=tokenizer)
                out += [(book, i, c, len(tokenizer(c))) for i, c in enumerate(chunks)]
            yield pd.DataFrame(out, columns=["book_id", "chunk_id", "text", "n_tokens"])

    return rows.where(F.col("text").isNotNull()).mapInPandas(run, "book_id bigint, chunk_id int, text string, n_tokens int")


def greedy_sizes(rows: DataFrame, size: int) -> DataFrame:
    """``(book_id, chunk_id, n_parts, n_tokens)`` of greedy packing by token numbers alone.

    ``rows(book_id, counts array<int>)``. Each chunk's end is a binary search in the
    running totals of its book, so a long book costs no more per paragraph than a short one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books, lists = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for book, counts in zip(books, lists, strict=True):
                total = np.cumsum(np.asarray(counts.values if counts.is_valid else [], dtype=np.int64))
                at = before = number = 0
                while at < len(total):
                    end = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
                    out.append((book, number, end - at, int(total[end - 1]) - before))
                    at, before, number = end, int(total[end - 1]), number + 1
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["book_id", "chunk_id", "n_parts", "n_tokens"])

    return rows.select("book_id", "counts").mapInArrow(run, f"book_id {rows.schema['book_id'].dataType.simpleString()}, chunk_id int, n_parts int, n_tokens int")
