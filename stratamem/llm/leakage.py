"""Evaluation texts leaking into training text, by hash joins of canonical template windows.

A text becomes a sequence of words without case, accents, punctuation, markup and
spacing. Canonicalisation then replaces numbers, units and names by typed
placeholders; a name is any word outside the plain vocabulary of the evaluation
items, so a re-parameterised copy of an item has the item's template. Stretches of a
document whose every window of ``WINDOW`` canonical words is known are kept, and of
those the windows as long as a leak must be are hashed: verbatim ones by their
words, renamed ones by their template and by which of their slots hold the same
word, so that equal keys have consistent slots. A template that hundreds of items
share joins nothing by itself; only whole leaks do.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.llm.text import INNER, MIX, WORD, Lexicon, folded, mixed, shingles

WINDOW, RUN = 8, 12
#: A renamed copy has a template run of 2 * RUN words or, where that is less, of this share of the item's text, but no less than RUN.
MOST = 0.75
#: Windows with fewer plain words are compared word by word only.
PLAIN = 4
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ml l litre litres second seconds minute minutes hour hours day days week weeks month months year years percent degrees".split())
MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
UNSEEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
#: Bits of the filters that document windows pass, at least and at most; up to 2 ** 27 item windows no more than 1 in 16 is set.
FILTER_BITS, FILTER_MOST = 24, 31
#: Item windows that are broadcast to the join; more are shuffled. Characters of all items that the driver takes.
BROADCAST_ROWS, ITEM_CHARACTERS = 200_000, 1 << 28
VERBATIM = np.uint64(0x5851F42D4C957F2D)


def plain_words(text: str) -> list[str]:
    """Words without markup, entities, accents, case, punctuation and unseen marks."""
    if "<" in text:
        text = MARKUP.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = UNSEEN.sub("", text)
    return WORD.findall(INNER.sub("", folded(text)).replace("_", " "))


def classifier(vocabulary: dict[str, int]):
    """Class of a word: its own for plain words, 1 for names, 2 for numbers, 3 for units."""
    return lambda word: 2 if word[0].isdigit() else vocabulary.get(word, 1)


def template_windows(classes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, of its template or, where too few words are plain, of its words; and that of its words."""
    exact = shingles(words, WINDOW)
    if not len(exact):
        return exact, exact
    plain = np.cumsum(np.r_[0, classes > 3])
    loose = plain[WINDOW:] - plain[:-WINDOW] >= PLAIN
    return np.where(loose, shingles(mixed(classes * MIX), WINDOW), exact), exact


def item_words(texts: list[str]) -> tuple[dict[str, int], list[list[str]]]:
    """The vocabulary: words the items also use in lower case have their own class, numbers and units theirs."""
    lower: set[str] = set()
    split = []
    for text in texts:
        split.append(plain_words(text))
        for w in re.findall(r"\w+", INNER.sub("", text)):
            if w[0].islower():
                lower.update(plain_words(w))
    classes = {w: i + 4 for i, w in enumerate(sorted(lower - NUMBERS - UNITS))}
    return classes | dict.fromkeys(NUMBERS, 2) | dict.fromkeys(UNITS, 3), split


def renamed_run(words: int) -> int:
    """Words of a template run that make a renamed copy of a text of so many words."""
    return max(RUN, min(2 * RUN, math.ceil(MOST * words)))


def verbatim_keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the ``RUN`` words from each place."""
    h = words[at]
    for i in range(1, RUN):
        h = mixed(h * MIX + words[at + i])
    return h ^ VERBATIM


def template_keys(words: np.ndarray, windows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the template of the ``size`` words from each place, and of which of its words are the same.

    Two stretches have the same key if their windows agree and each word of one has
    one counterpart in the other: the places where each word first stands are equal.
    """
    out = np.zeros(len(at), dtype=np.uint64)
    place = mixed(np.arange(1, size + 1, dtype=np.uint64) * MIX)
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        h = windows[part]
        for k in range(1, size - WINDOW + 1):
            h = mixed(h * MIX + windows[part + k])
        w = words[part[:, None] + np.arange(size)]
        first = (w[:, :, None] == w[:, None, :]).argmax(axis=2).astype(np.uint64)
        out[i : i + 4096] = mixed(h * MIX + (mixed(first + place) * place).sum(axis=1, dtype=np.uint64)) ^ np.uint64(size)
    return out


def steps_left(hit: np.ndarray) -> np.ndarray:
    """How many places in a row are hit from each on."""
    stops = np.flatnonzero(np.r_[~hit, True])
    return stops[np.searchsorted(stops, np.arange(len(hit)))] - np.arange(len(hit))


class Filter:
    """Which keys may be known, as a bit table of bounded size."""

    def __init__(self, keys: np.ndarray):
        self.bits = min(FILTER_MOST, max(FILTER_BITS, int(np.ceil(np.log2(16 * max(1, len(keys)))))))
        self.table = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        places = np.unique(keys >> np.uint64(64 - self.bits))
        np.bitwise_or.at(self.table, (places >> np.uint64(3)).astype(np.int64), (1 << (places & np.uint64(7))).astype(np.uint8))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.bits)
        return (self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, longest_run, template_run, leak)`` for every document that holds part of an item.

    ``longest_run`` is the greatest number of consecutive words of the item's
    question or passage that the document holds, 0 if less than ``RUN``;
    ``template_run`` that of consecutive canonical words of which any
    ``renamed_run`` in a row have consistent slots. ``leak`` is "verbatim" from
    ``RUN`` words, else "renamed" when the template run reaches ``renamed_run`` of
    the question or passage.

    Cases: null and empty texts hold nothing; items are read once per id; a null
    question or passage is no text; texts shorter than ``RUN`` words cannot leak; a
    document listed twice counts once, and texts delivered under one id are no
    common text; further columns are ignored; an empty side gives no rows. All
    documents are read whole. The items are a stated set of ``ITEM_CHARACTERS`` at
    most (more is an error). Every row of the join is a whole leak; the items' side
    is broadcast up to ``BROADCAST_ROWS``, so a passage that very many documents
    hold is no hot task.
    """
    spark = documents.sparkSession
    one = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max(F.struct("question", "passage")).alias("t")).select("item_id", "t.*")
    length = one.agg(F.sum(F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("passage"), F.lit(0)))).first()[0] or 0
    if length > ITEM_CHARACTERS:
        raise ValueError(f"{length} characters of items exceed {ITEM_CHARACTERS}: ask in parts")
    texts = [(r.item_id, field, r[field]) for r in one.orderBy("item_id").collect() for field in ("question", "passage") if r[field]]
    vocabulary, split = item_words([t for _, _, t in texts])
    lexicon = Lexicon(classifier(vocabulary))
    rows, windows, keys = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for (item, field, _), tokens in zip(texts, split, strict=True):
        if len(tokens) < RUN:
            continue
        h, classes, _ = lexicon.look_up([tokens])
        window = template_windows(classes, h)[0]
        windows.append(window)
        need = renamed_run(len(tokens))
        for size, exact in ((RUN, True), (need, False)):
            at = np.arange(len(tokens) - size + 1)
            own = verbatim_keys(h, at) if exact else template_keys(h, window, at, size)
            keys.append(own)
            rows += [(k, item, field == "passage", i, size, exact) for i, k in enumerate(own.view(np.int64).tolist())]
    known = spark.createDataFrame(rows, "key bigint, item_id bigint, passage boolean, item_at int, size int, exact boolean")
    sizes = sorted({r[4] for r in rows if not r[5]})
    shared = spark.sparkContext.broadcast((vocabulary, Filter(np.concatenate(windows)), Filter(np.concatenate(keys)), sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_classes, may_be_window, may_be_leak, needed = shared.value
        lexicon = Lexicon(classifier(known_classes))
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                docs, copies = (np.asarray(batch.column(i).slice(part, 2000)) for i in (0, 2))
                h, classes, ends = lexicon.look_up([plain_words(t) for t in batch.column(1).slice(part, 2000).to_pylist()])
                window = template_windows(classes, h)[0]
                if not len(window):
                    continue
                hit = may_be_window(window)
                for k in range(1, WINDOW):  # no window reaches into the next text
                    over = ends - k
                    hit[over[(over >= 0) & (over < len(hit))]] = False
                left = steps_left(hit)
                found = []
                for size in (0, *needed):
                    at = np.flatnonzero(left >= (size or RUN) - WINDOW + 1)
                    own = template_keys(h, window, at, size) if size else verbatim_keys(h, at)
                    some = may_be_leak(own)
                    found.append((at[some], own[some]))
                at, own = (np.concatenate(c) for c in zip(*found, strict=True))
                if len(at):
                    of = np.searchsorted(ends, at, side="right")
                    inside = (at - np.r_[0, ends[:-1]][of]).astype(np.int32)
                    columns = [docs[of].astype(np.int64), copies[of], inside, own.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "copy", "at", "key"])

    read = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= RUN)).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("copy"))
    found = read.mapInArrow(scan, "doc_id bigint, copy bigint, at int, key bigint")
    both = found.join(F.broadcast(known) if len(rows) <= BROADCAST_ROWS else known, "key")
    line = ["doc_id", "copy", "item_id", "passage", "size", "exact", "diagonal"]
    placed = both.withColumn("diagonal", F.col("at") - F.col("item_at")).groupBy(*line, "at").agg(F.lit(1))
    island = F.col("at") - F.row_number().over(Window.partitionBy(*line).orderBy("at"))
    runs = placed.withColumn("island", island).groupBy(*line, "island").agg((F.count("*") + F.col("size") - 1).cast("int").alias("run"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("run"))), F.lit(0))
    by = runs.groupBy("doc_id", "item_id").agg(longest(F.col("exact")).alias("longest_run"), longest(~F.col("exact")).alias("template"))
    return by.select("doc_id", "item_id", "longest_run", F.greatest("template", "longest_run").alias("template_run"), F.when(F.col("longest_run") >= RUN, "verbatim").otherwise("renamed").alias("leak"))


def item_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with whether it leaked, into how many documents and by how long a run at most."""
    by = found.groupBy("item_id").agg(F.sum((F.col("leak") == "verbatim").cast("int")).alias("documents"), F.sum((F.col("leak") == "renamed").cast("int")).alias("renamed"), F.max("longest_run").alias("longest_run"))
    return items.where(F.col("item_id").isNotNull()).select("item_id").distinct().join(by, "item_id", "left").select(
        "item_id", (F.coalesce("documents", F.lit(0)) > 0).alias("leaked"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("renamed", F.lit(0)).alias("renamed"), F.coalesce("longest_run", F.lit(0)).alias("longest_run")
    )
