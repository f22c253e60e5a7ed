"""Scores of predictions: ROUGE with stemming, the best of several references, reports by question type."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.operators.runs import by_group_and_overall, last_wins

WORD = re.compile("[a-z0-9]+")
#: Suffixes of Porter's steps 2, 3 and 4 (1980): fixed values of the published algorithm.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def letters(word: str) -> str:
    """``c`` for each consonant, ``v`` for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return letters(stem).count("vc")


def closed(word: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return letters(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix there is a rule for, replaced if the rest measures more than ``least``."""
    fit = max((s for s in rules if word.endswith(s)), key=len, default=None)
    if fit is not None and measure(word[: -len(fit)]) > least:
        return word[: -len(fit)] + rules[fit]
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """Porter's stem; words of up to three letters are their own."""
    if len(word) <= 3:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in letters(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and letters(base)[-1] == "c" and base[-1] not in "lsz":
                    base = base[:-1]
                elif measure(base) == 1 and closed(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and "v" in letters(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2, 0), STEP_3, 0)
    fit = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if fit and measure(word[: -len(fit)]) > 1 and (fit != "ion" or word[-4] in "st"):
        word = word[: -len(fit)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not closed(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def common_subsequence(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is one pass of array operations."""
    codes = {w: i for i, w in enumerate(dict.fromkeys([*x, *y]))}
    b = np.array([codes[w] for w in y])
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in x:
        # the best of the row above and of a match at each place, carried on to the right
        row = np.maximum.accumulate(np.maximum(row, np.r_[0, np.where(b == codes[w], row[:-1] + 1, 0)]))
    return int(row[-1])


def rouge(rows: DataFrame, keys: tuple[str, ...], reference: str, prediction: str, stemmed: bool = True) -> DataFrame:
    """``(*keys, rouge1, rouge2, rougeL)``: F-measures of word, word pair and subsequence overlap; null texts are empty and score 0."""

    def f(hits: int, a: int, b: int) -> float:
        return round(2 * hits / (a + b), 6) if hits else 0.0

    def grams(words: list[str], n: int) -> dict[tuple[str, ...], int]:
        out: dict[tuple[str, ...], int] = {}
        for g in zip(*(words[i:] for i in range(n)), strict=False):
            out[g] = out.get(g, 0) + 1
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a, b in zip(frame[reference], frame[prediction], strict=True):
                x, y = ([stem(w) if stemmed else w for w in WORD.findall((t or "").lower())] for t in (a, b))
                one = []
                for n in (1, 2):
                    p, q = grams(x, n), grams(y, n)
                    one.append(f(sum(min(v, q.get(g, 0)) for g, v in p.items()), sum(p.values()), sum(q.values())))
                out.append((*one, f(common_subsequence(x, y) if x and y else 0, len(x), len(y))))
            yield frame[list(keys)].assign(**dict(zip(("rouge1", "rouge2", "rougeL"), zip(*out, strict=True), strict=True))) if out else frame[list(keys)].assign(rouge1=0.0, rouge2=0.0, rougeL=0.0)

    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, *dict.fromkeys([reference, prediction])).mapInPandas(run, ", ".join([*kinds, "rouge1 double", "rouge2 double", "rougeL double"]))


def best_over_references(scores: DataFrame, key: str, measures: tuple[str, ...]) -> DataFrame:
    """The greatest of each measure over the references of a key; a key without references has none."""
    return scores.groupBy(key).agg(*[F.max(m).alias(m) for m in measures])


def report(results: DataFrame, types: DataFrame, measures: tuple[str, ...], judge: str = "judge", fallback: str | None = None) -> DataFrame:
    """``(question_type, is_total, n, *measures, judge)``: means by type and over all, types in order and the total last.

    ``types(id, question_type, place)`` may list an id more than once: the last place
    holds. Results without an id, or of one that is not listed, are left out. A
    missing judgement is that of ``fallback``, else 0, as is a missing measure.
    """
    one = last_wins(types.where(F.col("id").isNotNull()), "id", "question_type", ["place"])
    said = F.coalesce(F.col(judge).cast("double"), *([F.col(fallback).cast("double")] if fallback else []), F.lit(0.0)).alias("_judge")
    rows = results.where(F.col("id").isNotNull()).join(one, "id").select(F.coalesce("question_type", F.lit("Unknown")).alias("question_type"), *measures, said)
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return by_group_and_overall(rows, "question_type", {"n": F.count("*"), **{m: mean(F.col(m)) for m in measures}, judge: mean(F.col("_judge"))})


def accuracy(rows: DataFrame, right: F.Column) -> DataFrame:
    """``(n, right, accuracy)``, 0 of nothing."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(right, F.lit(False)).cast("long")), F.lit(0)).alias("right")).withColumn("accuracy", F.col("right") / F.greatest(F.lit(1), F.col("n")))
