"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(c: Column) -> Column:
    """Strip all outer white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    bare = F.regexp_replace(F.lower(c), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def answer_tokens(c: Column) -> Column:
    """Distinct tokens of a normalised answer; an empty answer has one empty token."""
    return F.array_distinct(F.split(normalize_answer(c), "[ -]", -1))


def token_scores(gold: Column, guess: Column) -> Column:
    """``struct(precision, recall, f1)`` over token sets."""
    a, b = answer_tokens(gold), answer_tokens(guess)
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.size(b), both / F.size(a)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(both == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def sanitize_filename(c: Column) -> Column:
    """A name fit for a file: reserved characters replaced, trimmed, 200 characters at most, never empty."""
    name = F.left(F.trim(F.regexp_replace(c, r'[\\/*?:"<>|]', "_")), F.lit(200))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("doc"))


def entity_list(c: Column) -> Column:
    """First five distinct items of a ``;`` list, blanks dropped only after the cut."""
    items = F.array_distinct(F.transform(F.split(c, ";", -1), trim_ws))
    return F.filter(F.slice(items, 1, 5), lambda x: x != "")


def ws_tokens(c: Column) -> Column:
    """Number of white-space tokens."""
    t = trim_ws(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+", -1)))


def json_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def title_stem(c: Column) -> Column:
    """A chunk title without its chunk suffix."""
    return F.regexp_replace(c, r"_chunk(ed)?_.*$", "")


def first_filled(*columns: Column) -> Column:
    """The first column that is not null, empty or blank, trimmed."""
    return F.coalesce(*[F.nullif(trim_ws(F.coalesce(c, F.lit(""))), F.lit("")) for c in columns])


def record_title(row: list[str], body: str, key: str) -> Column:
    """Title, headline or name, else the first line of the body (120 characters), else ``doc_`` and the key; ``row`` names the columns there are."""
    named = [F.col(c) for c in ("title", "headline", "name") if c in row]
    first = F.left(trim_ws(F.split(trim_ws(F.coalesce(F.col(body), F.lit(""))), "\n", -1)[0]), F.lit(120))
    return F.coalesce(*([first_filled(*named)] if named else []), F.nullif(first, F.lit("")), F.concat(F.lit("doc_"), F.col(key).cast("string")))


def record_text(row: list[str], field: str = "body") -> Column:
    """The wanted field, else text, body or content, else the whole record as JSON."""
    return F.coalesce(*[F.col(c) for c in dict.fromkeys([field, "text", "body", "content"]) if c in row], F.to_json(F.struct(*row)))
