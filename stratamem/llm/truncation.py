"""Text cut off by field limits.

The length of every text is recomputed under the encodings a store may have
counted in; a pile of texts at the end of a source's lengths exposes a hidden limit.
Endings are then inspected: a text is cut when it stops inside a word, an escape,
a list or a sentence, or leaves open what it began with. For lists, which need no
closing mark, the last item is compared with the items known from the whole
table; at a hidden limit an unknown last item counts as cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.storage import latest, materialize

#: Remarks that tools append to finished texts.
REMARK = re.compile(r"(?:\s+(?:[✓✔☑✅]|\[\d+\]|\((?:ch|p|pp|sec|no|fig)\.?\s*\d+\)|#\d+|\*+))+\s*$", re.IGNORECASE)
BLANK = " \t\r\n\f\v\xa0​﻿　"
OPENING = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "【": "】", '"': '"'}
CLOSING = ")]}”»」』）】\"'’"
END = ".!?。！？؟।"
DOTS = re.compile(r"(?:…|\.{2,}|。{2,})$")
PARTIAL = re.compile(r"(?:�|&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?|%[0-9a-fA-F]{0,2}|<[^<>]{0,60})$")
HEAD = re.compile(r"^(?P<head>[^\W\d_]+(?: [^\W\d_]+)?) ?[:–—-] ")
SEPARATOR = re.compile(r"\s*[;,/|、，；·•]\s*|\n\s*")
#: A length is a hidden limit if this share of a source's texts, and as many of them, lie exactly at it, and it is the greatest;
PILE_SHARE, PILE = 0.02, 10
#: or if no more than this share of its texts is longer, and it has so many times the texts of any length so near.
ABOVE_SHARE, PEAK, NEAR = 0.05, 4, 5
#: A head introduces lists if so many texts under it have the form of one, and this share of its texts.
HEAD_ROWS, HEAD_SHARE = 3, 0.8
#: A name inside a sentence, not at the end of the text.
NAME = re.compile(r"(?<=[^\W\d_A-Z][ ,;] )[A-Z][^\W\d_]{2,}(?=[^\w]+\w)|(?<=[^\W\d_A-Z] )[A-Z][^\W\d_]{2,}(?=[^\w]+\w)")


def stripped(text: str) -> str:
    """The text without outer blanks and appended remarks."""
    return REMARK.sub("", text.strip(BLANK)).strip(BLANK)


def left_open(text: str) -> bool:
    """Whether a bracket or quotation at the beginning is never closed."""
    for c in text[:12]:
        if c not in OPENING:
            break
        if c == '"':
            if text.count('"') % 2:
                return True
        elif text.count(c) > sum(text.count(x) for x in OPENING[c]):
            return True
    return False


def list_parts(text: str) -> tuple[str, list[str]] | None:
    """``(head, items)`` if the text may be a list, an item being three words at most."""
    if text.startswith("#"):
        items = text.split(" ")
        return ("#", [i[1:] for i in items]) if all(i.startswith("#") for i in items) else None
    if re.match(r"^(?:[-*•]|\d+[.)]) ", text):
        items = [re.sub(r"^(?:[-*•]|\d+[.)]) ?", "", i) for i in text.split("\n")]
        return ("-", items) if all(len(i.split()) <= 3 for i in items) else None
    match = HEAD.match(text + " ")
    head, rest = (match["head"], text[match.end() :]) if match else ("", text)
    items = []
    for item in SEPARATOR.split(rest):
        sub = HEAD.match(item + " ")
        items.append(item[sub.end() :] if sub else item)
    if all(len(i.split()) <= 3 for i in items) and not re.search(r"[.!?。]", rest):
        return head, items
    return None


def ending(text: str) -> tuple[str, str, str, str]:
    """``(state, head, first, last)``: "whole", the kind of cut, or "list" with its head and outer items, to be looked up."""
    core = stripped(text)
    if not core:
        return "whole", "", "", ""
    if left_open(core):
        return "open", "", "", ""
    bare = core
    while bare and bare[-1] in CLOSING:
        bare = bare[:-1].rstrip(BLANK)
    if DOTS.search(bare):
        return "dots", "", "", ""
    if bare and bare[-1] in END:
        return "whole", "", "", ""
    if PARTIAL.search(bare) and not re.search(r"^\S+$", bare):
        return "escape", "", "", ""
    parts = list_parts(bare.lstrip("".join(OPENING)))
    if parts is None:
        return "sentence", "", "", ""
    head, items = parts
    if not items[-1] or bare[-1] in ";,/|:–—-#、，；":
        return "separator", head, "", ""
    return "list", head, items[0] if len(items) > 2 else "", items[-1]


def list_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What texts tell of lists: each head with and without list form, the items before the last, and names in sentences."""
    for f in frames:
        rows: Counter = Counter()
        for text in f.gist:
            core = stripped(text)
            bare = core.strip("".join(OPENING) + CLOSING)
            parts = list_parts(bare) if bare and bare[-1] not in END else None
            if parts:
                rows["list", parts[0], ""] += 1
                rows.update(("item", parts[0], i.lower()) for i in parts[1][:-1] if i)
            elif match := HEAD.match(bare):
                rows["other", match["head"], ""] += 1
            if not parts:
                rows.update(("name", "", w.lower()) for w in NAME.findall(core))
        yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["what", "head", "item", "n"])


def inspected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ends = [ending(t) for t in f.gist]
        yield pd.DataFrame({"chunk_id": f.chunk_id, "gist_source": f.gist_source, "lengths": f.lengths, "unsure": f.unsure, "state": [e[0] for e in ends], "head": [e[1] for e in ends], "first": [e[2].lower() for e in ends], "last": [e[3].lower() for e in ends]})


def unsure_bytes(text: str) -> F.Column:
    """Bytes that the text may have had less than now: U+FFFD, of 3, stands for 1 to 3 of a character cut at the end."""
    return F.when(F.col(text).endswith("\ufffd"), 2).otherwise(0)


def lengths(text: str) -> F.Column:
    """The text's length under each encoding, as a map; the least one where it is unsure."""
    c = F.col(text)
    n = F.length(c)
    count = lambda s: (F.length(c) - F.length(F.replace(c, F.lit(s)))).cast("int")
    breaks = F.length(c) - F.length(F.regexp_replace(c, "(?<!\r)\n", ""))
    beyond = F.length(F.regexp_replace(c, "[\\x00-\\x7f]", ""))
    return F.create_map(
        F.lit("characters"), n,
        F.lit("utf-8 bytes"), F.octet_length(c) - unsure_bytes(text),
        F.lit("utf-16 units"), (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"),
        F.lit("entities escaped"), n + 4 * count("&") + 3 * (count("<") + count(">")) + 5 * count('"'),
        F.lit("json escaped"), n + count('"') + count("\\") + count("\n") + count("\t"),
        F.lit("json in ascii"), n + count('"') + count("\\") + count("\n") + count("\t") + 5 * beyond,
        F.lit("line ends of two"), n + breaks,
        F.lit("characters before dots"), F.length(F.regexp_replace(c, r"\s?(\.{3}|…)\s*$", "")),
    )


def gists(metadata: DataFrame) -> DataFrame:
    """One row per chunk with a text that is not blank."""
    one = latest(metadata, "chunk_id", "gist", "gist_source")
    return one.where(F.length(F.regexp_replace("gist", "[\\s\\xa0]", "")) > 0)


def possible_lengths(sized: DataFrame, *columns: str) -> DataFrame:
    """``(*columns, encoding, limit, extra)``: each text's least length, and as ``extra`` those above it that it may have had."""
    each = sized.select(*columns, "unsure", F.explode("lengths").alias("encoding", "length"))
    extra = F.explode(F.sequence(F.lit(0), F.when(F.col("encoding") == "utf-8 bytes", F.col("unsure")).otherwise(0)))
    return each.select(*columns, "encoding", "length", extra.alias("extra")).select(*columns, "encoding", (F.col("length") + F.col("extra")).alias("limit"), "extra")


def hidden_limits(sized: DataFrame) -> DataFrame:
    """``(gist_source, encoding, limit, at_limit, texts)`` of the piles found at, or near, greatest lengths."""
    sure = F.sum((F.col("extra") == 0).cast("bigint"))
    histogram = possible_lengths(sized, "gist_source").groupBy("gist_source", "encoding", "limit").agg(F.count("*").alias("at_limit"), sure.alias("sure"))
    # a source has as many rows here as different lengths
    of = Window.partitionBy("gist_source", "encoding")
    by = of.orderBy("limit")
    around = F.greatest(*[F.coalesce(F.max("at_limit").over(by.rangeBetween(a, b)), F.lit(0)) for a, b in ((-NEAR, -1), (1, NEAR))])
    seen = histogram.withColumn("texts", F.sum("sure").over(of)).withColumn("above", F.coalesce(F.sum("sure").over(by.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))).withColumn("around", around)
    pile = (F.col("at_limit") >= PILE) & (F.col("at_limit") >= PILE_SHARE * F.col("texts"))
    peak = (F.col("above") <= ABOVE_SHARE * F.col("texts")) & (F.col("at_limit") >= PEAK * F.col("around"))
    return seen.where(pile & ((F.col("above") == 0) | peak)).select("gist_source", "encoding", "limit", "at_limit", "texts")


def begun(last: DataFrame, known: DataFrame) -> DataFrame:
    """``(last)``: those that begin a longer known item; joined at each length that occurs, so an item of any length counts."""
    sizes = [r.n for r in last.select(F.length("last").alias("n")).distinct().collect()]  # three words at most: a bounded number of lengths
    cut = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: n < F.length("item"))
    heads = known.select(F.explode(F.transform(cut, lambda n: F.left("item", n))).alias("last")).distinct()
    return last.join(heads, "last", "left_semi")


def truncated(metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cut, report, limits)``.

    ``cut(chunk_id, gist_source, reason)`` are the cut texts,
    ``report(gist_source, texts, cut, share)`` how often each source cuts,
    ``limits`` the hidden limits by encoding.

    Cases: null, empty and blank texts are no case and are not counted; a null
    source is a source of its own; repeated deliveries count once; appended
    remarks and closed wrappers are looked through; lists of null, empty or
    repeated entities only add what they have to the known items; an empty table
    gives empty results. Long texts are inspected whole.
    """
    sized = materialize(gists(metadata).withColumns({"lengths": lengths("gist"), "unsure": unsure_bytes("gist")}), "gists")
    limits = materialize(hidden_limits(sized), "limits")
    seen = materialize(sized.select("gist").mapInPandas(list_words, "what string, head string, item string, n bigint").groupBy("what", "head", "item").agg(F.sum("n").alias("n")), "list-words")
    entities = metadata.select(F.explode("entity_concepts").alias("item")).select(F.lower("item").alias("item")).where(F.length("item") > 1).distinct()
    lists_of = F.sum(F.when(F.col("what") == "list", F.col("n")).otherwise(0))
    heads = seen.where("what in ('list', 'other') and head <> ''").groupBy("head").agg(lists_of.alias("lists"), F.sum("n").alias("texts"))
    heads = heads.where((F.col("lists") >= HEAD_ROWS) & (F.col("lists") >= HEAD_SHARE * F.col("texts")) | F.col("head").isin("#", "-")).select("head", F.lit(True).alias("list_head"))
    items = seen.where("what = 'item'").join(heads, "head", "left_semi").select("item")
    known = materialize(entities.unionByName(items).unionByName(seen.where("what = 'name'").select("item")).distinct(), "known-items")
    ends = materialize(sized.select("chunk_id", "gist_source", "lengths", "unsure", "gist").mapInPandas(inspected, "chunk_id bigint, gist_source string, lengths map<string,int>, unsure int, state string, head string, first string, last string"), "endings")
    open_ = ends.where("state = 'list'")
    # an item is cut if it is unknown and begins a known one
    last = open_.select("last").distinct()
    starts = begun(last, known)
    # known items stay apart from what only begins them; both sides are vocabularies
    judged = last.join(known.select(F.col("item").alias("last"), F.lit(True).alias("is_known")), "last", "left").join(starts.withColumn("begins", F.lit(True)), "last", "left")
    at_limit = possible_lengths(open_, "chunk_id", "gist_source").join(limits.select("gist_source", "encoding", "limit"), ["gist_source", "encoding", "limit"], "left_semi").select("chunk_id").distinct().withColumn("full", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    # under a head of no lists it is a sentence that has just begun; without a head its outer items must be known
    first = known.select(F.col("item").alias("first"), F.lit(True).alias("first_known"))
    listed = open_.join(judged, "last", "left").join(heads, "head", "left").join(at_limit, "chunk_id", "left").join(first, "first", "left")
    headed = yes("list_head") & ~yes("is_known") & (yes("begins") | yes("full"))
    bad = headed | (~yes("list_head") & (F.col("head") != "")) | ((F.col("head") == "") & ~(yes("is_known") & yes("first_known")))
    lists = listed.where(bad).select("chunk_id", "gist_source", F.lit("list item").alias("reason"))
    cut = ends.where(~F.col("state").isin("whole", "list")).select("chunk_id", "gist_source", F.col("state").alias("reason")).unionByName(lists)
    cut = materialize(cut, "cut")
    report = sized.groupBy("gist_source").agg(F.count("*").alias("texts")).join(cut.groupBy(F.col("gist_source").alias("s")).agg(F.count("*").alias("cut")), F.col("gist_source").eqNullSafe(F.col("s")), "left").select("gist_source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"))
    return cut, report.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6)), limits
