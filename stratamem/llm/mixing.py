"""Mixing sources to target weights, by entropy balancing.

The rates of the documents are those nearest to using each once, in relative
entropy, that meet the token total of every source: exponentially tilted rates
``exp(t * x)`` of the document's length ``x``, cut off at the source's repeat
limit. The tilt of each source is the root of a convex dual, found by Newton steps
whose sums are Spark aggregates; the rates are then rounded into whole copies.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.storage import latest, materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hard limit on a rate's exponent, so that an extreme tilt stays finite.
STEEP = 60.0


def count_tokens(texts: DataFrame, key: str, text: str, keep: tuple[str, ...], folder: str = TOKENIZERS) -> DataFrame:
    """``(key, *keep, n_tokens)`` by a public byte-pair vocabulary, sent along from the driver; whole texts."""

    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        shared = texts.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, about a megabyte

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for frame in frames:
            frame["n_tokens"] = [len(encoder.encode_ordinary(t)) for t in frame.pop(text)]
            yield frame

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in texts.select(key, *keep).schema]
    return texts.select(key, *keep, text).mapInPandas(run, ", ".join([*fields, "n_tokens int"]))


def plain_source(column: str) -> F.Column:
    """A source's name without its spelling variants."""
    return F.lower(F.trim(F.col(column)))


def rate(x, tilt, most):
    """Tilted rate of a document of relative length ``x``."""
    return F.least(F.exp(F.least(F.greatest(tilt * x, F.lit(-STEEP)), F.lit(STEEP))), most)


def totals(spark: SparkSession, targets: list, counts: DataFrame) -> pd.DataFrame:
    """Documents, tokens and what ``max_repeats`` allows, of each target."""
    have = {r.source: r for r in counts.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens")).collect()}
    rows = [(t.source, float(t.target_share), int(t.max_repeats), *((have[t.source].docs, have[t.source].tokens) if t.source in have else (0, 0))) for t in targets]
    return pd.DataFrame(rows, columns=["source", "target_share", "max_repeats", "docs", "tokens"])


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """``(copies, shares)``.

    ``copies(doc_id, source, n_tokens, copies)`` lists the documents used;
    ``shares(source, target_share, max_repeats, available_tokens, wanted_tokens,
    tokens, share, documents)`` what was reached. Without ``total_tokens`` the
    mixture is as large as it can be with every source that has any tokens at its
    share; a source without documents gets none and the others keep their
    proportions. With it, a source that cannot supply its part even at
    ``max_repeats`` supplies all it can.

    Cases: sources are compared without case and outer blanks; documents of no
    source, or of one without a target, are not used; null and empty texts have no
    tokens and are not used; shares need not sum to one; repeated deliveries count
    once, full copies under another id are documents of their own; an empty table
    gives empty results. A source comes within one document of its part.
    The driver holds a row per target and histograms of bounded size.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    wanted = wanted.groupBy(plain_source("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()
    names = [t.source for t in wanted]
    docs = latest(documents, "doc_id", "text", "source").select("doc_id", plain_source("source").alias("source"), "text")
    docs = docs.where(F.col("source").isin(names) & (F.length("text") > 0))
    sized = materialize(count_tokens(docs, "doc_id", "text", ("source",), folder).where("n_tokens > 0"), "token-counts")
    counts = materialize(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")), "length-counts")
    plan = totals(spark, wanted, counts)
    live = plan.tokens > 0
    plan["room"] = plan.tokens * plan.max_repeats
    plan["part"] = np.where(live, plan.target_share, 0) / max(1e-300, plan.target_share[live].sum())
    size = total_tokens if total_tokens is not None else min((plan.room[live] / plan.part[live]).tolist(), default=0)
    plan["wanted"] = np.minimum(plan.part * size, plan.room)
    plan["mean"] = plan.tokens / plan.docs.clip(lower=1)

    # Newton on the dual of each source; outside a bracket that holds the root the step halves it
    tilt = {r.source: 0.0 for r in plan.itertuples() if r.tokens}
    low, high = {s: -STEEP for s in tilt}, {s: STEEP for s in tilt}
    info = {r.source: r for r in plan.itertuples() if r.tokens}
    open_ = {s for s, r in info.items() if r.wanted < r.room * (1 - 1e-12)}
    for _ in range(60):
        if not open_:
            break
        state = spark.createDataFrame([(s, tilt[s], float(info[s].mean), float(info[s].max_repeats)) for s in sorted(open_)], "source string, tilt double, mean double, most double")
        x = F.col("n_tokens") / F.col("mean")
        w = rate(x, F.col("tilt"), F.col("most"))
        sums = counts.join(F.broadcast(state), "source").groupBy("source").agg(
            F.sum(F.col("docs") * w * F.col("n_tokens")).alias("got"),
            F.sum(F.when(w < F.col("most"), F.col("docs") * w * F.col("n_tokens") * x).otherwise(0.0)).alias("slope"),
        )
        for r in sums.collect():
            gap = r.got - info[r.source].wanted
            if abs(gap) <= 1e-9 * info[r.source].wanted + 1e-6:
                open_.discard(r.source)
                continue
            (high if gap > 0 else low)[r.source] = tilt[r.source]
            step = tilt[r.source] - gap / r.slope if r.slope > 0 else np.inf
            lo, hi = low[r.source], high[r.source]
            tilt[r.source] = step if lo < step < hi else (lo + hi) / 2

    full = {s for s, r in info.items() if r.wanted >= r.room * (1 - 1e-12)}
    state = [(s, tilt[s], float(r.mean), float(r.max_repeats), s in full, float(r.wanted)) for s, r in info.items()]
    states = spark.createDataFrame(state or [("", 0.0, 1.0, 1.0, False, 0.0)], "source string, tilt double, mean double, most double, full boolean, wanted double")
    rated = sized.join(F.broadcast(states), "source").withColumn("rate", F.when(F.col("full"), F.col("most")).otherwise(rate(F.col("n_tokens") / F.col("mean"), F.col("tilt"), F.col("most"))))
    # rounding: the documents whose fraction lies farthest above their draw get one copy more, until the source has its tokens
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rounded = rated.select("doc_id", "source", "n_tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("rest"), draw.alias("draw"))
    rounded = rounded.withColumn("late", F.when(F.col("rest") > 0, (F.col("draw") - F.col("rest") + 1) / 2).otherwise(F.lit(None)))
    rounded = materialize(rounded.select("doc_id", "source", "n_tokens", "whole", "late"), "rates")
    cut = lateness(spark, rounded, {s: float(r.wanted) for s, r in info.items()})
    cuts = spark.createDataFrame([(s, float(c)) for s, c in cut.items()] or [("", 0.0)], "source string, cut double")
    copies = rounded.join(F.broadcast(cuts), "source").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce((F.col("late") < F.col("cut")).cast("int"), F.lit(0))).alias("copies")).where("copies > 0")
    got = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    table = spark.createDataFrame(
        [(r.source, r.target_share, r.max_repeats, int(r.tokens), int(round(r.wanted))) for r in plan.itertuples()],
        "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens bigint",
    ).join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over a row per target
    shares = table.withColumn("all_tokens", all_tokens).select("source", "target_share", F.coalesce(F.col("tokens") / F.nullif("all_tokens", F.lit(0)), F.lit(0.0)).alias("share"), "max_repeats", "most_copies", "available_tokens", "wanted_tokens", "tokens", "documents")
    return copies, shares


def lateness(spark: SparkSession, rounded: DataFrame, wanted: dict[str, float], cells: int = 1024, depth: int = 4) -> dict[str, float]:
    """For each source the value of ``late`` below which documents get their extra copy: a histogram, refined where the total is crossed."""
    base = {r.source: float(r.tokens or 0) for r in rounded.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("tokens")).collect()}
    lo, span = {s: 0.0 for s in wanted}, 1.0
    for _ in range(depth):
        if not lo:
            break
        state = spark.createDataFrame([(s, lo[s]) for s in lo], "source string, lo double")
        cell = F.floor((F.col("late") - F.col("lo")) / (span / cells))
        inside = rounded.where(F.col("late").isNotNull()).join(F.broadcast(state), "source").withColumn("cell", cell).where((F.col("cell") >= 0) & (F.col("cell") < cells))
        sums: dict[str, dict[int, int]] = {}
        for r in inside.groupBy("source", "cell").agg(F.sum("n_tokens").alias("tokens")).collect():
            sums.setdefault(r.source, {})[r.cell] = r.tokens
        for s in lo:
            here = base.get(s, 0.0)
            at = 0
            for at in range(cells):
                more = sums.get(s, {}).get(at, 0)
                if here + more > wanted[s]:
                    break
                here += more
            else:
                at = cells
            base[s], lo[s] = here, lo[s] + at * span / cells
        span /= cells
    return lo
