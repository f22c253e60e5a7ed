"""Contiguous runs of ids, latest values, grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Consecutive ids whose run begins are looked for by one task.
SPAN = 4096


def contiguous_runs(rows: DataFrame, key: str, node: str, text: str) -> DataFrame:
    """``(key, node_id, n, text)``: texts of consecutive ids joined by a blank, under the last id of the run.

    An id begins a run if the id before it is not there, which is a join on key and
    id; the others take the last beginning in their span of ``SPAN`` ids or, if there
    is none, that of the spans before, of which each is one row. A key with a third
    of all rows is thus many tasks. Rows without a key or id are dropped; ids are
    unique within a key.
    """
    base = rows.where(F.col(key).isNotNull() & F.col(node).isNotNull()).select(key, node, text)
    before = base.select(key, (F.col(node) + 1).alias(node), F.lit(True).alias("_follows"))
    marked = base.join(before, [key, node], "left").withColumn("_span", F.floor(F.col(node) / SPAN)).withColumn("_begin", F.when(F.col("_follows").isNull(), F.col(node)))
    spans = marked.groupBy(key, "_span").agg(F.max("_begin").alias("_last"))
    carried = F.last("_last", True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(key, "_span", carried.alias("_carried"))
    own = F.max("_begin").over(Window.partitionBy(key, "_span").orderBy(node).rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.withColumn("_own", own).join(spans, [key, "_span"]).withColumn("_run", F.coalesce("_own", "_carried"))
    runs = placed.groupBy(key, "_run").agg(F.max(node).alias("node_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(node, text))).alias("parts"))
    return runs.select(key, "node_id", "n", F.array_join(F.transform("parts", lambda p: p[text]), " ").alias("text"))


def last_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of each key's last row; combined map-side."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def by_group_and_overall(rows: DataFrame, group: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by group and over all rows, told apart by grouping and not by name; groups in order, the total last."""
    sets = rows.groupingSets([[F.col(group)], []], F.col(group))
    out = sets.agg(F.grouping(group).alias("is_total"), *[m.alias(n) for n, m in measures.items()])
    return out.orderBy("is_total", group)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """``struct(precision, recall, f1)``, 0 where nothing can be divided."""
    p = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))
    r = F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def claim_confusion(rows: DataFrame, gold: Column, guess: Column) -> DataFrame:
    """One row of counts per class; a guess that is neither counts against both."""
    g, p = F.lower(F.trim(gold)) == "yes", F.lower(F.trim(guess))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = rows.agg(
        n(g & (p == "yes")).alias("tp_true"), n(g & (p != "yes")).alias("fn_true"), n(~g & (p != "no")).alias("fp_true"),
        n(~g & (p == "no")).alias("tp_false"), n(~g & (p != "no")).alias("fn_false"), n(g & (p != "yes")).alias("fp_false"), F.count("*").alias("n"),
    )
    for side in ("true", "false"):
        counts = counts.withColumn(f"f1_{side}", F.round(f1(F.col(f"tp_{side}"), F.col(f"fp_{side}"), F.col(f"fn_{side}"))["f1"], 6))
    return counts
