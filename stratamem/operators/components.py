"""Connected components over an edge table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.storage import Rounds, release, stored


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """``(*keys, node, component)`` for the nodes of ``edges(*keys, u, v)``; component is the smallest node id.

    Each round a node takes the least label among itself and its neighbours and
    then follows that label's own label (pointer jumping), so labels travel
    exponentially far. Only minima are aggregated, which combines map-side: a
    hub with a third of all edges is no unbounded group. ``keys`` keep separate
    graphs apart. Self-loops are allowed (they declare isolated nodes), null ends
    are dropped, an empty table gives no rows.
    """
    k = list(keys)
    both = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(
        *k, F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")
    ).select(*k, "e.a", "e.b").distinct()
    both, edge_path = stored(both, "cc-edges")
    state = Rounds("cc-labels")
    labels = state.write(both.groupBy(*k, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), [*k, "b"]).groupBy(*k, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [*k, "node"]).select(*k, "node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(*k, F.col("node").alias("mid"), F.col("label").alias("far"))
        new = state.write(step.join(jump, [*k, "mid"], "left").select(*k, "node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"))
        labels = new.drop("old")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(edges.sparkSession, edge_path)
    return labels.withColumnRenamed("label", "component")
