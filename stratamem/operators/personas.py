"""Persona graph: every node split by the components of its neighbourhood."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.operators.components import connected_components
from stratamem.storage import Rounds, materialize


def adjacency(edges: DataFrame) -> DataFrame:
    """``(a, b)`` in both directions, without self-loops."""
    return edges.where("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*").distinct()


def ego_triangles(edges: DataFrame) -> DataFrame:
    """``(o, p, r)``: ``p`` and ``r`` are adjacent neighbours of ``o``.

    Each triangle is found once, from its corner of least degree, and then told from
    all sides: a hub only pairs the neighbours of more edges than its own, so it is
    no hot key.
    """
    adj = adjacency(edges)
    degree = adj.groupBy("a").agg(F.count("*").alias("n"))
    known = adj.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    up = known.where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))).select("a", "b", F.struct(F.col("m"), F.col("b")).alias("rank"))
    wedge = up.select("a", F.col("b").alias("x"), F.col("rank").alias("rx")).join(up.select("a", F.col("b").alias("y"), F.col("rank").alias("ry")), "a").where("rx < ry")
    found = wedge.join(up.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).select("a", "x", "y")
    sides = [("a", "x", "y"), ("a", "y", "x"), ("x", "a", "y"), ("x", "y", "a"), ("y", "a", "x"), ("y", "x", "a")]
    return found.select(F.explode(F.array(*[F.struct(F.col(o).alias("o"), F.col(p).alias("p"), F.col(r).alias("r")) for o, p, r in sides])).alias("t")).select("t.*")


def ego_components(edges: DataFrame) -> DataFrame:
    """``(o, p, comp)``: the least neighbour of ``o`` that ``p`` reaches without passing ``o``."""
    loops = adjacency(edges).select(F.col("a").alias("o"), F.col("b").alias("u"), F.col("b").alias("v"))
    inside = ego_triangles(edges).select("o", F.col("p").alias("u"), F.col("r").alias("v"))
    return connected_components(loops.unionByName(inside), ("o",)).select("o", F.col("node").alias("p"), F.col("component").alias("comp"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense ids from 0 in the given order, by counts of range partitions: no single task sees all rows."""
    sorted_ = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return sorted_.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_rank") + F.col("before")).drop("_part", "_rank", "before")


def ranked(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """The place of each row in its group, from 0, by counts of range partitions: a group of any size is spread over tasks."""
    placed = materialize(numbered(rows, [group, order], "_place"), "placed")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    return placed.join(first, group).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")


def persona_nodes(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """``(persona, node, comp)``, numbered by node and component; an isolated node has one, of component -1."""
    split = comps.select(F.col("o").alias("node"), "comp").distinct()
    alone = nodes.select(F.col("id").alias("node")).join(split.select("node").distinct(), "node", "left_anti").withColumn("comp", F.lit(-1).cast("bigint"))
    return numbered(split.unionByName(alone), ["node", "comp"], "persona")


def persona_edges(edges: DataFrame, comps: DataFrame, personas: DataFrame) -> DataFrame:
    """``(p, q, weight)``: each edge between the personas that hold its other end."""
    of = comps.join(personas.withColumnRenamed("node", "o"), ["o", "comp"]).select("o", F.col("p").alias("other"), "persona")
    left = of.select(F.col("o").alias("u"), F.col("other").alias("v"), F.col("persona").alias("x"))
    right = of.select(F.col("o").alias("v"), F.col("other").alias("u"), F.col("persona").alias("y"))
    return edges.join(left, ["u", "v"]).join(right, ["u", "v"]).select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "weight")


def label_propagation(personas: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """``(persona, label)`` after ``rounds`` of the monotone majority rule.

    A persona takes the largest of its neighbours' most frequent labels if that is
    larger than its own and its own is not among them; labels only rise, so it ends.
    Labels that would still rise after ``rounds`` are told by a warning.
    """
    both = materialize(edges.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("e")).select("e.*").distinct(), "persona-adjacency")
    labels, state, changed = personas.select("persona", F.col("persona").alias("label")), Rounds("labels"), False
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("persona", "b"), "b").groupBy(F.col("a").alias("persona"), F.col("label").alias("vote")).agg(F.count("*").alias("n"))
        seen = votes.join(labels, "persona")
        best = seen.groupBy("persona").agg(F.max(F.struct("n", "vote")).alias("top"), F.max(F.when(F.col("vote") == F.col("label"), F.col("n"))).alias("own"))
        step = labels.join(best, "persona", "left")
        keep = F.col("top").isNull() | (F.col("own") == F.col("top.n"))
        labels = state.write(step.select("persona", F.when(keep, F.col("label")).otherwise(F.greatest("label", "top.vote")).alias("label"), F.col("label").alias("old")))
        changed = not labels.where("label <> old").isEmpty()
        labels = labels.drop("old")
        if not changed:
            break
    if changed:
        logging.getLogger(__name__).warning("labels still changed in the last of %d rounds", rounds)
    return labels


def capped_communities(labels: DataFrame, cap: int | None = 12) -> DataFrame:
    """``(persona, community)``: label groups cut into runs of ``cap`` in order of persona, numbered by label and run; no cap, no cut."""
    if cap:
        split = ranked(labels, "label", "persona", "order").withColumn("run", F.floor(F.col("order") / cap).cast("bigint")).drop("order")
    else:
        split = labels.withColumn("run", F.lit(0).cast("bigint"))
    split = materialize(split, "runs")
    ids = numbered(split.select("label", "run").distinct(), ["label", "run"], "community")
    return split.join(ids, ["label", "run"]).select("persona", "community")


def membership(communities: DataFrame, personas: DataFrame) -> DataFrame:
    """``(community, node)``, each once."""
    return communities.join(personas, "persona").select("community", "node").distinct()


def super_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(c1, c2)``, ``c1 < c2``: communities that share a node or are joined by an edge."""
    m1, m2 = members.select(F.col("community").alias("x"), F.col("node").alias("n1")), members.select(F.col("community").alias("y"), F.col("node").alias("n2"))
    share = m1.join(m2, F.col("n1") == F.col("n2")).where("x < y").select("x", "y")
    cross = edges.join(m1, F.col("u") == F.col("n1")).join(m2, F.col("v") == F.col("n2")).where("x <> y").select("x", "y")
    return share.unionByName(cross).select(F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).distinct()


def shift_by(offset: int):
    return lambda child: child + offset


def hierarchy(nodes: DataFrame, edges: DataFrame, rounds: int = 8, cap: int | None = 12, max_level: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(levels, composed)``: super-graphs built until the communities stop shrinking.

    ``levels(level, nodes, offset)`` has the running id offset of each level;
    ``composed(level, node_id, children)`` all nodes under global ids, children
    shifted by the level below.
    """
    spark = nodes.sparkSession
    sizes = [nodes.count()]
    # local ids of the base are their ranks, so that offsets are dense
    base = materialize(numbered(nodes.select("id"), ["id"], "local"), "base-ids")
    stacks = [base.select(F.lit(0).alias("level"), "local", F.array().cast("array<bigint>").alias("children"))]
    a, b = base.select(F.col("id").alias("u"), F.col("local").alias("lu")), base.select(F.col("id").alias("v"), F.col("local").alias("lv"))
    now = materialize(edges.join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"), "weight"), "level-edges")
    ids = base.select(F.col("local").alias("id"))
    for level in range(1, max_level + 1):
        comps = ego_components(now)
        personas = materialize(persona_nodes(ids, comps), "personas")
        labels = label_propagation(personas, persona_edges(now, comps, personas), rounds)
        members = materialize(membership(capped_communities(labels, cap), personas), "members")
        n = members.select("community").distinct().count()
        if n >= sizes[-1]:
            break
        sizes.append(n)
        stacks.append(members.groupBy(F.col("community").alias("local")).agg(F.sort_array(F.collect_list("node")).alias("children")).select(F.lit(level).alias("level"), "local", "children"))
        now = materialize(super_edges(now, members).select(F.col("c1").alias("u"), F.col("c2").alias("v"), F.lit(1.0).alias("weight")), "level-edges")
        ids = members.select(F.col("community").alias("id")).distinct()
    offsets = [sum(sizes[:k]) for k in range(len(sizes))]
    levels = spark.createDataFrame([(k, n, o) for k, (n, o) in enumerate(zip(sizes, offsets, strict=True))], "level int, nodes bigint, offset bigint")
    composed = None
    for level, part in enumerate(stacks):
        below = offsets[level - 1] if level else 0
        part = part.select("level", (F.col("local") + offsets[level]).alias("node_id"), F.transform("children", shift_by(below)).alias("children"))
        composed = part if composed is None else composed.unionByName(part)
    return levels, composed
