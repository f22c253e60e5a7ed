"""Incremental growth of a memory: a micro-batch scores its nodes against all and splits, relabels and summarises anew only what it touches.

This is a mode of its own: nodes that were there before do not pick again, so the
edges may differ from those of a build over everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from stratamem.operators import models
from stratamem.operators.memory import passages
from stratamem.operators.personas import adjacency, ego_components
from stratamem.operators.similarity import BLOCK
from stratamem.storage import materialize


def new_edges(old: DataFrame, new: DataFrame, weight: float, sigma: float, gamma: float, k: int) -> DataFrame:
    """``(u, v, weight)``: the ``k`` best partners that each new node picks among all, at ``gamma`` or more.

    The new nodes go in blocks of ``BLOCK`` against old and new ones; old nodes are
    never scored with each other.
    """
    spark = new.sparkSession
    fresh = materialize(new.select("id", "vec"), "new-nodes")
    parts = max(1, -(-fresh.count() // BLOCK))
    every = old.select("id", "vec").unionByName(fresh)
    found = None
    for part in range(parts):
        block = fresh.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toPandas()
        unit = lambda vecs: (x := np.stack([np.asarray(v, dtype=float) for v in vecs])) / np.maximum(np.sqrt((x * x).sum(1)), 1e-150)[:, None]
        shared = spark.sparkContext.broadcast((block.id.to_numpy(), unit(block.vec) if len(block) else None))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, q = shared.value
            for f in frames:
                if q is None or not len(f):
                    continue
                ids = f.id.to_numpy()
                x = np.stack([np.asarray(v, dtype=float) for v in f.vec])
                x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-150)[:, None]
                near = np.exp(-((own[:, None] - ids[None, :]).astype(float) ** 2) / (2 * sigma * sigma))
                sim = np.round(weight * np.maximum(0.0, q @ x.T) + (1 - weight) * near, 6)
                sim[own[:, None] == ids[None, :]] = -1.0
                order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                r = np.repeat(np.arange(len(own)), order.shape[1])
                score = sim[r, order.ravel()]
                good = score >= gamma
                yield pd.DataFrame({"n": own[r][good], "other": ids[order.ravel()][good], "weight": score[good]})

        some = every.mapInPandas(scan, "n bigint, other bigint, weight double")
        found = some if found is None else found.unionByName(some)
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("weight"), "other"))
    picks = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return picks.select(F.least("n", "other").alias("u"), F.greatest("n", "other").alias("v"), "weight").distinct()


def affected(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes and their neighbours: the only ones whose neighbourhood can have changed."""
    fresh = new.select("id")
    near = adjacency(edges).join(fresh.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))
    return fresh.unionByName(near).distinct()


def touched_components(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Components of the neighbourhoods of the touched nodes; only edges among them and their neighbours are read."""
    t = touched.withColumnRenamed("id", "o")
    own = adjacency(edges).join(t.withColumnRenamed("o", "a"), "a", "left_semi")
    ends = own.select("b").union(own.select("a")).distinct()
    local = edges.join(ends.withColumnRenamed("b", "u"), "u", "left_semi").join(ends.withColumnRenamed("b", "v"), "v", "left_semi")
    return ego_components(local).join(t, "o", "left_semi")


def refreshed(before: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Components of all neighbourhoods, computed anew for the touched nodes only."""
    return before.join(touched.withColumnRenamed("id", "o"), "o", "left_anti").unionByName(touched_components(edges, touched))


def persona(node: str, comp: str) -> F.Column:
    """A persona's name, which stays while its node and component do."""
    return F.concat_ws(":", F.col(node).cast("string"), F.col(comp).cast("string"))


def persona_links(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``(u, v, p, q)``: the personas that hold each edge."""
    left = comps.select(F.col("o").alias("u"), F.col("p").alias("v"), persona("o", "comp").alias("x"))
    right = comps.select(F.col("o").alias("v"), F.col("p").alias("u"), persona("o", "comp").alias("y"))
    return edges.select("u", "v").join(left, ["u", "v"]).join(right, ["u", "v"]).select("u", "v", F.col("x").alias("p"), F.col("y").alias("q"))


def relabelled(labels: DataFrame, links: DataFrame, active: DataFrame, rounds: int = 8) -> DataFrame:
    """``(persona, label)`` once the active personas have taken their neighbours' majority.

    A persona takes the greatest of the most frequent labels around it if its own is
    not among them and smaller. Who changed makes its neighbours active; it ends when
    nobody changes, or after ``rounds``.
    """
    both = materialize(links.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("e")).select("e.*").distinct(), "persona-links")
    for _ in range(rounds):
        asked = both.join(active.select(F.col("persona").alias("a")).distinct(), "a", "left_semi")
        votes = asked.join(labels.withColumnRenamed("persona", "b"), "b").groupBy(F.col("a").alias("persona"), F.col("label").alias("vote")).agg(F.count("*").alias("n"))
        best = votes.join(labels, "persona").groupBy("persona", "label").agg(F.max(F.struct("n", "vote")).alias("top"), F.max(F.when(F.col("vote") == F.col("label"), F.col("n"))).alias("own"))
        change = materialize(best.where((F.col("own").isNull() | (F.col("own") < F.col("top.n"))) & (F.col("top.vote") > F.col("label"))).select("persona", F.col("top.vote").alias("to")), "label-changes")
        if change.isEmpty():
            break
        labels = materialize(labels.join(change, "persona", "left").select("persona", F.coalesce("to", "label").alias("label")), "incremental-labels")
        active = both.join(change.select(F.col("persona").alias("b")), "b", "left_semi").select(F.col("a").alias("persona"))
    return labels


def changed_clusters(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(label)`` of the clusters of ``after(label, node)`` whose members are not those they had; a cluster's members are told by a sum of hashes, so none is collected."""
    signature = lambda df, name: df.distinct().groupBy("label").agg(F.struct(F.count("*"), F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)"))).alias(name))
    both = signature(after, "now").join(signature(before, "was"), "label", "left")
    return both.where(~F.col("now").eqNullSafe(F.col("was"))).select("label")


class IncrementalMemory:
    """State as delta tables under ``path``: a version holds only the rows its batch made or changed.

    ``nodes`` and ``edges`` only grow; of ``components`` (by node), ``links`` (by edge),
    ``labels`` (by persona) and ``summaries`` (by label) the newest version of a key
    holds. A batch that was already taken in is skipped, so replays do no harm.
    """

    TABLES = {
        "nodes": ((), "id bigint, vec array<double>, text string"), "edges": ((), "u bigint, v bigint, weight double"), "components": (("o",), "o bigint, p bigint, comp bigint"),
        "links": (("u", "v"), "u bigint, v bigint, p string, q string"), "labels": (("persona",), "persona string, label string"), "summaries": (("label",), "label string, text string, vec array<float>"),
    }

    def __init__(self, spark: SparkSession, path: str, weight: float = 0.6, sigma: float = 1.0, gamma: float = 0.6, k: int = 10, rounds: int = 8, cap: int = 12, backend: models.ModelBackend | None = None):
        self.spark, self.path, self.setting, self.k, self.rounds, self.cap, self.backend = spark, path.rstrip("/"), (weight, sigma, gamma), k, rounds, cap, backend

    def load(self, name: str, version: int) -> DataFrame:
        """A table as of ``version``."""
        keys, schema = self.TABLES[name]
        have = [v for v in self.versions() if v <= version]
        if not have:
            return self.spark.createDataFrame([], schema)
        rows = None
        for v in have:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/v{v}/{name}").withColumn("_v", F.lit(v))
            rows = part if rows is None else rows.unionByName(part)
        if keys:
            newest = rows.groupBy(*keys).agg(F.max("_v").alias("_v"))
            rows = rows.join(newest, [*keys, "_v"], "left_semi")
        return rows.drop("_v")

    def versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop(self.path)):
            return []
        names = [s.getPath() for s in fs.listStatus(hadoop(self.path))]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[0] == "v" and fs.exists(hadoop(p, "done")))

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def clusters(self, version: int) -> DataFrame:
        """``(label, node)``; a label whose persona is gone still names the cluster of those that took it."""
        comps = self.load("components", version)
        alive = comps.select(persona("o", "comp").alias("persona"), F.col("o").alias("node")).distinct()
        return self.load("labels", version).join(alive, "persona").select("label", "node").distinct()

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Take in ``batch(id, vec[, text])`` as version ``epoch``; ids that are there already are ignored."""
        last = self.version()
        if epoch <= last:
            return
        nodes, edges, comps, links, labels = (self.load(n, last) for n in ("nodes", "edges", "components", "links", "labels"))
        text = F.col("text") if "text" in batch.columns else F.lit(None).cast("string")
        rows = batch.where("id is not null and vec is not null").select(F.col("id").cast("bigint"), F.col("vec").cast("array<double>"), text.alias("text")).dropDuplicates(["id"])
        new = materialize(rows.join(nodes.select("id"), "id", "left_anti"), "batch")
        fresh = materialize(new_edges(nodes, new, *self.setting, self.k), "fresh-edges")
        grown = edges.unionByName(fresh)
        touched = materialize(affected(fresh, new), "touched")
        own = materialize(touched_components(grown, touched), "touched-components")
        now = comps.join(touched.withColumnRenamed("id", "o"), "o", "left_anti").unionByName(own)
        around = grown.join(touched.select(F.col("id").alias("u")), "u", "left_semi").unionByName(grown.join(touched.select(F.col("id").alias("v")), "v", "left_semi")).distinct()
        ends = around.select(F.explode(F.array("u", "v")).alias("o")).distinct()
        changed = materialize(persona_links(around, now.join(ends, "o", "left_semi")), "changed-links")
        kept = links.join(changed.select("u", "v"), ["u", "v"], "left_anti").unionByName(changed)
        # personas that stay keep their label, new ones begin with their own
        names = own.select(persona("o", "comp").alias("persona")).distinct()
        alive = labels.join(touched.withColumnRenamed("id", "_o"), F.split("persona", ":")[0].cast("bigint") == F.col("_o"), "left_anti").unionByName(names.join(labels, "persona", "left").select("persona", F.coalesce("label", "persona").alias("label")))
        alive = materialize(alive, "alive-labels")
        after = materialize(relabelled(alive, kept, names, self.rounds), "new-labels")
        delta = after.join(labels.withColumnRenamed("label", "was"), "persona", "left").where(~F.col("label").eqNullSafe(F.col("was")))
        rewritten = delta.select("persona", "label").unionByName(after.join(names, "persona", "left_semi")).distinct()
        members = after.join(now.select(persona("o", "comp").alias("persona"), F.col("o").alias("node")).distinct(), "persona").select("label", "node").distinct()
        moved = changed_clusters(self.clusters(last), members)
        out = {"nodes": new, "edges": fresh, "components": own, "links": changed, "labels": rewritten, "summaries": self.summaries(members.join(moved, "label", "left_semi"), nodes.unionByName(new))}
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{epoch}/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/v{epoch}/done")

    def summaries(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """Text and vector of changed clusters, from the first ``cap`` members of each; no other is asked for again."""
        rank = F.row_number().over(Window.partitionBy("label").orderBy("node"))
        first = members.withColumn("r", rank).where(F.col("r") <= self.cap)
        rendered = passages(first.join(nodes.select(F.col("id").alias("node"), F.col("text").alias("own")), "node"), ["label"], "node", "own")
        said = materialize(models.complete(rendered, "cluster_summary", "label", {"passages": "passages"}, self.backend), "changed-summaries")
        vectors = models.embed(said, "label", "output", self.backend)
        return said.join(vectors, "label").select("label", F.col("output").alias("text"), "vec")

    def stream(self, source: DataFrame, checkpoint: str) -> DataStreamWriter:
        return source.writeStream.foreachBatch(lambda df, epoch: self.add(df, epoch)).option("checkpointLocation", checkpoint)
