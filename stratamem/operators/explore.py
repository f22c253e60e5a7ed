"""Prune and grow: answering questions over a memory by picking passages and following what lies around the picks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.config import ANSWERS, Exploring
from stratamem.operators import models
from stratamem.operators.memory import passages
from stratamem.operators.similarity import query_topk
from stratamem.storage import materialize

#: Who decides: the candidates of each question in, the picks out; a question without a row has no valid reply.
Choose = Callable[[DataFrame], DataFrame]
CLAIM = " Is this statement true or false?"


def expanded(picks: DataFrame, neighbours: DataFrame, children: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(qid, *keys, node)``: the picks, their neighbours on their level and their members on the level below.

    ``neighbours(*keys, a, b)`` in both directions, ``children(*keys, a, b)``.
    """
    around = neighbours.select(*keys, F.col("a").alias("node"), "b").unionByName(children.select(*keys, F.col("a").alias("node"), "b"))
    grown = picks.select("qid", *keys, "node").join(around, [*keys, "node"]).select("qid", *keys, F.col("b").alias("node"))
    return picks.select("qid", *keys, "node").unionByName(grown).distinct()


def explore(front: DataFrame, choose: Choose, neighbours: DataFrame, children: DataFrame, max_turns: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(qid, *keys, node, ...)``: all that was picked for each question, each once.

    ``front(qid, *keys, node)`` are the first candidates. In each turn ``choose`` gives
    ``(qid, *keys, node, ...)`` with ``node`` null for a question that picks nothing; a
    question ends when its candidates are those of the turn before, when it gets no
    row at all, or after ``max_turns``. New candidates come from this turn's picks
    only. Only the candidates are ever looked at, not all nodes.
    """
    evidence, before = None, None
    signature = F.md5(F.to_json(F.sort_array(F.collect_set("node"))))  # a question's candidates, as the prompt needs them in one row too
    for _ in range(max_turns):
        front = materialize(front, "candidates")
        now = materialize(front.groupBy("qid").agg(signature.alias("signature")), "candidate-sets")
        open_ = now if before is None else now.join(before, ["qid", "signature"], "left_anti")
        asked = front.join(open_.select("qid"), "qid", "left_semi")
        said = materialize(choose(asked), "picks")
        picked = said.where("node is not null")
        evidence = picked if evidence is None else evidence.unionByName(picked)
        if picked.isEmpty():
            break
        before = now
        front = expanded(picked, neighbours, children, keys)
    return evidence.dropDuplicates(["qid", *keys, "node"]) if evidence is not None else said


def by_score(questions: DataFrame, nodes: DataFrame, score: Column, least: float) -> Choose:
    """Picks the candidates whose ``score`` (over the columns of ``questions(qid, q)`` and ``nodes(node, vec)``) is ``least`` or more; none gives no row."""

    def choose(candidates: DataFrame) -> DataFrame:
        both = candidates.join(nodes, "node").join(questions, "qid").withColumn("score", score)
        return both.where(F.col("score") >= least).select("qid", "node", "score")

    return choose


def by_model(questions: DataFrame, nodes: DataFrame, setting: Exploring, backend: models.ModelBackend | None = None) -> Choose:
    """Picks what the model names of the numbered candidates, in order of node.

    Numbers out of bounds are ignored. A reply that is no list is asked for again, so
    long as the question has ``tolerance`` left in this turn; then the question ends.
    """
    model = backend or models.OfflineBackend()
    field = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in dict.fromkeys([setting.text_field, "text"]) if c in nodes.columns], F.lit(""))

    def choose(candidates: DataFrame) -> DataFrame:
        texts = candidates.join(nodes.select("book_id", "node", field.alias("own")), ["book_id", "node"])
        rows = passages(texts, ["qid", "book_id"], "node", "own").join(texts.groupBy("qid").agg(F.sort_array(F.collect_list("node")).alias("nodes")), "qid").join(questions.select("qid", "question"), "qid")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for r in f.itertuples():
                    question = (r.question or "") + (CLAIM if setting.task == "verify" else "")
                    for _ in range(setting.tolerance + 1):
                        picks = models.listed(model.complete("select", [{"question": question, "passages": r.passages}])[0])
                        if picks is not None:
                            chosen = [int(r.nodes[i - 1]) for i in sorted(set(picks)) if 0 < i <= len(r.nodes)]
                            out += [(r.qid, r.book_id, n) for n in chosen] or [(r.qid, r.book_id, None)]
                            break
                yield pd.DataFrame(out, columns=["qid", "book_id", "node"]).astype({"node": "Int64"})

        return rows.mapInPandas(run, f"qid {questions.schema['qid'].dataType.simpleString()}, book_id string, node bigint")

    return choose


def merged_evidence(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(qid, book_id, node, text)``: runs of consecutive chunks as one passage under the last id, nodes of higher levels as they are; a missing level is 0."""
    rows = evidence.join(nodes.select("book_id", "node", F.coalesce("level", F.lit(0)).alias("level"), "own"), ["book_id", "node"])
    order = F.row_number().over(Window.partitionBy("qid", "book_id").orderBy("node"))  # a question's evidence
    ground = rows.where("level = 0").withColumn("run", F.col("node") - order)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "own"))), lambda x: x["own"]), " ")
    runs = ground.groupBy("qid", "book_id", "run").agg(F.max("node").alias("node"), joined.alias("text"))
    return runs.select("qid", "book_id", "node", "text").unionByName(rows.where("level > 0").select("qid", "book_id", "node", F.col("own").alias("text")))


def answers(nodes: DataFrame, edges: DataFrame, questions: DataFrame, setting: Exploring = ANSWERS, backend: models.ModelBackend | None = None) -> tuple[DataFrame, DataFrame]:
    """``(replies, evidence)`` over a memory ``nodes(book_id, level, node_id, text, vec, children[, gist])``, ``edges(book_id, u, v)``.

    ``questions(qid, book_id, question[, options])`` are asked of their own book.
    ``replies(qid, output, n_passages)`` has a row for every question whose book has
    nodes, ``evidence(qid, book_id, node, text)`` what each was answered from: the
    picks of all turns or, if there are none, the first candidates. Super-nodes have
    texts only, so a missing gist falls back to the text.
    """
    memory = nodes.withColumnRenamed("node_id", "node")
    field = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in dict.fromkeys([setting.text_field, "text"]) if c in memory.columns], F.lit(""))
    memory = memory.withColumn("own", field)
    asked = questions.withColumn("_q", F.col("question"))
    vectors = models.embed(asked, "qid", "_q", backend)
    targets = memory.where(F.col("vec").isNotNull()).select("book_id", F.col("node").alias("id"), "vec")
    ranked = query_topk(targets, vectors.join(asked.select("qid", "book_id"), "qid"), setting.top_k, book="book_id")
    first = materialize(ranked.select("qid", "book_id", "node"), "first-candidates")
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("u", "v"), ("v", "u"))]
    neighbours = materialize(edges.select("book_id", F.explode(F.array(*ends)).alias("e")).select("book_id", "e.a", "e.b").distinct(), "neighbours")
    children = memory.select("book_id", F.col("node").alias("a"), F.explode("children").alias("b"))
    found = explore(first, by_model(asked, memory, setting, backend), neighbours, children, setting.max_turns, ("book_id",)).select("qid", "book_id", "node")
    rest = first.join(found.select("qid").distinct(), "qid", "left_anti")
    evidence = materialize(merged_evidence(found.unionByName(rest), memory), "evidence")
    rendered = passages(evidence, ["qid"], "node", "text").join(evidence.groupBy("qid").agg(F.count("*").cast("int").alias("n_passages")), "qid").join(asked, "qid")
    fields = {"question": "question", "claim": "question", "query": "question", "passages": "passages"}
    if "options" in questions.columns:
        fields["options"] = "options"
    wanted = {"choose": ("question", "options", "passages"), "answer": ("question", "passages"), "verify": ("claim", "passages"), "query_summary": ("query", "passages")}[setting.task]
    rendered = materialize(rendered, "final-requests")
    said = models.complete(rendered, setting.task, "qid", {k: fields[k] for k in wanted if k in fields}, backend)
    return said.join(rendered.select("qid", "n_passages"), "qid"), evidence
