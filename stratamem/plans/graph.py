"""Queries of the memory graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions import vectors as V
from stratamem.operators import explore as E
from stratamem.operators import personas as P
from stratamem.operators import similarity as S
from stratamem.storage import materialize, table
from stratamem.streaming import incremental as I

K = 10
#: (weight, sigma, gamma) of a graph with many small neighbourhoods, and of one with real clusters.
SPARSE, CLUSTERED = (0.6, 1.0, 0.20), (0.3, 3.0, 0.30)
ROUNDS, CAP = 8, 12


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("doc"))


def edges(spark: SparkSession, d: str, setting: tuple = SPARSE) -> DataFrame:
    w, s, g = setting
    return materialize(S.knn_edges(S.scored_pairs(nodes(spark, d), w, s, g), K), "edges")


def split(spark: SparkSession, d: str, setting: tuple = SPARSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = edges(spark, d, setting)
    comps = materialize(P.ego_components(e), "ego-components")
    return e, comps, materialize(P.persona_nodes(nodes(spark, d), comps), "persona-nodes")


def grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e, comps, personas = split(spark, d, CLUSTERED)
    labels = P.label_propagation(personas, P.persona_edges(e, comps, personas), ROUNDS)
    return e, personas, labels, P.capped_communities(labels, CAP)


def pairwise_similarity(spark, d):
    return S.scored_pairs(nodes(spark, d), 0.6, 1.0, 0.15)


def pairwise_similarity_masked(spark, d):
    return S.scored_pairs(nodes(spark, d), 0.6, 1.0, 0.15, masked=True)


def banded_similarity(spark, d):
    return S.scored_pairs(nodes(spark, d), 0.3, 3.0, 0.4)


def knn_edges(spark, d):
    return edges(spark, d)


def query_topk(spark, d):
    n = nodes(spark, d)
    return S.query_topk(n, n.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vec"), K)


def node_degree_stats(spark, d):
    e = edges(spark, d)
    degree = P.adjacency(e).groupBy("a").agg(F.count("*").alias("degree"))
    all_ = nodes(spark, d).join(degree, F.col("id") == F.col("a"), "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return all_.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))


def ego_triangles(spark, d):
    return P.ego_triangles(edges(spark, d))


def ego_components(spark, d):
    return P.ego_components(edges(spark, d))


def persona_nodes(spark, d):
    return split(spark, d)[2]


def persona_edges(spark, d):
    return P.persona_edges(*split(spark, d))


def label_propagation(spark, d):
    return grouped(spark, d)[2]


def community_size_cap(spark, d):
    return grouped(spark, d)[3]


def community_stats(spark, d):
    e, personas, _, communities = grouped(spark, d)
    size = P.membership(communities, personas).groupBy("community").agg(F.count("*").alias("size"))
    return size.agg(F.count("*").alias("communities"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.round(F.avg("size"), 6).alias("avg_size"))


def community_membership(spark, d):
    _, personas, _, communities = grouped(spark, d)
    return P.membership(communities, personas)


def super_graph_edges(spark, d):
    e, personas, _, communities = grouped(spark, d)
    return P.super_edges(e, materialize(P.membership(communities, personas), "members"))


def cluster_texts(spark, d):
    """Member texts of each community in order of node, rendered as numbered passages."""
    _, personas, _, communities = grouped(spark, d)
    texts = table(spark, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    rows = P.membership(communities, personas).join(texts, F.col("node") == F.col("chunk_id"))
    ordered = F.array_sort(F.collect_list(F.struct("node", "text")))  # no more than the cap
    numbered = F.transform(ordered, lambda x, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(": "), x["text"]))
    return rows.groupBy("community").agg(F.array_join(numbered, "\n").alias("passages"))


# the SQL of the next two ends at level 1; every level is in hierarchy_levels and hierarchy_memory
def level_offsets(spark, d):
    e, w = edges(spark, d, CLUSTERED), nodes(spark, d)
    return P.hierarchy(w, e, ROUNDS, CAP, max_level=1)[0]


def composed_memory(spark, d):
    return P.hierarchy(nodes(spark, d), edges(spark, d, CLUSTERED), ROUNDS, CAP, max_level=1)[1].select("level", "node_id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


def hierarchy_levels(spark, d):
    """Offsets of all levels, until the communities stop shrinking."""
    return P.hierarchy(nodes(spark, d), edges(spark, d, CLUSTERED), ROUNDS, CAP)[0]


def hierarchy_memory(spark, d):
    """The composed memory of all levels."""
    return P.hierarchy(nodes(spark, d), edges(spark, d, CLUSTERED), ROUNDS, CAP)[1].select("level", "node_id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


def expand_frontier(spark, d):
    """Picks (the ids divisible by 20 of each level), their neighbours, and the members of picked communities."""
    e, personas, _, communities = grouped(spark, d)
    members = materialize(P.membership(communities, personas), "members")
    above = P.adjacency(P.super_edges(e, members).select(F.col("c1").alias("u"), F.col("c2").alias("v")))
    leveled = lambda df, level: df.select(F.lit(level).alias("level"), "*")
    adjacent = leveled(P.adjacency(e), 0).unionByName(leveled(above, 1))
    picks = leveled(nodes(spark, d).select(F.col("id").alias("node")), 0).unionByName(leveled(members.select(F.col("community").alias("node")).distinct(), 1)).where("node % 20 = 0")
    near = picks.join(adjacent, (picks.level == adjacent.level) & (picks.node == adjacent.a)).select(picks.level, F.col("b").alias("node"))
    below = picks.where("level = 1").join(members.withColumnRenamed("node", "member"), F.col("node") == F.col("community")).select(F.lit(0).alias("level"), F.col("member").alias("node"))
    return picks.unionByName(near).unionByName(below).distinct()


def prune_and_grow(spark, d):
    """Five turns of pick (cosine of 0.25 or more) and grow (picks and their neighbours), from the ten best nodes of each query."""
    n = nodes(spark, d)
    adjacent = materialize(P.adjacency(edges(spark, d, CLUSTERED)), "adjacency")
    queries = materialize(n.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("q")), "asked")
    front = S.query_topk(n, queries.withColumnRenamed("q", "vec"), K).select("qid", "node")
    choose = E.by_score(queries, n.select(F.col("id").alias("node"), "vec"), F.round(V.cosine(F.col("q"), F.col("vec")), 6), 0.25)
    return E.explore(front, choose, adjacent, adjacent.limit(0))


def incremental_personas(spark, d):
    """Personas after the nodes above four fifths of the ids have arrived: only new nodes and their neighbours are split anew."""
    every = edges(spark, d)
    last = nodes(spark, d).agg(F.max("id")).first()[0] or 0
    new = materialize(nodes(spark, d).where(F.col("id") > last * 0.8).select("id"), "arrived")
    fresh = materialize(every.join(new, every.u == new.id, "left_semi").unionByName(every.join(new, every.v == new.id, "left_semi")).distinct(), "fresh-edges")
    state = materialize(P.ego_components(every.join(fresh.select("u", "v"), ["u", "v"], "left_anti")), "state-before")  # what an earlier batch has left
    return I.refreshed(state, every, I.affected(fresh, new))


QUERIES = (
    pairwise_similarity, pairwise_similarity_masked, banded_similarity, knn_edges, query_topk, node_degree_stats, ego_triangles, ego_components, persona_nodes,
    persona_edges, label_propagation, community_size_cap, community_stats, community_membership, super_graph_edges, cluster_texts, level_offsets, composed_memory,
    hierarchy_levels, hierarchy_memory, expand_frontier, prune_and_grow, incremental_personas,
)


def similarity_sql(w: float, s: float, mask: str = "1") -> str:
    return f"""e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
sim AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, round({w} * greatest(0.0, list_cosine_similarity(a.v, b.v))
  + {1 - w} * {mask} * exp(-power(a.vec_id - b.vec_id, 2) / {2 * s * s}), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


def edges_sql(setting: tuple) -> str:
    w, s, g = setting
    return f"""{similarity_sql(w, s)},
edges AS MATERIALIZED (SELECT DISTINCT least(i, j) AS u, greatest(i, j) AS v, sim AS weight FROM
  (SELECT i, j, sim FROM sim WHERE sim >= {g} QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= {K})),
adj AS MATERIALIZED (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges),
tri AS MATERIALIZED (SELECT x.a AS o, x.b AS p, y.b AS r FROM adj x JOIN adj y ON y.a = x.b JOIN adj z ON z.a = x.a AND z.b = y.b),
reach(o, p, r) AS (SELECT a, b, b FROM adj UNION SELECT t.o, t.p, n.r FROM reach t JOIN tri n ON n.o = t.o AND n.p = t.r),
comps AS MATERIALIZED (SELECT o, p, min(r) AS comp FROM reach GROUP BY o, p),
personas AS MATERIALIZED (SELECT row_number() OVER (ORDER BY node, comp) - 1 AS persona, node, comp FROM
  (SELECT DISTINCT o AS node, comp FROM comps UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id NOT IN (SELECT a FROM adj))),
pedges AS MATERIALIZED (SELECT least(x.persona, y.persona) AS p, greatest(x.persona, y.persona) AS q, weight FROM edges
  JOIN comps cu ON cu.o = u AND cu.p = v JOIN personas x ON x.node = u AND x.comp = cu.comp
  JOIN comps cv ON cv.o = v AND cv.p = u JOIN personas y ON y.node = v AND y.comp = cv.comp)"""


def communities_sql() -> str:
    out = [edges_sql(CLUSTERED), "padj AS MATERIALIZED (SELECT p AS a, q AS b FROM pedges UNION SELECT q, p FROM pedges)", "l0 AS (SELECT persona, persona AS label FROM personas)"]
    for k in range(1, ROUNDS + 1):
        out.append(f"""l{k} AS MATERIALIZED (SELECT l.persona, CASE WHEN b.top IS NULL OR b.own = b.top.n THEN l.label ELSE greatest(l.label, b.top.vote) END AS label
FROM l{k - 1} l LEFT JOIN (SELECT v.a, max({{'n': v.n, 'vote': v.vote}}) AS top, max(CASE WHEN v.vote = o.label THEN v.n END) AS own FROM
  (SELECT a, label AS vote, count(*) AS n FROM padj JOIN l{k - 1} ON persona = b GROUP BY a, label) v JOIN l{k - 1} o ON o.persona = v.a GROUP BY v.a) b ON b.a = l.persona)""")
    out.append(f"""runs AS MATERIALIZED (SELECT persona, label, (row_number() OVER (PARTITION BY label ORDER BY persona) - 1) // {CAP} AS run FROM l{ROUNDS}),
communities AS MATERIALIZED (SELECT persona, dense_rank() OVER (ORDER BY label, run) - 1 AS community FROM runs),
members AS MATERIALIZED (SELECT DISTINCT community, node FROM communities JOIN personas USING (persona))""")
    return ",\n".join(out)


def oracle_sql() -> dict[str, str]:
    sparse, clustered = f"WITH RECURSIVE {edges_sql(SPARSE)}", f"WITH RECURSIVE {communities_sql()}"
    top = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS MATERIALIZED (SELECT q.vec_id AS qid, n.vec_id AS node, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM e q JOIN e n ON true WHERE q.vec_id % 20 = 0),
topk AS MATERIALIZED (SELECT qid, node, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS rank FROM s QUALIFY rank <= {K})"""
    levels = f"""{clustered}, n0 AS (SELECT count(*) AS n FROM embeddings), n1 AS (SELECT count(DISTINCT community) AS n FROM members)"""
    turns = "t0 AS (SELECT qid, node FROM topk)"
    for k in (1, 2, 3, 4, 5):
        turns += f""", p{k} AS MATERIALIZED (SELECT t.qid, t.node, s.score FROM t{k - 1} t JOIN s ON s.qid = t.qid AND s.node = t.node WHERE s.score >= 0.25),
t{k} AS MATERIALIZED (SELECT qid, node FROM p{k} UNION SELECT qid, b FROM p{k} JOIN adj ON a = node)"""
    return {
        "pairwise_similarity": f"WITH {similarity_sql(0.6, 1.0)} SELECT i, j, sim FROM sim WHERE i < j AND sim >= 0.15",
        "pairwise_similarity_masked": f"WITH {similarity_sql(0.6, 1.0, '(CASE WHEN a.label IS NOT DISTINCT FROM b.label THEN 1 ELSE 0 END)')} SELECT i, j, sim FROM sim WHERE i < j AND sim >= 0.15",
        "banded_similarity": f"WITH {similarity_sql(0.3, 3.0)} SELECT i, j, sim FROM sim WHERE i < j AND sim >= 0.4",
        "knn_edges": f"{sparse} SELECT u, v, weight FROM edges",
        "query_topk": f"WITH {top} SELECT qid, node, score, rank FROM topk",
        "node_degree_stats": f"""{sparse}, g AS (SELECT vec_id, count(a) AS degree FROM embeddings LEFT JOIN adj ON a = vec_id GROUP BY vec_id)
SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM g""",
        "ego_triangles": f"{sparse} SELECT o, p, r FROM tri",
        "ego_components": f"{sparse} SELECT o, p, comp FROM comps",
        "persona_nodes": f"{sparse} SELECT persona, node, comp FROM personas",
        "persona_edges": f"{sparse} SELECT p, q, weight FROM pedges",
        "label_propagation": f"{clustered} SELECT persona, label FROM l{ROUNDS}",
        "community_size_cap": f"{clustered} SELECT persona, community FROM communities",
        "community_stats": f"{clustered} SELECT count(*) AS communities, max(size) AS max_size, min(size) AS min_size, round(avg(size), 6) AS avg_size FROM (SELECT community, count(*) AS size FROM members GROUP BY community)",
        "community_membership": f"{clustered} SELECT community, node FROM members",
        "super_graph_edges": f"""{clustered} SELECT DISTINCT least(x, y) AS c1, greatest(x, y) AS c2 FROM (SELECT a.community AS x, b.community AS y FROM members a JOIN members b ON a.node = b.node
UNION ALL SELECT a.community, b.community FROM edges JOIN members a ON a.node = u JOIN members b ON b.node = v) WHERE x <> y""",
        "cluster_texts": f"""{clustered}, texts AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
ranked AS (SELECT community, node, text, row_number() OVER (PARTITION BY community ORDER BY node) AS k FROM members JOIN texts ON chunk_id = node)
SELECT community, string_agg('Passage ' || k || ': ' || text, chr(10) ORDER BY k) AS passages FROM ranked GROUP BY community""",
        "level_offsets": f"{levels} SELECT 0 AS level, n AS nodes, 0 AS \"offset\" FROM n0 UNION ALL SELECT 1, n1.n, n0.n FROM n0, n1 WHERE n1.n < n0.n",
        "composed_memory": f"""{levels}, base AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings)
SELECT 0 AS level, id AS node_id, '' AS children FROM base UNION ALL
SELECT 1, community + n0.n, string_agg(id::VARCHAR, ',' ORDER BY id) FROM members JOIN base ON vec_id = node, n0, n1 WHERE n1.n < n0.n GROUP BY community, n0.n""",
        "expand_frontier": f"""{clustered}, super AS MATERIALIZED (SELECT DISTINCT x AS a, y AS b FROM (SELECT a.community AS x, b.community AS y FROM members a JOIN members b ON a.node = b.node
UNION ALL SELECT a.community, b.community FROM adj JOIN members a ON a.node = adj.a JOIN members b ON b.node = adj.b) WHERE x <> y)
SELECT 0 AS level, vec_id AS node FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT 1, community FROM members WHERE community % 20 = 0
UNION SELECT 0, b FROM adj WHERE a % 20 = 0 UNION SELECT 1, b FROM super WHERE a % 20 = 0 UNION SELECT 0, node FROM members WHERE community % 20 = 0""",
        "prune_and_grow": f"WITH RECURSIVE {edges_sql(CLUSTERED).replace('e AS MATERIALIZED', 'e0 AS MATERIALIZED', 1).replace('FROM e a JOIN e b', 'FROM e0 a JOIN e0 b')}, {top}, {turns} SELECT qid, node, score FROM p1 UNION SELECT qid, node, score FROM p2 UNION SELECT qid, node, score FROM p3 UNION SELECT qid, node, score FROM p4 UNION SELECT qid, node, score FROM p5",
        "incremental_personas": f"{sparse} SELECT o, p, comp FROM comps",
    }
