"""The pN_ queries, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import clusters, encodings, leakage, mixing, near_duplicates, neighbours, packing, splitting, truncation
from stratamem.storage import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).where(F.col("n_pieces") > 1).select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(spark, d, "chunk_embeddings"), "chunk_id", "chunk_embedding")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(p2_neighbours(spark, d), 0.985).withColumnsRenamed({"a": "chunk_a", "b": "chunk_b"})


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.recall(table(spark, d, "chunk_embeddings"), "chunk_id", "chunk_embedding")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.found_pairs(table(spark, d, "corpus"), "rec_id", "body").withColumnsRenamed({"a": "rec_a", "b": "rec_b"})


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(table(spark, d, "corpus"), "rec_id", "body")


def p4_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "chunks"))


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "chunk_metadata"))[0].select("chunk_id")


def p5_cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "chunk_metadata"))[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "chunk_metadata"))[1]


def p5_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "chunk_metadata"))[2]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_groups(clusters.levels(table(spark, d, "chunk_embeddings"), table(spark, d, "super_embeddings")))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(clusters.levels(table(spark, d, "chunk_embeddings"), table(spark, d, "super_embeddings")))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("leak = 'verbatim'").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(p7_leaks(spark, d), table(spark, d, "eval_items"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_repaired(spark, d).select("doc_id")


def p9_letters(spark: SparkSession, d: str) -> DataFrame:
    return encodings.symbol_letters(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


USABLE = "{v} IS NOT NULL AND len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def unit_sql(name: str, key: str, vector: str, level: str) -> str:
    return f"(SELECT {key} AS id, {level} AS level, any_value({vector})::DOUBLE[] AS v FROM {name} WHERE {USABLE.format(v=vector)} GROUP BY ALL)"


def oracle_sql() -> dict[str, str]:
    word = r"[\p{L}\p{N}_]+"
    plain = lambda c: f"regexp_extract_all(lower(strip_accents(regexp_replace(regexp_replace({c}, '<[/!]?[A-Za-z][^<>]*>', '', 'g'), '[''’ʼ]', '', 'g'))), '{word}')"
    grams = lambda n: f"list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))"
    return {
        "p1_found": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_size > 0 AND length(text) > chunk_size",
        "p2_found": f"""WITH e AS MATERIALIZED {unit_sql("chunk_embeddings", "chunk_id", "chunk_embedding", "0")},
k AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY c DESC, b.id) <= 5)
SELECT DISTINCT least(i, j) AS chunk_a, greatest(i, j) AS chunk_b FROM k WHERE c >= 0.985""",
        "p3_found": f"""WITH t AS (SELECT rec_id, regexp_extract_all(lower(any_value(body)), '{word}') AS w FROM corpus WHERE body IS NOT NULL GROUP BY rec_id),
s AS MATERIALIZED (SELECT rec_id, list_distinct({grams(3)}) AS g FROM t WHERE len(w) >= 3), u AS MATERIALIZED (SELECT rec_id, len(g) AS n, unnest(g) AS x FROM s),
h AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.rec_id < b.rec_id GROUP BY ALL)
SELECT rec_a, rec_b FROM h WHERE c >= 0.6 * (na + nb - c)""",
        "p6_found": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {unit_sql("chunk_embeddings", "chunk_id", "chunk_embedding", "0")} UNION ALL SELECT * FROM {unit_sql("super_embeddings", "node_id", "super_embedding", "level")}),
l AS MATERIALIZED (SELECT a.level, a.id AS i, b.id AS j FROM e a JOIN e b ON a.level = b.level AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.8),
r(level, id, x) AS (SELECT DISTINCT level, i, i FROM l UNION SELECT r.level, r.id, l.j FROM r JOIN l ON l.level = r.level AND l.i = r.x)
SELECT level, min(x) AS first_id, id AS member_id FROM r GROUP BY level, id HAVING min(x) <> id""",
        "p7_found": f"""WITH i AS (SELECT item_id, {plain("question")} AS w FROM eval_items UNION ALL SELECT item_id, {plain("passage")} FROM eval_items), d AS (SELECT doc_id, {plain("text")} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, unnest({grams(12)}) AS g FROM i WHERE len(w) >= 12), dg AS (SELECT DISTINCT doc_id, unnest({grams(12)}) AS g FROM d WHERE len(w) >= 12) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
