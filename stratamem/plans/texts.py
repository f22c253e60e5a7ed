"""Queries over texts, records and metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratamem.functions import text as T
from stratamem.operators import chunking as C
from stratamem.operators import metrics as S
from stratamem.operators import runs as R
from stratamem.operators.personas import ranked
from stratamem.storage import latest, table

SIZE = 128


def paragraph_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "paragraph"))
    return rows.where(F.length("paragraph") > 0)


def books(spark, d):
    lines = F.filter(F.split("text", "\n", -1), lambda p: T.trim_ws(p) != "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.transform(lines, T.ws_tokens).alias("counts"))


def greedy_token_chunks(spark, d):
    return C.greedy_sizes(books(spark, d), SIZE)


def token_totals(spark, d):
    return books(spark, d).select("book_id", F.size("counts").alias("paragraphs"), F.aggregate("counts", F.lit(0), lambda s, x: s + x).alias("n_tokens"))


def book_chunks(spark, d):
    return C.chunk_texts(table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), "text"), SIZE)


def conversation_chunks(spark, d):
    turns = table(spark, d, "documents").where(F.lower(F.trim("source")) == "chat_sessions")
    return C.chunk_texts(turns.select(F.col("doc_id").alias("book_id"), "text"), SIZE, turns=True)


def split_turn_chunks(spark, d):
    """One chunk a turn, cut where it is longer than the size."""
    chat = table(spark, d, "documents").where(F.lower(F.trim("source")) == "chat_sessions")
    return C.chunk_texts(chat.select(F.col("doc_id").alias("book_id"), "text"), 16, turns=True, single=True)


def information_preserved(spark, d):
    """Characters of each book that are no blanks, before and after it was cut into chunks."""
    inked = lambda c: F.length(F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0b]", ""))
    chunks = book_chunks(spark, d).groupBy("book_id").agg(F.sum(inked("text")).alias("kept"))
    whole = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("book_id"), inked("text").cast("bigint").alias("characters"))
    return whole.join(chunks, "book_id", "left").select("book_id", "characters", F.coalesce("kept", F.lit(0)).alias("kept"))


def turns(spark, d):
    chat = table(spark, d, "documents").where(F.lower(F.trim("source")) == "chat_sessions")
    lines = chat.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line")).where(F.length("line") > 0)
    head, role = r"^Session (\d+) \((.*)\):$", r"(?s)^(user|assistant): (.*)$"
    return lines.select(
        "doc_id", "idx", F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1).cast("int")).alias("session"), F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 2)).alias("date"),
        F.when(F.col("line").rlike(role), F.regexp_extract("line", role, 1)).otherwise("Unknown").alias("role"), F.when(F.col("line").rlike(role), F.regexp_extract("line", role, 2)).otherwise(F.col("line")).alias("content"),
    )


def turn_chunks(spark, d):
    t = turns(spark, d).where("session is null")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1
    return t.select("doc_id", idx.alias("chunk_id"), F.concat_ws(": ", "role", "content").alias("text"))


def session_book(spark, d):
    """Turns of each conversation under their session's header, blank turns dropped."""
    t = turns(spark, d).withColumn("s", F.max(F.struct("session", "date")).over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    kept = t.where("session is null").where(T.trim_ws(F.col("content")) != "")
    body = kept.groupBy("doc_id", "s.session", "s.date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(": ", "role", "content").alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return body.select("doc_id", "session", F.concat(F.lit("Session "), F.coalesce(F.col("session").cast("string"), F.lit("0")), F.lit(" ("), F.coalesce("date", F.lit("")), F.lit("):\n"), "body").alias("text"))


def items(spark, d):
    return table(spark, d, "eval_items").groupBy("item_id").agg(F.max(F.struct("question", "answer", "answer_options", "passage", "question_type")).alias("i")).select("item_id", "i.*")


def normalize_answer(spark, d):
    return items(spark, d).select("item_id", T.normalize_answer(F.col("answer")).alias("answer"), T.normalize_answer(F.col("question")).alias("question"))


def options(spark, d):
    return items(spark, d).where("answer is not null").select("item_id", "question_type", "answer", F.posexplode("answer_options").alias("option_idx", "option"))


def token_f1(spark, d):
    s = T.token_scores(F.col("answer"), F.col("option"))
    return options(spark, d).select("item_id", "option_idx", *[F.round(s[c], 6).alias(c) for c in ("precision", "recall", "f1")])


def exact_match(spark, d):
    return options(spark, d).select("item_id", "option_idx", (T.normalize_answer(F.col("answer")) == T.normalize_answer(F.col("option"))).alias("em"))


def max_over_references(spark, d):
    best = options(spark, d).groupBy("item_id", F.coalesce("question_type", F.lit("Unknown")).alias("question_type")).agg(F.max(T.token_scores(F.col("answer"), F.col("option"))["f1"]).alias("best"))
    return best.groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("f1"))


def ngrams(column: str, n: int):
    words = F.filter(F.split(F.lower(column), "[^a-z0-9]+", -1), lambda w: w != "")
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge(spark, d, n: int):
    base = items(spark, d).where("question is not null and passage is not null").select("item_id", ngrams("question", n).alias("g"), ngrams("passage", n).alias("p"))
    g = base.select("item_id", F.explode("g").alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("a"))
    p = base.select("item_id", F.explode("p").alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("b"))
    hits = g.join(p, ["item_id", "w"]).groupBy("item_id").agg(F.sum(F.least("a", "b")).alias("h"))
    j = base.select("item_id", F.size("g").alias("ng"), F.size("p").alias("np")).join(hits, "item_id", "left")
    h = F.coalesce("h", F.lit(0))
    return j.select("item_id", F.round(F.when(h == 0, 0.0).otherwise(2.0 * h / (F.col("ng") + F.col("np"))), 6).alias("f1"))


def rouge1(spark, d):
    return rouge(spark, d, 1)


def rouge2(spark, d):
    return rouge(spark, d, 2)


def rougeL(spark, d):
    """F-measure of the longest common subsequence of words."""
    rows = items(spark, d).where("question is not null and passage is not null")
    return S.rouge(rows, ("item_id",), "question", "passage", stemmed=False).select("item_id", F.col("rougeL").alias("f1"))


def rouge_stemmed(spark, d):
    """The three ROUGE scores over stems."""
    rows = items(spark, d).where("question is not null and passage is not null")
    return S.rouge(rows, ("item_id",), "question", "passage")


def best_rouge(spark, d):
    """The best ROUGE of each item over its options as references."""
    scores = S.rouge(options(spark, d), ("item_id", "option_idx"), "option", "answer", stemmed=False)
    return S.best_over_references(scores, "item_id", ("rouge1", "rouge2"))


def graded_report(spark, d):
    """Results of every event against the last type its user is listed under: a join with duplicate keys, a fallback and a total."""
    e = table(spark, d, "events")
    results = e.select(F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("judge"), F.when(F.col("event_id") % 3 == 1, 1.0).alias("label"), "value")
    types = e.where("event_id % 2 = 0").select(F.col("user_id").alias("id"), F.col("event_type").alias("question_type"), F.col("event_id").alias("place"))
    return S.report(results, types, ("value",), fallback="label")


def answer_accuracy(spark, d):
    return S.accuracy(options(spark, d), F.lower(T.trim_ws(F.col("answer"))) == F.lower(T.trim_ws(F.col("option"))))


def claim_confusion_f1(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("gold"), F.when(F.col("l_linestatus") == "F", " Yes").when(F.col("l_quantity") > 45, "maybe").otherwise("NO").alias("guess"))
    return R.claim_confusion(rows, F.col("gold"), F.col("guess"))


def grouped_metrics_overall(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce(F.lower("lang"), F.lit("Unknown")).alias("question_type"), F.length("text").alias("n"), (F.col("n_chars") == F.length("text")).alias("right"))
    return R.by_group_and_overall(docs, "question_type", {"n": F.count("*"), "right_pct": F.format_string("%.2f", 100 * F.avg(F.coalesce("right", F.lit(False)).cast("double"))), "mean_chars": F.round(F.avg("n"), 4)})


def last_wins_lookup(spark, d):
    return R.last_wins(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


def contiguous_merge(spark, d):
    """Runs of consecutive chunks of a document."""
    rows = latest(table(spark, d, "chunks").where("doc_id is not null"), "chunk_id", "doc_id", "text").select("doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    return R.contiguous_runs(rows, "doc_id", "chunk_id", "text").select("doc_id", "node_id", "n", F.md5("text").alias("text_md5"))


def entity_list_parse(spark, d):
    rows = latest(table(spark, d, "chunk_metadata").where("gist is not null"), "chunk_id", "gist")
    return rows.select("chunk_id", F.array_join(T.entity_list(F.col("gist")), "|").alias("entities"))


def record_titles(spark, d):
    c = latest(table(spark, d, "corpus"), "rec_id", "title", "headline", "body")
    return c.select("rec_id", T.record_title(c.columns, "body", "rec_id").alias("title"))


def filename_sanitize_dedupe(spark, d):
    """File names of all records; the first of a name keeps it, later ones are numbered."""
    named = record_titles(spark, d).select("rec_id", T.sanitize_filename(F.col("title")).alias("name"))
    return ranked(named, "name", "rec_id", "k").select("rec_id", F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("k").cast("string"))).alias("file"))


def corpus_texts(spark, d):
    c = latest(table(spark, d, "corpus"), "rec_id", "body", "headline")
    return c.select("rec_id", F.length(T.trim_ws(F.coalesce("body", "headline", F.lit("")))).alias("n")).where("n > 0")


def title_documents(spark, d):
    c = latest(table(spark, d, "chunks").where("title is not null"), "chunk_id", "title")
    return c.groupBy(F.trim(T.title_stem(F.col("title"))).alias("stem")).agg(F.count("*").alias("chunks"))


def json_fallback_parse(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json(T.json_object(F.col("props")), "map<string,string>").alias("m"))
    return e.select("event_id", F.coalesce(F.size("m"), F.lit(0)).alias("keys"), F.col("m")["k"].cast("bigint").alias("k"))


def required_fields(spark, d):
    ok = (F.length(F.trim("qid")) > 0) & (F.length(F.trim("question")) > 0) & F.col("question_type").isNotNull()
    return table(spark, d, "eval_items").where(ok).select("item_id", "qid", F.col("answer").cast("string").alias("answer")).distinct()


def seeded_sample(spark, d):
    """Ten documents that the same seed always draws: the sampling operator."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(10)


def skip_existing(spark, d):
    """Chunks without metadata: what a rerun has still to do."""
    return table(spark, d, "chunks").select("chunk_id").distinct().join(table(spark, d, "chunk_metadata").select("chunk_id").distinct(), "chunk_id", "left_anti")


def entity_type_similarity(spark, d):
    """Share of common entities of consecutive chunks of a document."""
    m = latest(table(spark, d, "chunk_metadata").where("doc_id is not null"), "chunk_id", "doc_id", "entity_concepts")
    types = F.array_distinct(F.transform(F.coalesce("entity_concepts", F.array().cast("array<string>")), lambda x: F.lower(x)))
    m = m.select("chunk_id", "doc_id", types.alias("types"))
    nxt = m.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("doc_id").alias("d2"), F.col("types").alias("t2"))
    small = F.least(F.size("types"), F.size("t2"))
    return m.join(nxt, "chunk_id").where("doc_id = d2").select("chunk_id", F.round(F.coalesce(F.size(F.array_intersect("types", "t2")) / F.nullif(small, F.lit(0)), F.lit(0.0)), 6).alias("overlap"))


QUERIES = (
    paragraph_split, greedy_token_chunks, token_totals, book_chunks, conversation_chunks, split_turn_chunks, information_preserved, turn_chunks, session_book, normalize_answer, token_f1,
    exact_match, max_over_references, rouge1, rouge2, rougeL, rouge_stemmed, best_rouge, graded_report, answer_accuracy, claim_confusion_f1, grouped_metrics_overall, last_wins_lookup, contiguous_merge, entity_list_parse,
    record_titles, filename_sanitize_dedupe, corpus_texts, title_documents, json_fallback_parse, required_fields, seeded_sample, skip_existing, entity_type_similarity,
)

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS = "list_distinct(regexp_split_to_array(" + NORM + ", '[ -]'))"
ITEMS = "items AS MATERIALIZED (SELECT item_id, arg_max(question, loaded) AS question, arg_max(answer, loaded) AS answer, max(answer_options) AS answer_options, max(passage) AS passage, max(question_type) AS question_type FROM (SELECT *, 1 AS loaded FROM eval_items) GROUP BY item_id)"
OPTIONS = f"{ITEMS}, options AS (SELECT item_id, question_type, answer, unnest(answer_options) AS option, generate_subscripts(answer_options, 1) - 1 AS option_idx FROM items WHERE answer IS NOT NULL)"
SCORES = f"{OPTIONS}, sets AS (SELECT *, {WORDS.format('answer')} AS a, {WORDS.format('option')} AS b FROM options), hits AS (SELECT *, len(list_intersect(a, b)) AS h FROM sets), scored AS (SELECT *, h / len(b) AS p, h / len(a) AS r, CASE WHEN h = 0 THEN 0.0 ELSE 2 * (h / len(b)) * (h / len(a)) / (h / len(b) + h / len(a)) END AS f1 FROM hits)"
LINES = r"lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents WHERE {0})"
TURNS = LINES.format("lower(trim(source, ' ')) = 'chat_sessions'") + r""", turns AS (SELECT doc_id, idx, CASE WHEN regexp_matches(line, '^Session (\d+) \((.*)\):$') THEN regexp_extract(line, '^Session (\d+) \((.*)\):$', 1)::INT END AS session,
CASE WHEN regexp_matches(line, '^Session (\d+) \((.*)\):$') THEN regexp_extract(line, '^Session (\d+) \((.*)\):$', 2) END AS date,
CASE WHEN regexp_matches(line, '^(user|assistant): (.*)$') THEN regexp_extract(line, '^(user|assistant): (.*)$', 1) ELSE 'Unknown' END AS role,
CASE WHEN regexp_matches(line, '^(user|assistant): (.*)$') THEN regexp_extract(line, '^(user|assistant): (.*)$', 2) ELSE line END AS content FROM lines WHERE length(line) > 0)"""
COUNTS = LINES.format("text IS NOT NULL") + r", parts AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k, len(regexp_split_to_array(" + TRIM.format("line") + r", '\s+')) AS n FROM lines WHERE " + TRIM.format("line") + " <> '')"


def last_of(name: str, key: str, columns: str, where: str = "true") -> str:
    return f"(SELECT {key}, {columns} FROM {name} WHERE {key} IS NOT NULL AND {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)"


def rouge_sql(n: int) -> str:
    grams = f"(CASE WHEN len(w) >= {n} THEN list_transform(generate_series(1, len(w) - {n} + 1), lambda i: array_to_string(w[i:i+{n - 1}], ' ')) ELSE [] END)"
    part = lambda c: f"(SELECT item_id, {grams} AS g FROM (SELECT item_id, list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM items WHERE question IS NOT NULL AND passage IS NOT NULL))"
    return f"""WITH {ITEMS}, q AS MATERIALIZED {part('question')}, p AS MATERIALIZED {part('passage')},
qc AS (SELECT item_id, w, count(*) AS a FROM (SELECT item_id, unnest(g) AS w FROM q) GROUP BY ALL), pc AS (SELECT item_id, w, count(*) AS b FROM (SELECT item_id, unnest(g) AS w FROM p) GROUP BY ALL),
h AS (SELECT item_id, sum(least(a, b)) AS h FROM qc JOIN pc USING (item_id, w) GROUP BY item_id)
SELECT q.item_id, round(CASE WHEN coalesce(h, 0) = 0 THEN 0.0 ELSE 2.0 * h / (len(q.g) + len(p.g)) END, 6) AS f1 FROM q JOIN p USING (item_id) LEFT JOIN h USING (item_id)"""


def oracle_sql() -> dict[str, str]:
    titles = f"""SELECT rec_id, coalesce(nullif({TRIM.format("coalesce(title, '')")}, ''), nullif({TRIM.format("coalesce(headline, '')")}, ''),
nullif(left({TRIM.format("string_split(" + TRIM.format("coalesce(body, '')") + ", chr(10))[1]")}, 120), ''), 'doc_' || rec_id) AS title FROM {last_of("corpus", "rec_id", "title, headline, body")}"""
    chunks = last_of("chunks", "chunk_id", "doc_id, coalesce(text, '') AS text", "doc_id IS NOT NULL")
    meta = last_of("chunk_metadata", "chunk_id", "doc_id, list_distinct(list_transform(coalesce(entity_concepts, []), lambda x: lower(x))) AS types", "doc_id IS NOT NULL")
    yes = {"g": "gold = 'yes'", "n": "gold <> 'yes'"}
    f1 = lambda s: f"round(coalesce(2.0 * tp_{s} / nullif(2 * tp_{s} + fp_{s} + fn_{s}, 0), 0), 6) AS f1_{s}"
    return {
        "paragraph_split": f"WITH {LINES.format('text IS NOT NULL')} SELECT doc_id, idx, line AS paragraph FROM lines WHERE length(line) > 0",
        "greedy_token_chunks": f"""WITH RECURSIVE {COUNTS}, g(doc_id, k, chunk, total) AS (SELECT doc_id, k, 0, n FROM parts WHERE k = 1 UNION ALL
SELECT p.doc_id, p.k, CASE WHEN g.total + p.n <= {SIZE} THEN g.chunk ELSE g.chunk + 1 END, CASE WHEN g.total + p.n <= {SIZE} THEN g.total + p.n ELSE p.n END FROM g JOIN parts p ON p.doc_id = g.doc_id AND p.k = g.k + 1)
SELECT doc_id AS book_id, chunk AS chunk_id, count(*) AS n_parts, max(total) AS n_tokens FROM g GROUP BY doc_id, chunk""",
        "token_totals": f"WITH {COUNTS} SELECT d.doc_id AS book_id, count(n) AS paragraphs, coalesce(sum(n), 0) AS n_tokens FROM documents d LEFT JOIN parts USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id",
        "information_preserved": r"SELECT doc_id AS book_id, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS characters, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS kept FROM documents WHERE text IS NOT NULL",
        "turn_chunks": f"WITH {TURNS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS chunk_id, role || ': ' || content AS text FROM turns WHERE session IS NULL",
        "session_book": f"""WITH {TURNS}, s AS (SELECT *, max(CASE WHEN session IS NOT NULL THEN {{'s': session, 'd': date}} END) OVER (PARTITION BY doc_id ORDER BY idx) AS h FROM turns)
SELECT doc_id, h.s AS session, 'Session ' || coalesce(h.s::VARCHAR, '0') || ' (' || coalesce(h.d, '') || '):' || chr(10) || string_agg(role || ': ' || content, chr(10) ORDER BY idx) AS text
FROM s WHERE session IS NULL AND {TRIM.format('content')} <> '' GROUP BY doc_id, h.s, h.d""",
        "normalize_answer": f"WITH {ITEMS} SELECT item_id, {NORM.format('answer')} AS answer, {NORM.format('question')} AS question FROM items",
        "token_f1": f"WITH {SCORES} SELECT item_id, option_idx, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM scored",
        "exact_match": f"WITH {OPTIONS} SELECT item_id, option_idx, {NORM.format('answer')} = {NORM.format('option')} AS em FROM options",
        "max_over_references": f"WITH {SCORES}, best AS (SELECT item_id, coalesce(question_type, 'Unknown') AS question_type, max(f1) AS b FROM scored GROUP BY ALL) SELECT question_type, count(*) AS n, round(avg(b), 6) AS f1 FROM best GROUP BY question_type",
        "rouge1": rouge_sql(1),
        "rouge2": rouge_sql(2),
        "best_rouge": f"""WITH {OPTIONS}, w AS (SELECT item_id, option_idx, list_filter(regexp_split_to_array(lower(answer), '[^a-z0-9]+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(option), '[^a-z0-9]+'), lambda x: x <> '') AS g FROM options),
n AS (SELECT item_id, option_idx, k, {", ".join(f"(CASE WHEN len({c}) >= k THEN list_transform(generate_series(1, len({c}) - k + 1), lambda i: array_to_string({c}[i:i + k - 1], ' ')) ELSE [] END) AS {c}" for c in "pg")} FROM w, (VALUES (1), (2)) v(k)),
h AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS hits FROM n),
f AS (SELECT item_id, k, CASE WHEN hits = 0 THEN 0.0 ELSE round(2.0 * hits / (len(p) + len(g)), 6) END AS f FROM h)
SELECT item_id, max(f) FILTER (k = 1) AS rouge1, max(f) FILTER (k = 2) AS rouge2 FROM f GROUP BY item_id""",
        "graded_report": """WITH t AS (SELECT user_id AS id, event_type AS question_type FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
r AS (SELECT coalesce(question_type, 'Unknown') AS question_type, value, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN 1.0 END, 0.0) AS judge FROM events JOIN t ON t.id = user_id WHERE event_id % 10 <> 0)
SELECT question_type, grouping(question_type) AS is_total, count(*) AS n, round(avg(coalesce(value, 0)), 6) AS value, round(avg(judge), 6) AS judge FROM r GROUP BY GROUPING SETS ((question_type), ())""",
        "answer_accuracy": f"WITH {OPTIONS}, r AS (SELECT count(*) AS n, coalesce(sum((lower({TRIM.format('answer')}) = lower({TRIM.format('option')}))::INT), 0)::BIGINT AS \"right\" FROM options) SELECT n, \"right\", \"right\" / greatest(1, n) AS accuracy FROM r",
        "claim_confusion_f1": f"""WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS gold, CASE WHEN l_linestatus = 'F' THEN 'yes' WHEN l_quantity > 45 THEN 'maybe' ELSE 'no' END AS guess FROM lineitem),
c AS (SELECT count(*) FILTER ({yes['g']} AND guess = 'yes') AS tp_true, count(*) FILTER ({yes['g']} AND guess <> 'yes') AS fn_true, count(*) FILTER ({yes['n']} AND guess <> 'no') AS fp_true,
count(*) FILTER ({yes['n']} AND guess = 'no') AS tp_false, count(*) FILTER ({yes['n']} AND guess <> 'no') AS fn_false, count(*) FILTER ({yes['g']} AND guess <> 'yes') AS fp_false, count(*) AS n FROM r) SELECT *, {f1('true')}, {f1('false')} FROM c""",
        "grouped_metrics_overall": """WITH r AS (SELECT coalesce(lower(lang), 'Unknown') AS question_type, length(text) AS n, coalesce(n_chars = length(text), false) AS ok FROM documents)
SELECT question_type, grouping(question_type) AS is_total, count(*) AS n, printf('%.2f', 100 * avg(ok::INT)) AS right_pct, round(avg(n), 4) AS mean_chars FROM r GROUP BY GROUPING SETS ((question_type), ())""",
        "last_wins_lookup": "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "contiguous_merge": f"WITH c AS (SELECT *, chunk_id - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS island FROM {chunks}) SELECT doc_id, max(chunk_id) AS node_id, count(*) AS n, md5(string_agg(text, ' ' ORDER BY chunk_id)) AS text_md5 FROM c GROUP BY doc_id, island",
        "entity_list_parse": f"""WITH i AS (SELECT chunk_id, unnest(string_split(gist, ';')) AS raw, generate_subscripts(string_split(gist, ';'), 1) AS k FROM {last_of("chunk_metadata", "chunk_id", "gist", "gist IS NOT NULL")}),
f AS (SELECT chunk_id, item, min(k) AS k FROM (SELECT chunk_id, {TRIM.format('raw')} AS item, k FROM i) GROUP BY chunk_id, item), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY k) AS n FROM f)
SELECT chunk_id, coalesce(string_agg(item, '|' ORDER BY n) FILTER (item <> '' AND n <= 5), '') AS entities FROM r GROUP BY chunk_id""",
        "record_titles": titles,
        "filename_sanitize_dedupe": rf"""WITH t AS ({titles}), n AS (SELECT rec_id, coalesce(nullif(left(trim(regexp_replace(title, '[\\/*?:"<>|]', '_', 'g'), ' '), 200), ''), 'doc') AS name FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rec_id) - 1 AS k FROM n) SELECT rec_id, CASE WHEN k = 0 THEN name ELSE name || '_' || k END AS file FROM k""",
        "corpus_texts": f"SELECT rec_id, length({TRIM.format('t')}) AS n FROM (SELECT rec_id, coalesce(body, headline, '') AS t FROM {last_of('corpus', 'rec_id', 'body, headline')}) WHERE length({TRIM.format('t')}) > 0",
        "title_documents": f"SELECT trim(regexp_replace(title, '_chunk(ed)?_.*$', ''), ' ') AS stem, count(*) AS chunks FROM {last_of('chunks', 'chunk_id', 'title', 'title IS NOT NULL')} GROUP BY 1",
        "json_fallback_parse": r"SELECT event_id, CASE WHEN j IS NULL THEN 0 ELSE len(json_keys(j)) END AS keys, (j->>'k')::BIGINT AS k FROM (SELECT event_id, try_cast(nullif(regexp_extract(props, '(?s)\{.*\}'), '') AS JSON) AS j FROM events)",
        "required_fields": "SELECT DISTINCT item_id, qid, answer::VARCHAR AS answer FROM eval_items WHERE length(trim(qid)) > 0 AND length(trim(question)) > 0 AND question_type IS NOT NULL",
        "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id LIMIT 10",
        "skip_existing": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_metadata WHERE chunk_id IS NOT NULL)",
        "entity_type_similarity": f"WITH m AS MATERIALIZED {meta} SELECT a.chunk_id, round(coalesce(len(list_intersect(a.types, b.types)) / nullif(least(len(a.types), len(b.types)), 0), 0.0), 6) AS overlap FROM m a JOIN m b ON b.chunk_id = a.chunk_id + 1 AND a.doc_id = b.doc_id",
    }
