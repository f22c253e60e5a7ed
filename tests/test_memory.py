import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.config import ANSWERS, CHOICES, Building, Chunking, Exploring
from stratamem.operators import explore as E
from stratamem.operators import levels as L
from stratamem.operators import memory as M
from stratamem.operators import models
from stratamem.operators import similarity as S

CHUNKS = "book_id string, at bigint, text string, vec array<float>"


def book(name, groups, size, seed):
    """Chunks in groups of like vectors."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((groups, 8)), size, axis=0) + 0.3 * rng.standard_normal((groups * size, 8))
    return [(name, i * 2, f"{name} says thing {i}. More.", v.tolist()) for i, v in enumerate(x)]


def rows_of(nodes, name):
    return sorted((r.level, r.node_id, r.text, tuple(r.children)) for r in nodes.where(F.col("book_id") == name).collect())


def test_books_are_built_apart_in_one_job(spark):
    setting = Building(threshold=0.5, weight=0.8, sigma=0.5, max_cluster_size=5, max_hierarchy_level=2, rounds=3)
    a, b = book("a", 6, 6, 1), book("b", 2, 9, 2)
    odd = [("c", 0, None, [1.0] * 8), ("d", 0, "no vector", None), ("d", 1, "short", [1.0]), (None, 3, "no book", [1.0] * 8)]
    nodes, edges, stats = M.build(spark.createDataFrame(a + b + odd, CHUNKS), setting)
    for name, rows in (("a", a),):
        alone, alone_edges, _ = M.build(spark.createDataFrame(rows, CHUNKS), setting)
        assert rows_of(nodes, name) == rows_of(alone, name)
        assert {tuple(r) for r in edges.where(F.col("book_id") == name).collect()} == {tuple(r) for r in alone_edges.collect()}
    got = rows_of(nodes, "a")
    assert [g[1] for g in got] == list(range(len(got))) and max(g[0] for g in got) >= 1
    level = {g[1]: g[0] for g in got}
    assert all(level[c] == g[0] - 1 for g in got for c in g[3]) and all(0 < len(g[3]) <= 5 for g in got if g[0])
    assert {c for g in got if g[0] == 1 for c in g[3]} == set(range(36))
    first = next(g for g in got if g[0] == 1)
    assert first[2] == f"Passage 1: a says thing {min(first[3])}."
    assert nodes.where("level > 0 and vec is null").isEmpty()
    assert rows_of(nodes, "c") == [(0, 0, None, ())] and len(rows_of(nodes, "d")) == 2
    s = {(r.book_id, r.level): r for r in stats.collect()}
    assert s["a", 0].nodes == 36 and s["a", 1].offset == 36
    assert {r.book_id for r in nodes.select("book_id").distinct().collect()} == {"a", "b", "c", "d"}
    assert M.build(spark.createDataFrame([], CHUNKS), setting)[0].count() == 0


def test_a_level_in_the_task_of_its_book_equals_the_joins(spark, monkeypatch):
    rng = np.random.default_rng(5)
    links, nodes, first = [], [], 0
    for name, n, share in (("a", 40, 0.3), ("b", 90, 0.05), ("c", 5, 0.0), ("d", 2, 1.0), ("e", 400, 0.006)):
        nodes += [(first + i, name) for i in range(n)]
        links += [(name, first + i, first + j, 1.0) for j in range(n) for i in range(j) if rng.random() < share]
        first += n
    links += [("a", 3, 3, 1.0), ("a", links[0][2], links[0][1], 1.0)]
    links, nodes = spark.createDataFrame(links, "book_id string, u bigint, v bigint, weight double"), spark.createDataFrame(nodes, "id bigint, book_id string")
    for rounds, cap in ((8, 3), (2, 12), (8, None)):
        setting, told = Building(rounds=rounds, max_cluster_size=cap), []
        for dense, sparse, small in ((L.DENSE, L.SPARSE, L.SMALL), (L.DENSE, L.SPARSE, 50), (-1, -1, 50)):
            for name, value in (("DENSE", dense), ("SPARSE", sparse), ("SMALL", small)):
                monkeypatch.setattr(L, name, value)
            told.append([sorted(tuple(r) for r in x.collect()) for x in L.next_level(links, nodes, setting)])
        assert told[0] == told[1] == told[2] and told[0][0] and told[0][1]
        monkeypatch.undo()
    assert L.next_level(links.limit(0), nodes.where("book_id = 'c'"), Building()) is None


def test_a_dense_book_makes_no_triangles():
    n = 300  # a clique has 44,850 edges and 4.5 million triangles
    pairs = np.array([(i, j) for j in range(n) for i in range(j)])
    ends, first = L.adjacent(n, pairs[:, 0], pairs[:, 1])
    own, other, node = L.split(n, ends, first)
    assert len(node) == n and (own == np.repeat(np.arange(n), n - 1)).all() and (other == ends).all()
    assert L.propagated(own, other, n, first, 8)[0][0] == n - 1


@pytest.mark.parametrize(("weight", "gamma", "masked"), [(0.6, 0.45, False), (0.6, 0.45, True), (0.5, 0.0, False)])
def test_only_the_best_of_each_pair_of_blocks_are_told(spark, monkeypatch, weight, gamma, masked):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(S, "BOOK_BLOCK", 40)  # the large book is four blocks, the small ones share a task
    x = np.repeat(rng.standard_normal((40, 6)), 5, axis=0).astype(np.float32)  # copies, so that ties go by id
    x[::2] += 0.2 * rng.standard_normal((100, 6)).astype(np.float32)
    x[7] = np.nan
    x[8] = 0
    sizes = {"big": 150, "s": 4, "t": 3, "u": 43}
    book = [b for b, n in sizes.items() for _ in range(n)]
    at = rng.permutation(200)
    doc = [None if i % 5 == 0 else f"d{i % 3}" for i in range(200)]
    rows = [(book[i], i, int(at[i]), x[i].tolist(), doc[i]) for i in range(200)] + [("s", 200, 9, None, "d1"), ("big", 201, 9, [1.0], "d1")]
    nodes = spark.createDataFrame(rows, "book_id string, id bigint, at bigint, vec array<float>, doc_id string")
    v = np.where(np.isfinite(x), x, 0).astype(float)
    v /= np.maximum(np.sqrt((v * v).sum(1)), 1e-150)[:, None]
    near = np.exp(-((at[:, None] - at[None, :]) ** 2) / 18.0) * (np.array([[a == b for b in doc] for a in doc]) if masked else 1)
    sim = np.round(weight * np.maximum(0, v @ v.T) + (1 - weight) * near, 6)
    want = set()
    for i in range(200):
        best = sorted((-sim[i, j], j) for j in range(200) if j != i and book[j] == book[i] and sim[i, j] >= gamma)[:3]
        want |= {(min(i, j), max(i, j), -s) for s, j in best}
    picks = S.picks_in_books(nodes, weight, 3.0, gamma, 3, masked).collect()
    assert len({(r.i, r.j) for r in picks}) == len(picks) and len(picks) <= 200 * 3 * 2 * 4
    got = S.picked_edges(spark.createDataFrame(picks), 3).collect()
    assert {(r.u, r.v) for r in got} == {w[:2] for w in want} and np.allclose(sorted(r.weight for r in got), sorted(w[2] for w in want), atol=1e-6)


def test_statements_inherit_from_their_chunk(spark):
    chunks = spark.createDataFrame([("b", 1, "One is. Two is.", ["x"]), ("b", 2, "", None), ("b", 5, "Three.", ["y"])], "book_id string, chunk_id bigint, text string, entities array<string>")
    got = M.statement_nodes(chunks, models.statements(chunks, "chunk_id", "text")).orderBy("at").collect()
    assert [(r.at, r.chunk_id, r.text, r.entities) for r in got] == [(0, 1, "One is.", ["x"]), (1, 1, "Two is.", ["x"]), (2, 5, "Three.", ["y"])]
    assert M.build_from_statements(chunks)[0].where("level = 0").count() == 3


def test_books_are_united_under_fresh_numbers(spark):
    rows = spark.createDataFrame([("b", 1, "x", None), ("a", 7, "y", None), ("b", 0, "z", None)], CHUNKS)
    assert [(r.doc_id, r["at"], r.text) for r in M.joined_books(rows).orderBy("at").collect()] == [("a", 0, "y"), ("b", 1, "z"), ("b", 2, "x")]


def scripted(replies):
    """A backend with the given replies; a local class, so that it reaches the workers by value."""

    class Scripted:
        def embed(self, texts):
            return np.array([[1.0, 0.0] if "near" in t else [0.0, 1.0] for t in texts], dtype=np.float32)

        def complete(self, task, values):
            if task == "select":
                return [replies(v["question"], v["passages"]) for v in values]
            return [f"{task}|{v.get('options', '')}|{v['passages']}" for v in values]

    return Scripted()


def memory(spark):
    # chunks 0 to 4 in a row, 5 is a super-node over 2 and 4
    texts = ["near zero", "far one", "far two", "far three", "far four", "near top"]
    nodes = [("b", 0 if i < 5 else 1, i, t, [1.0, 0.0] if "near" in t else [0.0, 1.0], [2, 4] if i == 5 else []) for i, t in enumerate(texts)] + [("other", 0, 0, "near stranger", [1.0, 0.0], [])]
    edges = [("b", 0, 1), ("b", 1, 2), ("b", 3, 4)]
    return spark.createDataFrame(nodes, "book_id string, level int, node_id bigint, text string, vec array<float>, children array<bigint>"), spark.createDataFrame(edges, "book_id string, u bigint, v bigint")


def ask(spark, replies, setting=Exploring(top_k=2)):
    nodes, edges = memory(spark)
    questions = spark.createDataFrame([(1, "b", "near?", "A. x\nB. y")], "qid bigint, book_id string, question string, options string")
    said, evidence = E.answers(nodes, edges, questions, setting, scripted(replies))
    return said.first().output, sorted((r.node, r.text) for r in evidence.collect())


def test_picks_grow_to_neighbours_and_members(spark):
    # first candidates are 0 and 5; both picked: then 0, 1, 2, 4, 5
    def replies(question, passages):
        return "[1, 2, 9]" if passages.count("Passage") == 2 else "[2, 3, 4]"

    output, evidence = ask(spark, replies, Exploring(top_k=2, max_turns=2))
    # 1, 2 and 4 were picked in the second turn; the runs 0-2 and 4 are merged under their last id
    assert evidence == [(2, "near zero far one far two"), (4, "far four"), (5, "near top")]
    assert output.startswith("answer||Passage 1: near zero far one far two\n")


def test_no_valid_reply_and_no_picks_fall_back_to_the_first_candidates(spark):
    for reply in ("none of them", "[7, 0, -1]"):
        assert ask(spark, lambda q, p, reply=reply: reply)[1] == [(0, "near zero"), (5, "near top")]


def test_stable_candidates_end_the_search(spark):
    output, evidence = ask(spark, lambda q, p: "(1,)", Exploring(task="choose", top_k=1, max_turns=5))
    assert evidence == [(0, "near zero")] and output == "choose|A. x\nB. y|Passage 1: near zero"


def test_replies_are_read_as_lists():
    assert models.listed(" [1, '2', 3.0] ") == [1, 2, 3] and models.listed("(4,)") == [4] and models.listed("{5}") == [5]
    assert all(models.listed(x) is None for x in ("", "one", "[a]", "7", "[1, None]", "__import__('os')"))


def test_settings_reject_unknown_modes():
    assert Chunking().chunk_size == 512 and (ANSWERS.tolerance, CHOICES.task) == (2, "choose")
    with pytest.raises(ValueError, match="unknown conversation mode"):
        Chunking(conversation_mode="verse")


def test_model_backed_operators(spark):
    rows = spark.createDataFrame([(1, "We met Anna, and then Bert Lee came. It rained."), (2, None)], "id bigint, t string")
    assert [(r.id, r["at"], r.statement) for r in models.statements(rows, "id", "t").collect()] == [(1, 0, "We met Anna, and then Bert Lee came."), (1, 1, "It rained.")]
    graph = {r.id: r for r in models.graph_elements(rows, "id", "t").collect()}
    assert [e.entity_name for e in graph[1].entities] == ["Anna", "Bert", "Lee"] and graph[2].entities == [] == graph[2].relationships
    assert {r.id: r.entities for r in models.entities(rows, "id", "t").collect()} == {1: ["Anna", "Bert Lee"], 2: []}
    pair = spark.createDataFrame([(1, "red barn", "red barn"), (2, "red barn", "blue sea")], "id bigint, r string, a string")
    assert {r.id: r.score for r in models.judged(pair, "id", "r", "a").collect()} == {1: 1.0, 2: 0.0}
    tries = []

    def send(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise OSError("busy")
        return " said "

    backend = models.PromptBackend(send, lambda t: np.zeros((len(t), 2)), retries=3, pause=0)
    assert backend.complete("gist", [{"passage": "p"}]) == ["said"] and len(tries) == 3
