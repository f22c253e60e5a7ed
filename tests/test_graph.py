import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratamem.operators import personas as P
from stratamem.operators import similarity as S
from stratamem.operators.components import connected_components
from stratamem.plans import graph
from stratamem.streaming import incremental as I
from stratamem.streaming.incremental import IncrementalMemory


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "u bigint, v bigint, weight double")


def split(spark, pairs, ids):
    e = edges(spark, pairs)
    comps = P.ego_components(e)
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    personas = P.persona_nodes(nodes, comps)
    return e, comps, personas


@pytest.mark.parametrize(
    ("pairs", "ids", "counts", "n_edges"),
    [
        ([(1, 2), (1, 3), (2, 3), (1, 4), (1, 5), (4, 5)], [1, 2, 3, 4, 5], {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}, 6),
        ([(1, 2), (2, 3)], [1, 2, 3], {1: 1, 2: 2, 3: 1}, 2),
        ([(0, 1), (0, 2), (0, 3)], [0, 1, 2, 3], {0: 3, 1: 1, 2: 1, 3: 1}, 3),
        ([], [9], {9: 1}, 0),
    ],
)
def test_personas(spark, pairs, ids, counts, n_edges):
    e, comps, personas = split(spark, pairs, ids)
    rows = personas.collect()
    assert {i: sum(r.node == i for r in rows) for i in ids} == counts
    assert sorted(r.persona for r in rows) == list(range(len(rows)))
    assert P.persona_edges(e, comps, personas).count() == n_edges


def test_size_cap(spark):
    labels = spark.createDataFrame([(i, 7) for i in range(25)], "persona bigint, label bigint")
    sizes = P.capped_communities(labels, 12).groupBy("community").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 12, 12]
    assert P.capped_communities(labels, None).select("community").distinct().count() == 1


def test_hierarchy_shrinks_and_is_dense(spark):
    pairs = [(a, b) for g in range(6) for a in range(g * 4, g * 4 + 4) for b in range(a + 1, g * 4 + 4)] + [(3, 4), (11, 12)]
    levels, composed = P.hierarchy(spark.range(24).select("id"), edges(spark, pairs))
    sizes = [r.nodes for r in levels.orderBy("level").collect()]
    assert sizes[0] == 24 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) > 1
    rows = composed.collect()
    assert sorted(r.node_id for r in rows) == list(range(sum(sizes)))
    assert {c for r in rows if r.level == 1 for c in r.children} == set(range(24))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_match_union_find(spark, pairs):
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(edges(spark, pairs)).collect()}
    assert got == {n: root(n) for n in parent}


def test_components_of_a_long_path_and_null_ends(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(None, 5), (7, None)], "u bigint, v bigint"))
    assert {r.component for r in connected_components(e).collect()} == {0}


def brute(ids, x, docs, w, s, g):
    out = {}
    for a in range(len(ids)):
        for b in range(len(ids)):
            if ids[a] < ids[b]:
                c = x[a] @ x[b] / max(1e-300, np.linalg.norm(x[a]) * np.linalg.norm(x[b]))
                near = np.exp(-((ids[a] - ids[b]) ** 2) / (2 * s * s)) * (docs is None or docs[a] == docs[b])
                sim = round(w * max(0, c) + (1 - w) * near, 6)
                if sim >= g:
                    out[ids[a], ids[b]] = sim
    return out


@pytest.mark.parametrize(("w", "g", "masked", "block"), [(0.6, 0.2, False, 2048), (0.6, 0.2, True, 16), (0.3, 0.45, False, 2048)])
def test_pair_scores(spark, monkeypatch, w, g, masked, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x[5] = 0
    ids, docs = list(range(0, 120, 2)), [None if i % 3 == 0 else f"d{i % 3}" for i in range(60)]
    df = spark.createDataFrame([(i, v.tolist(), d) for i, v, d in zip(ids, x, docs, strict=True)], "id bigint, vec array<double>, doc string")
    got = {(r.i, r.j): r.sim for r in S.scored_pairs(df, w, 2.0, g, masked).collect()}
    want = brute(ids, x, docs if masked else None, w, 2.0, g)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_knn_takes_ties_by_id_and_keeps_both_directions(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "i bigint, j bigint, sim double")
    assert {(r.u, r.v) for r in S.knn_edges(pairs, 1).collect()} == {(1, 4), (1, 2), (1, 3)}


def test_incremental_equals_split_of_its_edges(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 4)))]
    src = tmp_path / "in"
    memory = IncrementalMemory(spark, f"file://{tmp_path}/memory", gamma=0.4, k=3)
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "id bigint, vec array<double>").coalesce(1).write.mode("append").parquet(str(src))
        query = memory.stream(spark.readStream.schema("id bigint, vec array<double>").parquet(str(src)), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    v = memory.version()
    e, c = memory.load("edges", v), memory.load("components", v)
    assert memory.load("nodes", v).count() == 40
    assert {tuple(r) for r in P.ego_components(e).collect()} == {tuple(r) for r in c.select("o", "p", "comp").collect()}
    links = {(r.u, r.v): {r.p, r.q} for r in memory.load("links", v).collect()}
    comp = {(r.o, r.p): r.comp for r in c.collect()}
    assert links == {(r.u, r.v): {f"{r.u}:{comp[r.u, r.v]}", f"{r.v}:{comp[r.v, r.u]}"} for r in e.collect()}
    # of the first batch nobody picks again, and each new node picks its three best of all
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = np.round(0.6 * np.maximum(0, u @ u.T) + 0.4 * np.exp(-((np.arange(40)[:, None] - np.arange(40)) ** 2) / 2), 6)
    want = set()
    for i in range(40):
        seen = [j for j in range(20 if i < 20 else 40) if j != i and sim[i, j] >= 0.4]
        want |= {(min(i, j), max(i, j)) for j in sorted(seen, key=lambda j: (-sim[i, j], j))[:3]}
    assert {(r.u, r.v) for r in e.collect()} == want
    names = {f"{o}:{k}" for (o, _), k in comp.items()}
    labels = {r.persona: r.label for r in memory.load("labels", v).collect()}
    assert names <= labels.keys()
    clusters = {}
    for r in memory.clusters(v).collect():
        clusters.setdefault(r.label, set()).add(r.node)
    said = {r.label: r.text for r in memory.load("summaries", v).collect()}
    assert clusters.keys() <= said.keys() and set().union(*clusters.values()) == {o for o, _ in comp}
    assert memory.spark.read.parquet(f"{memory.path}/v{v}/nodes").count() == 20  # a version holds its own rows only
    memory.add(spark.createDataFrame(rows[:5], "id bigint, vec array<double>"), v)
    assert memory.version() == v


def test_only_changed_clusters_are_told(spark):
    before = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "label string, node bigint")
    after = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("b", 5), ("d", 4)], "label string, node bigint")
    assert {r.label for r in I.changed_clusters(before, after).collect()} == {"b", "d"}


def test_labels_spread_from_the_active_only(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "p string, q string")
    labels = spark.createDataFrame([(k, k) for k in "abcxy"], "persona string, label string")
    got = {r.persona: r.label for r in I.relabelled(labels, links, spark.createDataFrame([("a",)], "persona string")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "y"}


def looped_hierarchy(ids, pairs, rounds, cap, max_level=10):
    """The rule of ``hierarchy`` in plain loops: ``(sizes, composed rows)``."""
    place = {n: k for k, n in enumerate(sorted(ids))}
    now, local = {(place[u], place[v]) for u, v in pairs}, range(len(place))
    sizes, stacks = [len(place)], [{k: [] for k in local}]
    for _ in range(max_level):
        adj = {n: set() for n in local}
        for u, v in now:
            adj[u].add(v)
            adj[v].add(u)
        comp = {}
        for o in adj:
            for p in adj[o]:
                seen, todo = {p}, [p]
                while todo:
                    new = adj[todo.pop()] & adj[o] - seen
                    seen |= new
                    todo += new
                comp[o, p] = min(seen)
        keys = sorted({(o, c) for (o, _), c in comp.items()} | {(n, -1) for n in adj if not adj[n]})
        persona = {k: i for i, k in enumerate(keys)}
        padj = {i: set() for i in persona.values()}
        for u, v in now:
            x, y = persona[u, comp[u, v]], persona[v, comp[v, u]]
            padj[x].add(y)
            padj[y].add(x)
        label = {i: i for i in padj}
        for _ in range(rounds):
            old = dict(label)
            for i, others in padj.items():
                votes = [old[j] for j in others]
                best = max(((votes.count(x), x) for x in votes), default=None)
                if best and votes.count(old[i]) != best[0]:
                    label[i] = max(old[i], best[1])
        run, taken = {}, {}
        for i in sorted(label):
            run[i] = (label[i], taken.get(label[i], 0) // cap)
            taken[label[i]] = taken.get(label[i], 0) + 1
        number = {r: k for k, r in enumerate(sorted(set(run.values())))}
        if len(number) >= sizes[-1]:
            break
        members = {k: set() for k in number.values()}
        for i, r in run.items():
            members[number[r]].add(keys[i][0])
        of = {n: {c for c, m in members.items() if n in m} for n in adj}
        joined = [(c, e) for n in adj for c in of[n] for e in of[n]] + [(c, e) for u, v in now for c in of[u] for e in of[v]]
        now, local = {(min(p), max(p)) for p in joined if p[0] != p[1]}, range(len(number))
        sizes.append(len(number))
        stacks.append(members)
    offset = [sum(sizes[:k]) for k in range(len(sizes))]
    rows = {(k, offset[k] + n, ",".join(str(c + offset[k - 1]) for c in sorted(m))) for k, stack in enumerate(stacks) for n, m in stack.items()}
    return sizes, rows


def test_every_level_of_the_hierarchy_is_given(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 8))[np.arange(220) // 11] + 0.5 * rng.standard_normal((220, 8))
    spark.createDataFrame([(i, v.tolist(), "d") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = [(r.u, r.v) for r in graph.edges(spark, str(tmp_path), graph.CLUSTERED).collect()]
    sizes, rows = looped_hierarchy(range(220), pairs, graph.ROUNDS, graph.CAP)
    assert len(sizes) > 5
    got = sorted(tuple(r) for r in graph.hierarchy_levels(spark, str(tmp_path)).collect())
    assert got == [(k, n, sum(sizes[:k])) for k, n in enumerate(sizes)]
    assert {tuple(r) for r in graph.hierarchy_memory(spark, str(tmp_path)).collect()} == rows
