import contextlib
import datetime
import pathlib
import threading

import numpy as np
import pytest

from stratamem.llm import clusters, neighbours
from stratamem.llm.vectors import unit_vectors

SCHEMA = "chunk_id bigint, doc_id string, chunk_embedding array<float>, loaded_at timestamp_ntz, id string, vec string, rank string"


def table(spark, vectors, schema=SCHEMA):
    now = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, None, v, now, "x", "y", "z") for i, v in vectors], schema)


def random_vectors(n, seed=0, dim=64, centres=6, noise=0.25):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    x = c[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, dim))
    x[: n // 4] = rng.standard_normal((n // 4, dim))
    return x * rng.uniform(0.1, 9, n)[:, None]


BROKEN = [(9001, None), (9002, [1.0] * 48), (9003, [0.0] * 64), (9004, [float("nan")] + [1.0] * 63), (9005, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (9006, [])]


def brute(x, ids, k):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: sorted(((round(-s[i, j], 6), ids[j]) for j in range(len(ids)) if j != i))[:k] for i in range(len(ids))}


def test_usable_vectors_only(spark):
    got = unit_vectors(table(spark, [(1, [2.0] + [0.0] * 63), (1, [2.0] + [0.0] * 63), (2, [1e-30] * 64), *BROKEN]), "chunk_id", "chunk_embedding").collect()
    assert sorted(r.id for r in got) == [1, 2]
    assert all(abs(np.linalg.norm(np.frombuffer(r.vec, np.float32)) - 1) < 1e-5 for r in got)


def test_hilbert_visits_neighbours():
    cells = np.stack(np.meshgrid(np.arange(8), np.arange(8), np.arange(8), indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_are_exact_within_a_window(spark):
    x = random_vectors(300)
    got = neighbours.most_similar(table(spark, [*((i, v.tolist()) for i, v in enumerate(x)), *BROKEN]), "chunk_id", "chunk_embedding").collect()
    want = brute(x, list(range(300)), 5)
    assert {r.id for r in got} == set(range(300))
    for i in range(300):
        mine = sorted((r.rank, r.neighbour, r.cosine) for r in got if r.id == i)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], [-w[0] for w in want[i]], atol=1e-5)


def test_windows_and_ranges_merge(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 64)
    monkeypatch.setattr(neighbours, "BEFORE", 32)
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 512)
    x = random_vectors(600, centres=12)
    got = {(r.id, r.neighbour) for r in neighbours.most_similar(table(spark, list(enumerate(x.tolist()))), "chunk_id", "chunk_embedding").collect()}
    want = {(i, j) for i, v in brute(x, list(range(600)), 5).items() for _, j in v}
    assert len(got & want) / len(want) > 0.9


def test_a_hot_group_of_copies_and_few_rows(spark):
    x = random_vectors(40, seed=2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[7].tolist()) for i in range(30)]
    got = neighbours.most_similar(table(spark, rows), "chunk_id", "chunk_embedding").collect()
    by = {i: sorted((r.rank, r.neighbour) for r in got if r.id == i) for i in {r.id for r in got}}
    assert [n for _, n in by[7]] == [100, 101, 102, 103, 104]
    assert [n for _, n in by[129]] == [7, 100, 101, 102, 103]
    assert all(len(v) == 5 for v in by.values()) and len(by) == 70
    assert neighbours.most_similar(table(spark, rows[:3]), "chunk_id", "chunk_embedding").count() == 6
    assert neighbours.most_similar(table(spark, rows[:1]), "chunk_id", "chunk_embedding").count() == 0
    assert neighbours.most_similar(table(spark, rows).limit(0), "chunk_id", "chunk_embedding").count() == 0


def test_recall_report(spark):
    x = random_vectors(200, seed=4)
    r = neighbours.recall(table(spark, list(enumerate(x.tolist()))), "chunk_id", "chunk_embedding").first()
    assert (r.queries, r.due) == (10, 50) and r.recall == 1.0


def both(spark, vectors):
    supers = spark.createDataFrame([(5000 + i, 1 if i % 2 else None, None, v, datetime.datetime(2026, 1, 1)) for i, v in vectors[:20]], "node_id bigint, level int, doc_id string, super_embedding array<float>, loaded_at timestamp_ntz")
    return clusters.levels(table(spark, vectors), supers)


def truth(x, least):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("bucket", "task"), [(8192, 2), (64, 100), (64, 3)])
def test_groups_match_brute_force(spark, monkeypatch, bucket, task):
    monkeypatch.setattr(clusters, "BUCKET", bucket)
    monkeypatch.setattr(clusters, "TASK_BUCKETS", task)
    x = random_vectors(500, seed=1, centres=9, noise=0.3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[3].tolist()), *BROKEN]
    got = {(r.first_id, r.member_id) for r in clusters.similarity_groups(both(spark, rows)).where("level = 0").collect()}
    label = truth(x, 0.8)
    want = {(int(f), i) for i, f in enumerate(label) if f != i} | {(int(label[3]), 1000)}
    assert got == want


def test_groups_of_nothing(spark):
    none = both(spark, [(1, [0.0] * 64)])
    assert clusters.similarity_groups(none).count() == 0
    assert clusters.clusters(none).count() == 0


def test_clusters_split_loose_groups(spark):
    # a chain: each link is close, the ends are not
    chain = [[float(np.cos(a)), float(np.sin(a))] + [0.0] * 62 for a in np.arange(8) * 0.5]
    rows = [(i, v) for i, v in enumerate(chain)] + [(50, [0.0] * 63 + [1.0]), (51, [0.0] * 63 + [2.0])]
    got = clusters.clusters(clusters.levels(table(spark, rows), spark.createDataFrame([], "node_id bigint, level int, super_embedding array<float>, loaded_at timestamp_ntz"))).collect()
    assert sum(r["size"] for r in got) == 10
    assert sorted(r["size"] for r in got)[-1] <= 3
    assert {tuple(r.typical) for r in got if r.medoid == 50} == {(50, 51)}


def test_overfull_buckets_compare_all_pairs(spark, monkeypatch):
    # all in one cone, so that most share their buckets; the pairs are close to each other only
    rng = np.random.default_rng(8)
    x = 1.6 * np.eye(64)[0] + rng.standard_normal((700, 64)) / 8
    twin = x[:100] + 0.055 * rng.standard_normal((100, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, twin]))]
    u = np.array([v for _, v in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    least = 0.88
    monkeypatch.setattr(clusters, "bands_for", lambda n, least: (0, 1))  # one bucket, 20 parts
    monkeypatch.setattr(clusters, "bucket_for", lambda n: 40)
    got = {(r.first_id, r.member_id) for r in clusters.similarity_groups(both(spark, rows), least).where("level = 0").collect()}
    label = truth(u, least)
    assert got == {(int(f), i) for i, f in enumerate(label) if f != i} and len(got) > 50


def test_a_group_of_many_medoids_ends_in_clusters_of_similar_vectors(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TRIED", 4)
    monkeypatch.setattr(clusters, "TRIED_MOST", 16)
    monkeypatch.setattr(clusters, "SPREAD", 50)
    # a chain through 63 orthogonal directions: one group, and each medoid reaches few
    steps = [np.cos(t) * np.eye(64)[k] + np.sin(t) * np.eye(64)[k + 1] for k in range(62) for t in (0, 0.5, 1.0)]
    rows = [(i, v.tolist()) for i, v in enumerate(steps)]
    none = spark.createDataFrame([], "node_id bigint, level int, super_embedding array<float>, loaded_at timestamp_ntz")
    units = clusters.levels(table(spark, rows), none)
    got = clusters.clusters(units).collect()
    u = np.array(steps, np.float32).astype(float)
    near = u @ u.T >= 0.8
    open_, want = set(range(len(u))), {}
    order = sorted(open_, key=lambda i: (-near[i].sum(), i))
    for i in order:
        if i in open_:
            want[i] = sum(near[i, j] for j in open_)
            open_ -= {j for j in open_ if near[i, j]}
    assert len(want) > 41 and {r.medoid: r["size"] for r in got} == want
    assert min(r.mean_cosine for r in got) >= 0.8


def test_bands_are_taken_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BUCKET", 64)
    monkeypatch.setattr(clusters, "ROUND_ROWS", 0, raising=False)
    x = random_vectors(3000, seed=3, centres=40, noise=0.3)
    x[1500:2400] = x[1500] / np.linalg.norm(x[1500]) * 8 + 0.3 * np.random.default_rng(4).standard_normal((900, 64))  # overfull buckets
    units = both(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    dirs = [pathlib.Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        total = 0
        for d in dirs:
            for f in d.rglob("shuffle_*.data"):
                with contextlib.suppress(FileNotFoundError):
                    total += f.stat().st_size
        return total

    before, most, done = shuffled(), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            most.append(shuffled() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {(r.first_id, r.member_id) for r in clusters.similarity_groups(units).where("level = 0").collect()}
    finally:
        done.set()
        watcher.join()
    label = truth(x, 0.8)
    assert got == {(int(f), i) for i, f in enumerate(label) if f != i}
    assert max(most) < 8 * x.shape[0] * 64 * 4
