import numpy as np

from tidemark.llm.clusters import FeatureTree, assigned, cluster_members, described, near_members, ward

SCHEMA = "embedding_row long, embedding array<float>, encoded_at timestamp, part int"


def blobs(n=400, k=5, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:k]
    label = rng.integers(0, k, n)
    return centres[label] + 0.12 * rng.normal(size=(n, dim)), label


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v], None, 7) for i, v in enumerate(x)], SCHEMA)


def test_tree_keeps_counts_and_sums():
    x, _ = blobs()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = FeatureTree(32, threshold=0.9, max_leaves=10_000)
    tree.extend(x)
    n, s = tree.entries()
    assert n.sum() == 400 and np.allclose(s.sum(0), x.sum(0)) and len(n) == tree.size
    small = FeatureTree(32, threshold=0.9, max_leaves=20)  # rebuilt many times, with entries set aside
    small.extend(x)
    n, s = small.entries()
    assert n.sum() == 400 and np.allclose(s.sum(0), x.sum(0)) and len(n) <= 40


def test_small_clusters_beside_a_large_one_and_noise(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(32, 32)))[0][:6]
    sizes = [1500, 600, 300, 60, 8, 5]
    x = np.concatenate([c + 0.1 * rng.normal(size=(n, 32)) for c, n in zip(centres, sizes)])
    label = np.repeat(np.arange(6), sizes)
    for noise in (0, 120):
        rows = np.concatenate([x, rng.normal(size=(noise, 32))])
        got = assigned(frame(spark, rows), 6, threshold=0.5).toPandas()
        assert got.part.nunique() == 6
        real = got[got.row_id < len(x)]
        assert all(g.part.nunique() == 1 for _, g in real.assign(y=label[real.row_id]).groupby("y")) and real.part.nunique() == 6


def test_as_many_clusters_as_asked_for(spark):
    rng = np.random.default_rng(6)
    narrow = np.eye(8)[0] + 0.15 * rng.normal(size=(300, 8))  # all alike by the tree's first threshold
    assert assigned(frame(spark, narrow), 12).select("part").distinct().count() == 12


def test_ward_against_plain_agglomeration():
    rng = np.random.default_rng(2)
    n, s = rng.integers(1, 5, 40).astype(float), rng.normal(size=(40, 3))
    got = ward(n, s.copy(), 4)
    groups = [([i], n[i], s[i] / n[i]) for i in range(40)]
    while len(groups) > 4:
        cost = {(a, b): groups[a][1] * groups[b][1] / (groups[a][1] + groups[b][1]) * ((groups[a][2] - groups[b][2]) ** 2).sum() for a in range(len(groups)) for b in range(a)}
        a, b = min(cost, key=cost.get)
        x, y = groups[a], groups[b]
        merged = (x[0] + y[0], x[1] + y[1], (x[1] * x[2] + y[1] * y[2]) / (x[1] + y[1]))
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [merged]
    assert {frozenset(g[0]) for g in groups} == {frozenset(np.flatnonzero(got == j)) for j in range(4)}


def test_planted_clusters_are_found(spark):
    x, label = blobs()
    got = assigned(frame(spark, [*x, np.zeros(32), None, np.ones(5), []]), 5).toPandas()
    assert len(got) == 400 and got.part.nunique() == 5
    assert all(g.part.nunique() == 1 for _, g in got.assign(y=label[got.row_id]).groupby("y"))


def test_names_members_and_descriptions(spark):
    x, label = blobs()
    seats = [int(np.flatnonzero(label == j)[0]) for j in range(5)]
    summary = spark.createDataFrame([(10 + j, seats[j], "x") for j in range(5)], "cluster_id int, typical_row long, part string")
    members = cluster_members(frame(spark, x), summary)
    found = near_members(members).toPandas()
    assert (found.cluster_id == 10 + label[found.embedding_row]).all() and len(found) > 380
    manifest = spark.createDataFrame([(str(i), i) for i in range(400)], "complaint_id string, embedding_row long")
    texts = spark.createDataFrame([(str(i), None if i == 3 else f"common words about topic{'abcde'[label[i]]} matters") for i in range(400)], "complaint_id string, narrative string")
    out = described(members, manifest, texts).toPandas()
    assert out.fit_rows.sum() == 400 and all(len(t) == 5 for t in out.typical_rows)
    assert all(f"topic{'abcde'[c - 10]}" in t for c, t in zip(out.cluster_id, out.representative_terms))


def test_degenerate_tables(spark):
    assert assigned(frame(spark, []), 3).count() == 0
    assert assigned(frame(spark, [np.zeros(4), None]), 3).count() == 0
    same = assigned(frame(spark, [np.ones(4)] * 6), 3).toPandas()
    assert len(same) == 6 and same.part.nunique() == 1
