import numpy as np
import pytest

from tidemark.llm.neighbours import close_pairs, most_similar, recall

SCHEMA = "embedding_row long, embedding array<float>, shard_no int, encoded_at timestamp, rank string, cell int"


def rows(spark, vectors, extra=()):
    data = [(i, None if v is None else [float(x) for x in v], 0, None, "clash", 1) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(data, SCHEMA)


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 24))
    return (centres[rng.integers(0, 6, 600)] + 0.6 * rng.normal(size=(600, 24))).astype(np.float32)


def test_recall_against_brute_force(spark, clustered):
    top, _ = brute(clustered, 5)
    got = most_similar(rows(spark, clustered), parts=12, words=32).toPandas()
    assert got.groupby("row_id").size().eq(5).all() and got.row_id.nunique() == 600
    hit = sum(len(set(g.other_id) & set(top[i])) for i, g in got.groupby("row_id"))
    assert hit / (5 * 600) >= 0.95


def test_parts_of_lists_keep_the_recall_and_the_query_that_measures_it(spark, clustered):
    v = rows(spark, clustered)
    for how in ({"part_rows": 16, "probes": 6, "lists": 4}, {}):
        got = most_similar(v, parts=12, words=32, **how)
        top, _ = brute(clustered, 5)
        hit = sum(len(set(g.other_id) & set(top[i])) for i, g in got.toPandas().groupby("row_id")) / 3000
        measured = recall(got, v).first()
        assert hit >= 0.9 and measured.n_queries == 600 and abs(measured.recall - hit) < 1e-3


def test_grid_of_blocks_gives_the_same_as_one_cell(spark, clustered):
    one = most_similar(rows(spark, clustered), lists=2, probes=2, margin=9, rerank=600).toPandas()
    cut = most_similar(rows(spark, clustered), lists=2, probes=2, margin=9, rerank=600, block_rows=100).toPandas()
    top, _ = brute(clustered, 5)
    for got in (one, cut):
        assert all(set(g.other_id) == set(top[i]) for i, g in got.groupby("row_id"))


def test_unusable_repeated_and_copied_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = [*base, np.zeros(8), None, [float("nan")] * 8]
    copies = [(100 + i, [float(x) for x in base[0]], 0, None, "clash", 1) for i in range(9)]  # exact copies of row 0
    again = [(3, [float(x) for x in base[3]], 0, None, "clash", 1), (None, [1.0] * 8, 0, None, "clash", 1), (77, [1.0] * 5, 0, None, "clash", 1), (78, [], 0, None, "clash", 1), (79, [1.0] * 7 + [None], 0, None, "clash", 1)]
    got = most_similar(rows(spark, vectors, copies + again)).toPandas()
    assert set(got.row_id) == set(range(40)) | set(range(100, 109))
    assert got.groupby("row_id").size().max() == 5 and not got.duplicated(["row_id", "other_id"]).any()
    mine = got[got.row_id == 104]
    assert list(mine.other_id) == [0, 100, 101, 102, 103] and (mine.similarity > 0.999999).all()
    assert list(got[got.row_id == 0].other_id) == [100, 101, 102, 103, 104]
    pairs = close_pairs(most_similar(rows(spark, vectors, copies + again))).toPandas()
    assert (pairs.row_a < pairs.row_b).all() and not pairs.duplicated().any() and (0, 108) in set(pairs.itertuples(index=False, name=None))


def test_an_infinite_vector_costs_the_others_nothing(spark, clustered):
    bad = [(1000, [float("inf")] + [1.0] * 23, 0, None, "clash", 1), (1001, [float("-inf")] + [1.0] * 23, 0, None, "clash", 1)]
    plain, got = (most_similar(rows(spark, clustered, x), parts=12, words=32).toPandas() for x in ((), bad))
    order = ["row_id", "rank"]
    assert got.sort_values(order).reset_index(drop=True).equals(plain.sort_values(order).reset_index(drop=True))


def test_reached_from_and_empty(spark):
    v = rows(spark, np.eye(4, dtype=np.float32) + 0.1)
    manifest = spark.createDataFrame([(0,), (2,), (2,), (None,)], "embedding_row long")
    assert {(r.row_id, r.other_id) for r in most_similar(v, manifest).collect()} == {(0, 2), (2, 0)}
    assert most_similar(v.limit(0)).count() == 0
    assert most_similar(v.limit(1)).count() == 0
