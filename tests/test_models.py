import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators.features import category_codes, class_terms, tfidf
from tidemark.operators.vectors import assign, centres, margins, nearest, silhouette


def vectors(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = np.eye(6)[label] + 0.1 * rng.normal(size=(n, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    rows = [(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(label, x))]
    return spark.createDataFrame([*rows, (900, 1, None)], "vec_id long, label int, embedding array<float>"), x.astype(float), label


def test_exact_search(spark):
    df, x, _ = vectors(spark)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {i: list(np.lexsort((np.arange(len(x)), -np.round(s[i], 7)))[:4]) for i in range(0, 120, 20)}
    for block in (2, 20_000):
        got = nearest(df, df.where("vec_id % 20 = 0"), 4, block).orderBy("query_id", "place").toPandas()
        assert {i: list(g.vec_id) for i, g in got.groupby("query_id")} == want
    assert nearest(df, df.limit(0), 3).count() == 0 and nearest(df.limit(0), df, 3).count() == 0


def test_centres_margins_silhouette(spark):
    df, x, label = vectors(spark)
    cs = centres(df, "label")
    got = assign(df, cs).toPandas()
    assert (got.part == label[got.vec_id]).all() and len(got) == 120
    c = np.stack([x[label == j].mean(0) for j in range(3)])
    d = np.sort(np.linalg.norm(x[:, None] - c, axis=2), axis=1)
    m = margins(df, cs).toPandas().set_index("vec_id").margin
    assert np.allclose([m[i] for i in range(120)], (d[:, 1] - d[:, 0]) / d[:, 0])
    full = np.linalg.norm(x[:, None] - x, axis=2)
    s = []
    for i in range(120):
        means = [full[i][label == j].sum() / ((label == j).sum() - (j == label[i])) for j in range(3)]
        b = min(v for j, v in enumerate(means) if j != label[i])
        s.append((b - means[label[i]]) / max(b, means[label[i]]))
    sil = {r.label: r.silhouette for r in silhouette(df, "label").collect()}
    assert all(abs(sil[j] - np.mean([v for v, c in zip(s, label) if c == j])) < 1e-6 for j in range(3))


def test_projection_is_centred_and_clusters_are_found(spark):
    df, x, label = vectors(spark)
    got, share = M.projected(df, df, "embedding", 2)
    p = np.array([r.projected for r in got.orderBy("vec_id").collect()])
    assert np.allclose(p.mean(0), 0, atol=1e-6) and share[0] >= share[1] > 0
    parts = M.partitioned(df, "embedding", 3).toPandas()
    assert parts.assign(y=label[parts.vec_id]).groupby("y").part.nunique().eq(1).all()
    assert M.mixture(got, "projected", 3).agg(F.min("confidence")).first()[0] > 0.33


def test_linear_models(spark):
    rows = [(i, "a" if i % 2 else "b", bool(i % 2), f"{'apples and pears' if i % 2 else 'trains and planes'} number {i % 5}") for i in range(60)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id int, y string, t boolean, text string")
    x = M.term_slots(df, "text", 1 << 12)
    got = M.linear_classes(x, x, "y", size=1 << 12).where("y IS NOT NULL").toPandas()
    assert (got.y == got.predicted).all()
    p = M.calibrated(x, x, x, "t", size=1 << 12).where("t IS NOT NULL").toPandas()
    assert p[p.t].probability_true.min() > p[~p.t].probability_true.max()
    assert M.linear_classes(x.limit(0), x, "y", size=1 << 12).where("predicted IS NULL").count() == 61


def test_held_out_accuracy_of_linear_classes(spark):
    rng = np.random.default_rng(4)
    common, own = [f"c{i}" for i in range(200)], {k: [f"{k}{i}" for i in range(40)] for k in "abc"}
    rows = []
    for i in range(900):
        y = "abc"[rng.choice(3, p=[0.6, 0.3, 0.1])]
        words = list(rng.choice(common, 12)) + list(rng.choice(own[y], 4)) + list(rng.choice(own["abc"[rng.integers(3)]], 1))
        rows.append((i, y, " ".join(rng.permutation(words))))
    x = M.term_slots(spark.createDataFrame(rows, "id int, y string, text string"), "text", 1 << 14)
    got = M.linear_classes(x.where("id < 600"), x.where("id >= 600"), "y", size=1 << 14).toPandas()
    assert (got.y == got.predicted).mean() > 0.85


def test_words_of_a_text_are_made_once(spark):
    x = M.term_slots(spark.createDataFrame([(1, "One a two-three", "p"), (2, "", None), (3, None, "p"), (4, "alone", None)], "id int, text string, c string"), "text", 1 << 12, "c")
    assert x._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    terms = {1: ["one", "two", "three", "one two", "two three", "\x00p"], 2: [], 3: ["\x00p"], 4: ["alone"]}
    flat = spark.createDataFrame([(t,) for t in sum(terms.values(), [])], "t string").selectExpr("t", "cast(pmod(xxhash64(t), 4096L) as int) AS s").toPandas()
    slot = dict(zip(flat.t, flat.s))
    assert {r.id: r.slots for r in x.collect()} == {i: [slot[t] for t in ts] for i, ts in terms.items()}


def counting(spark, df):
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), n


def labelled(spark, n):
    rows = [(i, "ab"[i % 2], bool(i % 2), f"{'apples and pears' if i % 2 else 'trains and planes'} number {i % 5}") for i in range(n)]
    return M.term_slots(spark.createDataFrame(rows, "id int, y string, t boolean, text string"), "text", 1 << 12)


def test_fitting_reads_its_rows_at_most_twice(spark):
    fit, n = counting(spark, labelled(spark, 80))
    got = M.linear_classes(fit, labelled(spark, 20), "y", size=1 << 12).toPandas()
    assert (got.y == got.predicted).all() and 80 <= n.value <= 160


def test_calibration_reads_its_rows_once(spark):
    fit, n = counting(spark, labelled(spark, 80))
    calibration, m = counting(spark, labelled(spark, 40))
    p = M.calibrated(fit, calibration, labelled(spark, 20), "t", size=1 << 12).toPandas()
    assert p[p.t].probability_true.min() > p[~p.t].probability_true.max()
    assert 80 <= n.value <= 160 and m.value == 40


def test_parts_and_batches_are_fitted_whole(spark):
    x, size = labelled(spark, 200), 1 << 12
    rows = M.mixed_rows(x, "y", 40)
    assert rows.count() == 200 and 1 < rows.select("part").distinct().count() <= 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cut = M.LinearModel(rows, "y", M.slot_weights(rows, size)).w
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(M.LinearModel(rows, "y", M.slot_weights(rows, size)).w, cut, atol=1e-5)


def test_weights_of_a_step_are_those_of_its_rows():
    rng = np.random.default_rng(1)
    lists = [list(map(int, rng.integers(0, 50, n))) for n in rng.integers(0, 30, 37)]
    idf = rng.random(50).astype(np.float32)
    idf[:5] = 0
    got = np.concatenate([M._matrix(at, *rest) @ np.eye(50)[at] for at, *rest in M._steps(pa.array(lists, pa.list_(pa.int32())), idf)])
    want = np.stack([np.bincount(np.array(x, int), minlength=50) * idf for x in lists])
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), atol=1e-6)


def test_rows_that_are_alike_do_not_overshoot(spark):
    x = M.term_slots(spark.createDataFrame([(i, "a" if i % 10 < 7 else "b", "the same text") for i in range(400)], "id int, y string, text string"), "text", 1 << 10)
    rows = M.mixed_rows(x, "y")
    model = M.LinearModel(rows, "y", M.slot_weights(rows, 1 << 10))
    p = 1 / (1 + np.exp(-np.array(model.scored(x.limit(1)).first().scores)))
    assert np.allclose(p, [0.7, 0.3], atol=0.05)


def test_silhouette_in_blocks_is_the_same(spark):
    df, _, _ = vectors(spark)
    one, cut = ({r.label: r.silhouette for r in silhouette(df, "label", block_rows=b).collect()} for b in (20_000, 50))
    assert one.keys() == cut.keys() and all(abs(one[k] - cut[k]) < 1e-9 for k in one)


def test_text_features(spark):
    df = spark.createDataFrame([("1", "red red blue"), ("2", "blue green"), ("3", ""), ("4", None)], "k string, t string")
    w = tfidf(df, "k", "t", min_df=1).toPandas()
    assert np.allclose(w.assign(s=w.weight**2).groupby("k").s.sum(), 1) and set(w.k) == {"1", "2"} and "red blue" in set(w.term)
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert [r.code for r in category_codes(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), fit, "c").orderBy(F.col("c").asc_nulls_last()).collect()] == [0, 1, None, None]
    terms = spark.createDataFrame([("p", "x")] * 5 + [("p", "y")] + [("q", "y")] * 5, "part string, term string")
    assert {(r.part, r.term) for r in class_terms(terms, "part", "term", 1).collect()} == {("p", "x"), ("q", "y")}
