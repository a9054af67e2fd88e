import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import special as X
from tidemark.functions.text import normalised, normalised_udf
from tidemark.operators import contract as C
from tidemark.operators import lookups as L
from tidemark.operators import metrics as M
from tidemark.operators import profile as P
from tidemark.operators import series as S
from tidemark.operators.predictive import daily_predictive, weekly_predictive
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.rolling import surges, trailing
from tidemark.operators.tree_agg import State, heavy_keys, key_profile, tree_aggregate

DAY = dt.date(2025, 1, 6)


@pytest.mark.parametrize(("chunk_rows", "fan_in"), [(1, 2), (7, 3), (65_536, 16)])
def test_tree_gives_what_one_group_by_gives(spark, chunk_rows, fan_in):
    rng = random.Random(0)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(100), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, n_rows string").repartition(5)
    got = tree_aggregate(df, ["k"], [State("n", F.count(F.lit(1))), State("s", F.sum("v")), State("lo", F.min("v"), "min"), State("hi", F.max("v"), "max")], chunk_rows, fan_in)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_key_profiles_with_nulls_and_empty(spark):
    schema = "company string, product string, narrative string, timely_response string, date_received date, date_sent_to_company date"
    rows = [("a", None, "text", "No", DAY, DAY + dt.timedelta(3))] * 98 + [("rare", "p", None, None, None, None), (None, "p", "", "Yes", DAY, None)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.field_name, r.key_value): r for r in key_profile(df).collect()}
    assert got["company", "a"].n_rows == 98 and got["company", "a"].mean_lag_days == 3 and got["company", None].mean_lag_days is None
    assert got["product", None].n_rows == 98 and got["company", "rare"].first_received is None
    assert {tuple(r) for r in heavy_keys(df).collect()} == {("company", "a"), ("product", "p")}
    assert key_profile(df.limit(0)).count() == 0 and heavy_keys(df.limit(0)).count() == 0


WEEKLY = "score_run long, split string, week date, cluster_id int, complaint_count long, loaded_at timestamp, n long"


def test_trailing_over_gaps_corrections_and_nulls(spark):
    at = lambda h: dt.datetime(2025, 5, 1, h)
    week = lambda i: DAY + dt.timedelta(7 * i)
    rows = [(1, "s", week(0), 2, 4, at(1), 9), (1, "s", week(0), 2, 6, at(2), 9), (1, "s", week(0), 2, 6, at(2), 9), (1, "s", week(3), 2, None, at(1), 9), (1, "s", week(5), 3, 10, None, 9), (None, "s", week(1), 2, 5, at(1), 9), (1, "s", None, 2, 5, at(1), 9), (1, "s", week(1), None, 5, at(1), 9)]
    got = {(r.cluster_id, r.period_no): r for r in trailing(spark.createDataFrame(rows, WEEKLY), "week", 2, 4).collect()}
    assert len(got) == 18 and [got[2, i].long_total for i in range(1, 7)] == [6, 6, 6, 6, 0, 0]
    assert got[3, 6].short_total == 10 and got[-1, 6].long_total == 10 and got[-1, 4].long_total == 6 and got[2, 2].long_mean == 3.0
    assert [tuple(r) for r in surges(spark.createDataFrame(rows, WEEKLY), "week", 2, 4, least=10).orderBy("cluster_id").collect()] == [("week", 1, -1, "2025-02-10"), ("week", 1, 3, "2025-02-10")]
    assert trailing(spark.createDataFrame([], WEEKLY), "week", 2, 4).count() == 0


def panel(spark, table):
    return spark.createDataFrame([(1, DAY + dt.timedelta(7 * i), c, n) for i, row in enumerate(table) for c, n in enumerate(row)], "score_run long, period date, cluster_id long, n long")


def shares(y, keep, cap=None):
    m, out = np.zeros(len(y[0])), []
    for i, row in enumerate(np.array(y, float)):
        s = (m + 1) / (m.sum() + len(m))
        out.append(s)
        m = keep * m + (row if cap is None or i == 0 else np.minimum(row, cap * row.sum() * s))
    return out


@pytest.mark.parametrize("cap", [None, 1.5])
def test_memory_uses_the_past_only(spark, cap):
    y = [[5, 1, 0], [0, 30, 2], [4, 4, 4], [9, 0, 1]]
    got = {(r.period, r.cluster_id): r.memory_share for r in S.decayed_shares(panel(spark, y), 0.8, cap).collect()}
    want = shares(y, 0.8, cap)
    for i in range(4):
        for c in range(3):
            v = got[DAY + dt.timedelta(7 * i), c]
            assert v is None if i == 0 else abs(v - want[i][c]) < 1e-12


def test_cusum_restarts_after_an_alarm(spark):
    z = [1, 1, 1, 1, -2, 3]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(z)] + [(2, 0, None), (2, 1, 5.0)], "k int, i int, z double")
    got = S.upper_cusum(df, ["k"], "i", "z", 0.5, 1.2).orderBy("k", "i").collect()
    assert [r.cusum for r in got] == [0.5, 1.0, 1.5, 0.5, 0.0, 2.5, 0.0, 4.5]
    assert [r.i + 1 for r in got if r.k == 1 and r.alarm] == [3, 6]


def test_injection_of_nothing_changes_nothing(spark):
    df = panel(spark, [[3, 4], [5, 6]])
    none = spark.createDataFrame([("none", "step", 0.0, 0, 0), ("burst", "burst", 3.0, 1, 0)], "name string, kind string, size double, span int, target long")
    got = {(r.name, r.period, r.cluster_id): (r.n, r.total) for r in S.injected(df, F.lit(DAY).cast("date"), none).collect()}
    assert got["none", DAY, 0] == (3, 7) and got["burst", DAY, 0] == (9, 13) and got["burst", DAY + dt.timedelta(7), 0] == (5, 11)


def test_special_functions():
    assert np.allclose(X.lgamma([0.1, 1, 4.5, 100.0, 1e6]), [2.252712651734206, 0, 2.453736570842442, 359.1342053695754, 12815504.569147611], rtol=1e-12)
    assert np.allclose(X.betainc([2, 0.5, 30], [3, 0.5, 4], [0.4, 0.3, 0.9]), [0.5248, 0.3690101195655453, X.betainc(30, 4, 0.9)])
    alpha, mu = 5.0, 50.0
    pmf = [np.exp(X.lgamma(i + alpha) - X.lgamma(alpha) - X.lgamma(i + 1) + alpha * np.log(alpha / (alpha + mu)) + i * np.log(mu / (alpha + mu))) for i in range(400)]
    assert np.allclose(X.nb_cdf(np.arange(400), alpha, mu), np.cumsum(pmf), atol=1e-10) and X.nb_cdf(-1, alpha, mu) == 0
    assert X.nb_quantile(0.9, np.array([alpha]), np.array([mu]))[0] == np.searchsorted(np.cumsum(pmf), 0.9)
    rng = np.random.default_rng(1)
    y = rng.poisson(rng.gamma(alpha, mu / alpha, 4000))
    mid = (X.nb_cdf(y - 1, alpha, mu) + X.nb_cdf(y, alpha, mu)) / 2
    z = X.normal_quantile(np.clip(mid, 1e-6, 1 - 1e-6))
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


def test_predictive_tables(spark):
    rng = np.random.default_rng(0)
    df = panel(spark, [[int(v) for v in rng.poisson([60, 30, 10])] for _ in range(12)])
    got = weekly_predictive(df, 8.0).toPandas()
    assert len(got) == 36 and got[got.z.isna()].period.nunique() == 1
    sums = got.dropna().groupby("period").agg(e=("expected", "sum"), n=("n", "sum"))
    assert np.allclose(sums.e, sums.n) and (got.dropna().p10 <= got.dropna().p90).all() and not got[got.z.isna()].alarm.any()
    day = daily_predictive(df, 8.0, 0.1, F.lit(1.0), width=3).toPandas().dropna(subset=["expected"])
    assert day.upper_tail.between(0, 1).all() and (day.impossible <= day.upper_tail + 1e-12).all()
    assert day[day.n == 0].upper_tail.eq(1).all()


def test_normalised_text(spark):
    assert normalised("  ＡBC\tXX \nStraße  ") == "abc <redacted> strasse" and normalised("Exxon XX") == "exxon <redacted>"
    assert normalised(normalised("A  XXX b")) == normalised("A  XXX b")
    df = spark.createDataFrame([("  ＡB",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(normalised_udf("t")).collect()] == ["ab", None, ""]


def test_contracts(spark):
    df = spark.createDataFrame([("1", "2024-01-05"), ("1", "05/01/2024"), (None, None), ("2", "2024-02-30")], "id string, d string")
    assert [r[0] for r in df.select(C.strict_date(F.col("d"))).collect()] == [dt.date(2024, 1, 5), None, None, None]
    assert df.agg(C.unparsable(F.col("d"))).first()[0] == 2
    with pytest.raises(C.ContractError, match="missing"):
        C.require_columns(df, ["id", "x"])
    with pytest.raises(C.ContractError):
        C.require_none(C.input_violations(df, ["id"], "id"))
    with pytest.raises(C.ContractError):
        C.contiguous([("a", "2024", "2025"), ("b", "2026", "2027")])
    starts = [("train", "2023-01-01"), ("later", "2025-01-01")]
    days = spark.createDataFrame([(dt.date(2022, 12, 31),), (dt.date(2023, 1, 1),), (dt.date(2025, 1, 1),), (None,)], "d date")
    assert [r[0] for r in days.select(C.label_by_start(F.col("d"), starts, "before")).collect()] == ["before", "train", "later", None]
    assert [r[0] for r in spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string").select(C.three_valued(F.col("v"), {"a": True, "b": False})).collect()] == [True, False, None, None]


def test_lookups_keep_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    mapping = spark.createDataFrame([("a", "A"), ("a", "A"), ("z", "Z")], "raw string, canonical string")
    got = L.with_category(df, "k", mapping, "c", "?", "known").collect()
    assert sorted((r.k or "", r.c, r.known) for r in got) == [("", "?", False), ("a", "A", True), ("a", "A", True), ("b", "?", False)]
    ref = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted((r.k or "", r.hit) for r in L.membership(df, "k", ref, "hit").collect()) == [("", False), ("a", True), ("a", True), ("b", False)]
    old, new = spark.createDataFrame([(1, 5), (2, 6)], "p int, n int"), spark.createDataFrame([(2, 9)], "p int, n int")
    assert sorted(map(tuple, L.replaced(old, new, "p").collect())) == [(1, 5, "frozen"), (2, 9, "new")]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("c", "z", 1), (None, "a", 1), ("a", None, 1)], "t string, p string, w int")
    got = {r.label: r for r in M.class_scores(df, "t", "p").collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].f1 == 0 and got["a"].recall == pytest.approx(1 / 3, abs=1e-6) and got["b"].precision == 0.5
    assert M.macro_f1(M.class_scores(df, "t", "p", "w")).first().macro_f1 == M.macro_f1(M.class_scores(df, "t", "p")).first().macro_f1
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False), (None, True)], "s double, y boolean").withColumn("g", F.lit(1))
    assert M.average_precision(s, "s", "y", ["g"]).first().average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-6)
    assert M.best_threshold(s, "s", "y", ["g"]).first().threshold == 0.8
    one = spark.range(1).select(M.weighted_interval_score(F.lit(5.0), F.lit(5.0), {0.2: (F.lit(5.0), F.lit(5.0))}).alias("w"), M.interval_score(F.lit(7.0), F.lit(1.0), F.lit(5.0), 0.5).alias("i")).first()
    assert one.w == 0 and one.i == 4 + 4 * 2
    same = spark.createDataFrame([(i % 3, (i % 3) + 10) for i in range(12)], "a int, b int")
    assert M.rand_index(same, "a", "b").first().adjusted_rand == 1.0 and M.mutual_information(same, "a", "b").first().nmi == 1.0


def test_profile_pieces(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("y", None), (None, "a"), ("x", "b")], "g string, v string")
    assert sorted((r.g or "", r.v, r.n) for r in P.dominant(df, ["g"], "v").collect()) == [("", "a", 1), ("x", "a", 2)]
    r = P.repetition(df, "v").first()
    assert (r.n_groups, r.n_repeated, r.rows_repeated, r.largest) == (2, 2, 5, 3)
    assert [x[0] for x in spark.createDataFrame([("a  b\nc" * 20,), ("",), (None,)], "t string").select(P.snippet(F.col("t"), 8)).collect()] == ["a b ca …", "", None]
    w = Window.orderBy("i")
    z = spark.createDataFrame([(i, 3.0) for i in range(4)], "i int, z double").select(S.scan_statistic(F.col("z"), w).alias("s")).collect()
    assert [x.s if x.s is None else round(x.s, 6) for x in z] == [None, None, 5.196152, 5.196152]


def test_exact_quantiles_whatever_the_sketch(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 7 == 0 else f"g{i % 3}", None if i % 11 == 0 else float(rng.integers(0, 50)) if i % 2 else float(rng.normal())) for i in range(2000)] + [("one", 1.5), ("none", None)]
    df, ps = spark.createDataFrame(rows, "k string, v double"), [0.025, 0.1, 0.5, 0.975, 0.0, 1.0]
    for accuracy in (100, 100_000):
        got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", ps, accuracy).collect()}
        for k in {r[0] for r in rows}:
            v = [x for key, x in rows if key == k and x is not None]
            assert (got[k] is None and not v) or np.allclose(got[k], np.quantile(v, ps))
    assert np.allclose(exact_quantiles(df, [], "v", ps).first().q, np.quantile([x for _, x in rows if x is not None], ps))
    assert exact_quantiles(df.limit(0), ["k"], "v", ps).count() == 0
