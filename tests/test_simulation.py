import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators.calendar import due_after, helmert, working_days
from tidemark.operators.series import decayed_shares
from tidemark.operators.simulation import _alarm_rate, alarm_budget, cusum_limit, empirical_limit, nb_draws, rare_mixtures, reweighted_shares

DAY = dt.date(2025, 1, 6)


def panel(spark, table):
    return spark.createDataFrame([(1, DAY + dt.timedelta(7 * i), c, int(n)) for i, row in enumerate(table) for c, n in enumerate(row)], "score_run long, period date, cluster_id long, n long")


def test_infinite_limit_is_the_plain_memory(spark):
    rng = np.random.default_rng(0)
    df = panel(spark, rng.poisson([30, 5, 9], (10, 3)))
    key = lambda r: (r.period, r.cluster_id)
    plain = {key(r): r.memory_share for r in decayed_shares(df, 0.9).collect()}
    got = {key(r): r.memory_share for r in reweighted_shares(df, 0.9, 8.0, float("inf")).collect()}
    assert plain.keys() == got.keys() and all((a is None) == (got[k] is None) and (a is None or abs(a - got[k]) < 1e-12) for k, a in plain.items())


def test_burst_weighs_less(spark):
    df = panel(spark, [[20, 20]] * 5 + [[200, 20]] + [[20, 20]])
    last = lambda limit: [r.memory_share for r in reweighted_shares(df, 0.9, 8.0, limit).where(f"period = DATE '{DAY + dt.timedelta(42)}' AND cluster_id = 0").collect()][0]
    assert last(1.0) < last(float("inf"))


def test_rare_mixture(spark):
    df = panel(spark, [[50, 50], [100, 0], [0, 0]]).withColumn("share", F.lit(0.5))
    got = {r.period: r.p_value for r in rare_mixtures(df, 500.0).collect()}
    assert got[DAY] > 0.3 and got[DAY + dt.timedelta(7)] < 0.01 and got[DAY + dt.timedelta(14)] == 1.0
    assert got == {r.period: r.p_value for r in rare_mixtures(df, 500.0).collect()}


def test_working_days(spark):
    off = [dt.date(2026, 10, 8), dt.date(2026, 12, 8), dt.date(2026, 12, 25)]
    days = working_days(spark, dt.date(2026, 1, 1), dt.date(2026, 12, 31), off)
    df = spark.createDataFrame([(dt.date(2026, 10, 6),), (dt.date(2026, 10, 10),), (dt.date(2027, 1, 5),), (dt.date(2026, 12, 30),), (None,)], "d date")
    due = lambda n: [r.due for r in due_after(df, "d", n, days, "due").orderBy(F.col("d").asc_nulls_last()).collect()]
    assert due(1)[:2] == [dt.date(2026, 10, 7), dt.date(2026, 10, 12)] and due(2)[0] == dt.date(2026, 10, 9) and due(3)[0] == dt.date(2026, 10, 12)
    assert due(15)[0] == dt.date(2026, 10, 28) and due(15)[2:] == [None, None, None]


def test_contrasts(spark):
    rows = helmert(spark, 5).toPandas().pivot(index="cluster", columns="contrast", values="value").to_numpy()
    assert np.allclose(rows.sum(0), 0) and np.allclose((rows**2).sum(1), 1) and np.allclose(rows.T @ rows, np.eye(4) * 5 / 4)


def test_limits_meet_their_targets(spark):
    z = np.random.default_rng(7).standard_normal((300, 520))
    for target in (0.01, 0.002):
        h = cusum_limit(target, paths=300)
        assert 0.9 * target < _alarm_rate(z, 0.5, h) <= target
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, i, float(v)) for k in range(20) for i, v in enumerate(rng.standard_normal(100))], "k int, i int, z double")
    h = empirical_limit(df, ["k"], "i", "z", 0.01)
    rows = np.array([[r.z for r in df.where(f"k = {k}").orderBy("i").collect()] for k in range(3)])
    assert h > 1 and _alarm_rate(rows, 0.5, h) < 0.05 and abs(alarm_budget(1, 7, 40) - 1 / (365.25 / 84 * 40)) < 1e-12


def test_draws(spark):
    df = spark.createDataFrame([(i, 20.0 if i < 50 else None) for i in range(60)], "k int, m double")
    a, b = (nb_draws(df, ["k"], "m", 5.0, 40).toPandas().sort_values(["k", "draw"]) for _ in range(2))
    assert (a.value.to_numpy() == b.value.to_numpy()).all() and len(a) == 2400
    x = a[a.k < 50].value
    assert abs(x.mean() - 20) < 1.5 and abs(x.var() - (20 + 400 / 5)) < 25 and (a[a.k >= 50].value == 0).all()
