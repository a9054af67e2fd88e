"""Queries over weekly and daily panels and event counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.rolling import densified, held_rows
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def weekly(spark, root):
    return densified(held_rows(table(spark, root, "weekly_panel"), "week"), 7).where("NOT is_sum").drop("is_sum")


def daily(spark, root):
    return densified(held_rows(table(spark, root, "daily_panel"), "received_day"), 1).where("NOT is_sum").drop("is_sum")


def _dense(tab, col, step, name):
    return f"""{name}_held AS (SELECT score_run, CAST(cluster_id AS BIGINT) AS cluster_id, {col} AS period, COALESCE(complaint_count, 0) AS n FROM {tab}
  QUALIFY row_number() OVER (PARTITION BY score_run, cluster_id, {col} ORDER BY loaded_at DESC, COALESCE(complaint_count, 0) DESC) = 1),
{name}_grid AS (SELECT s.score_run, s.cluster_id, CAST(g.p AS DATE) AS period FROM (SELECT DISTINCT score_run, cluster_id FROM {name}_held) s
  JOIN (SELECT score_run, min(period) AS a, max(period) AS b FROM {name}_held GROUP BY 1) x USING (score_run), LATERAL (SELECT unnest(generate_series(x.a::TIMESTAMP, x.b::TIMESTAMP, INTERVAL {step} DAY)) AS p) g),
{name} AS (SELECT score_run, cluster_id, period, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM {name}_grid LEFT JOIN {name}_held USING (score_run, cluster_id, period))"""


WK = "WITH RECURSIVE " + _dense("weekly_panel", "week", 7, "wk")
DY = "WITH RECURSIVE " + _dense("daily_panel", "received_day", 1, "dy")


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS n_distinct, count(*) FILTER (WHERE value > 20) AS n_novel FROM events GROUP BY 1, 2")
def ag01_weekly_counts(spark, root):
    return S.period_counts(table(spark, root, "events"), [F.date_trunc("week", "ts").cast("date").alias("week"), "event_type"], "user_id", F.col("value") > 20)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_distinct, count(*) FILTER (WHERE value > 20) AS n_novel FROM events GROUP BY 1, 2")
def ag02_daily_counts(spark, root):
    return S.period_counts(table(spark, root, "events"), [F.to_date("ts").alias("day"), "event_type"], "user_id", F.col("value") > 20)


@query("SELECT score_run, cluster_id, week, CAST(sum(n) AS BIGINT) AS n FROM (SELECT score_run, split, cluster_id, week, max(COALESCE(complaint_count, 0)) AS n FROM weekly_panel GROUP BY ALL) WHERE week + 6 <= (SELECT max(received_day) FROM daily_panel) GROUP BY ALL")
def ag03_weeks_across_splits(spark, root):
    rows = table(spark, root, "weekly_panel").groupBy("score_run", "split", "cluster_id", "week").agg(F.max(F.coalesce("complaint_count", F.lit(0))).alias("n"))
    last = table(spark, root, "daily_panel").agg(F.max("received_day").alias("last"))  # one row
    return rows.join(F.broadcast(last)).where(F.date_add("week", 6) <= F.col("last")).groupBy("score_run", "cluster_id", "week").agg(F.sum("n").alias("n"))


@query(DY + " SELECT score_run, cluster_id, date_trunc('week', period)::DATE AS week, CAST(sum(n) AS BIGINT) AS n FROM dy GROUP BY ALL HAVING count(*) = 7")
def ag04_full_weeks_of_days(spark, root):
    return daily(spark, root).groupBy("score_run", "cluster_id", F.date_trunc("week", "period").cast("date").alias("week")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days")).where("days = 7").drop("days")


@query("""WITH c AS (SELECT date_received AS day, product_canonical, count(*) AS n, count(*) FILTER (WHERE NOT known_issue) AS n_novel FROM prepared WHERE product_canonical IS NOT NULL AND date_received IS NOT NULL GROUP BY 1, 2),
g AS (SELECT e.product_canonical, CAST(d.day AS DATE) AS day FROM (SELECT DISTINCT product_canonical FROM c) e, (SELECT unnest(generate_series((SELECT min(day) FROM c)::TIMESTAMP, (SELECT max(day) FROM c)::TIMESTAMP, INTERVAL 1 DAY)) AS day) d)
SELECT product_canonical, day, COALESCE(n, 0) AS n, COALESCE(n_novel, 0) AS n_novel FROM g LEFT JOIN c USING (product_canonical, day)""")
def jn09_complete_grid(spark, root):
    rows = table(spark, root, "prepared").where("product_canonical IS NOT NULL AND date_received IS NOT NULL")
    counts = rows.groupBy(F.col("date_received").alias("day"), "product_canonical").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known_issue")).alias("n_novel"))
    return S.on_grid(counts, "day", "product_canonical", 1, ["n", "n_novel"])


@query(WK + " SELECT score_run, cluster_id, period, n, CAST(sum(n) OVER w AS BIGINT) AS total, round(CASE WHEN sum(n) OVER w <> 0 THEN n / sum(n) OVER w ELSE 0 END, 6) AS share FROM wk WINDOW w AS (PARTITION BY score_run, period)")
def wn01_shares(spark, root):
    return S.with_shares(weekly(spark, root), ["score_run", "period"]).withColumn("share", F.round("share", 6))


def _lagged_sql(cte, name, width, short):
    return f"""{cte}, own AS (SELECT *, CASE WHEN count(*) OVER w >= {1 if short else width} THEN sum(n) OVER w END AS own FROM {name} WINDOW w AS (PARTITION BY score_run, cluster_id ORDER BY period ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING))
SELECT score_run, cluster_id, period, n, round((own + 1) / (sum(own) OVER p + count(*) OVER p), 6) AS recent_share FROM own WINDOW p AS (PARTITION BY score_run, period)"""


@query(_lagged_sql(WK, "wk", 4, False))
def wn02_rolling_share_4(spark, root):
    return S.lagged_shares(weekly(spark, root), 4).withColumn("recent_share", F.round("recent_share", 6))


@query(_lagged_sql(WK, "wk", 13, False))
def wn02_rolling_share_13(spark, root):
    return S.lagged_shares(weekly(spark, root), 13).withColumn("recent_share", F.round("recent_share", 6))


@query(_lagged_sql(DY, "dy", 7, True))
def wn03_rolling_share_7(spark, root):
    return S.lagged_shares(daily(spark, root), 7, short=True).withColumn("recent_share", F.round("recent_share", 6))


@query(WK + """, f AS (SELECT score_run, cluster_id, sum(CASE WHEN period < DATE '2025-07-01' THEN n ELSE 0 END) AS n FROM wk GROUP BY ALL)
SELECT score_run, cluster_id, round((n + 1) / (sum(n) OVER w + count(*) OVER w), 6) AS share FROM f WINDOW w AS (PARTITION BY score_run)""")
def wn04_static_share(spark, root):
    return S.static_shares(weekly(spark, root), F.col("period") < F.lit("2025-07-01").cast("date")).withColumn("share", F.round("share", 6))


_Z_SQL = """, own AS (SELECT *, CASE WHEN count(*) OVER w >= 4 THEN sum(n) OVER w END AS own FROM wk WINDOW w AS (PARTITION BY score_run, cluster_id ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, (own + 1) / (sum(own) OVER p + count(*) OVER p) * sum(n) OVER p AS expected FROM own WINDOW p AS (PARTITION BY score_run, period)),
scored AS (SELECT score_run, cluster_id, period, n, expected, CASE WHEN expected > 0 THEN (n - expected) / sqrt(expected) END AS z FROM e)"""


def _scored(spark, root):
    rows = S.lagged_shares(weekly(spark, root), 4)
    rows = rows.withColumn("expected", F.col("recent_share") * F.sum("n").over(Window.partitionBy("score_run", "period")))
    return rows.withColumn("z", F.when(F.col("expected") > 0, (F.col("n") - F.col("expected")) / F.sqrt("expected"))).drop("recent_share")


@query(WK + _Z_SQL + " SELECT score_run, cluster_id, period, round(CASE WHEN count(z) OVER w = 3 THEN sum(z) OVER w / sqrt(3.0) END, 6) AS scan FROM scored WINDOW w AS (PARTITION BY score_run, cluster_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def wn05_scan_statistic(spark, root):
    w = Window.partitionBy("score_run", "cluster_id").orderBy("period")
    return _scored(spark, root).select("score_run", "cluster_id", "period", F.round(S.scan_statistic(F.col("z"), w), 6).alias("scan"))


@query(DY + " SELECT score_run, cluster_id, period, n FROM dy JOIN (SELECT score_run, min(period) AS a FROM dy GROUP BY 1) USING (score_run) WHERE period - a >= 14")
def wn06_warm_rows(spark, root):
    d = daily(spark, root)
    return d.withColumn("_a", F.min("period").over(Window.partitionBy("score_run"))).where(F.datediff("period", "_a") >= 14).drop("_a")


@query(WK + " SELECT score_run, cluster_id, period, round((period - (SELECT min(period) + CAST((max(period) - min(period)) // 2 AS INTEGER) FROM wk WHERE period < DATE '2025-07-01')) / 365.25, 6) AS years FROM wk")
def wn07_centred_time(spark, root):
    wk = weekly(spark, root)
    fit = wk.where(F.col("period") < F.lit("2025-07-01").cast("date")).agg(F.min("period").alias("a"), F.max("period").alias("b"))  # one row
    middle = fit.select(F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int")).alias("middle"))
    return wk.join(F.broadcast(middle)).select("score_run", "cluster_id", "period", F.round(F.datediff("period", "middle") / 365.25, 6).alias("years"))


@query("SELECT product, n, round(CAST(sum(n) OVER (ORDER BY n DESC, product NULLS FIRST) AS DOUBLE) / sum(n) OVER (), 6) AS cumulative FROM (SELECT product, count(*) AS n FROM prepared GROUP BY 1)")
def wn08_cumulative_share(spark, root):
    # Windows without a partition: over one row per product, a value set that stays as small as the taxonomy.
    counts = table(spark, root, "prepared").groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), F.asc_nulls_first("product"))
    return counts.select("product", "n", F.round(F.sum("n").over(order) / F.sum("n").over(Window.partitionBy()), 6).alias("cumulative"))


@query("SELECT period, min(date_trunc('week', date_received))::DATE AS first_week, max(date_trunc('week', date_received))::DATE AS last_week, count(DISTINCT date_trunc('week', date_received)) AS n_weeks FROM prepared GROUP BY period")
def wn09_split_weeks(spark, root):
    week = F.date_trunc("week", "date_received").cast("date")
    return table(spark, root, "prepared").groupBy("period").agg(F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.count_distinct(week).alias("n_weeks"))


@query("""SELECT DISTINCT score_run, split, week, week >= s.a AND week + 7 <= s.b AS complete_in_split, week + 6 <= DATE '2026-01-31' AS complete_at_end FROM weekly_panel JOIN (SELECT period AS p, min(date_received) AS a, max(date_received) + 1 AS b FROM prepared GROUP BY 1) s ON starts_with(s.p, split)""")
def wn10_complete_weeks(spark, root):
    ranges = table(spark, root, "prepared").groupBy("period").agg(F.min("date_received").alias("a"), F.date_add(F.max("date_received"), 1).alias("b"))
    ranges = ranges.select(F.split_part("period", F.lit("_"), F.lit(1)).alias("split"), "a", "b")
    rows = table(spark, root, "weekly_panel").select("score_run", "split", "week").distinct().join(ranges, "split")
    return rows.select("score_run", "split", "week", ((F.col("week") >= F.col("a")) & (F.date_add("week", 7) <= F.col("b"))).alias("complete_in_split"), (F.date_add("week", 6) <= F.lit("2026-01-31").cast("date")).alias("complete_at_end"))


@query(DY.replace("WITH RECURSIVE", "WITH") + " SELECT score_run, cluster_id, period, round(COALESCE(m.v, 0), 6) AS memory_sum FROM dy LEFT JOIN LATERAL (SELECT sum(pow(0.9, date_diff('day', p.period, dy.period) - 1) * p.n) AS v FROM dy p WHERE p.score_run = dy.score_run AND p.cluster_id = dy.cluster_id AND p.period < dy.period) m ON TRUE")
def st01_memory_sums(spark, root):
    d = daily(spark, root)
    a, b = d.alias("a"), d.alias("b")
    later = (F.col("a.score_run") == F.col("b.score_run")) & (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("b.period") < F.col("a.period"))
    term = F.pow(F.lit(0.9), F.datediff("a.period", "b.period") - 1) * F.col("b.n")
    return a.join(b, later, "left").groupBy("a.score_run", "a.cluster_id", "a.period").agg(F.round(F.coalesce(F.sum(term), F.lit(0.0)), 6).alias("memory_sum"))


@query(WK + """, k AS (SELECT score_run, cluster_id, period, n, row_number() OVER (PARTITION BY score_run, cluster_id ORDER BY period) AS i FROM wk),
m AS (SELECT score_run, cluster_id, period, n, i, CAST(0 AS DOUBLE) AS m FROM k WHERE i = 1 UNION ALL SELECT k.score_run, k.cluster_id, k.period, k.n, k.i, 0.95 * m.m + m.n FROM k JOIN m ON k.score_run = m.score_run AND k.cluster_id = m.cluster_id AND k.i = m.i + 1)
SELECT score_run, cluster_id, period, n, CASE WHEN i > 1 THEN round((m + 1) / (sum(m) OVER p + count(*) OVER p), 6) END AS memory_share FROM m WINDOW p AS (PARTITION BY score_run, period)""")
def st01_decayed_share(spark, root):
    return S.decayed_shares(weekly(spark, root), 0.95).withColumn("memory_share", F.round("memory_share", 6))


@query(None)
def st02_capped_share(spark, root):
    return S.decayed_shares(weekly(spark, root), 0.95, cap=2.0).withColumn("memory_share", F.round("memory_share", 6))


_CUSUM_SQL = WK + _Z_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY score_run, cluster_id ORDER BY period) AS i FROM scored),
c AS (SELECT score_run, cluster_id, period, i, greatest(0, COALESCE(z, 0) - 0.5) AS cusum FROM o WHERE i = 1 UNION ALL
  SELECT o.score_run, o.cluster_id, o.period, o.i, greatest(0, (CASE WHEN c.cusum > 3.0 THEN 0 ELSE c.cusum END) + COALESCE(o.z, 0) - 0.5) FROM o JOIN c ON o.score_run = c.score_run AND o.cluster_id = c.cluster_id AND o.i = c.i + 1)
"""


def _cusum(spark, root):
    return S.upper_cusum(_scored(spark, root), ["score_run", "cluster_id"], "period", "z", 0.5, 3.0)


@query(_CUSUM_SQL + "SELECT score_run, cluster_id, period, round(cusum, 6) AS cusum, cusum > 3.0 AS alarm FROM c")
def st03_upper_cusum(spark, root):
    return _cusum(spark, root).withColumn("cusum", F.round("cusum", 6))


@query(_CUSUM_SQL + "SELECT score_run, cluster_id, min(i) FILTER (WHERE cusum > 3.0) AS first_alarm FROM c GROUP BY ALL")
def tk15_first_alarm(spark, root):
    w = Window.partitionBy("score_run", "cluster_id").orderBy("period")
    rows = _cusum(spark, root).withColumn("i", F.row_number().over(w).cast("long"))
    return rows.groupBy("score_run", "cluster_id").agg(F.min(F.when(F.col("alarm"), F.col("i"))).alias("first_alarm"))


@query(_CUSUM_SQL + "SELECT score_run, count(DISTINCT period) AS n_periods, count(*) FILTER (WHERE cusum > 3.0) AS n_alarms, round(count(*) FILTER (WHERE cusum > 3.0) / CAST(count(DISTINCT period) AS DOUBLE) * (365.25 / 7 / 12), 6) AS alarms_per_month FROM c GROUP BY ALL")
def ag16_alarm_summary(spark, root):
    n = F.count_if("alarm")
    return _cusum(spark, root).groupBy("score_run").agg(F.count_distinct("period").alias("n_periods"), n.alias("n_alarms"), F.round(n / F.count_distinct("period") * (365.25 / 7 / 12), 6).alias("alarms_per_month"))


@query(_CUSUM_SQL + "SELECT score_run, cluster_id, string_agg(strftime(period, '%Y-%m-%d'), ',' ORDER BY period) AS alarm_weeks FROM c WHERE cusum > 3.0 GROUP BY ALL")
def ag18_alarm_weeks(spark, root):
    return _cusum(spark, root).where("alarm").groupBy("score_run", "cluster_id").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("period", "yyyy-MM-dd"))), ",").alias("alarm_weeks"))


_SCENARIOS = [("growth", "growth", 0.2, 0), ("step", "step", 0.5, 0), ("burst", "burst", 3.0, 2)]


@query(WK + f""", s AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in _SCENARIOS)}) v(name, kind, size, span)),
r AS (SELECT score_run, cluster_id, period, name, CASE WHEN cluster_id = 3 AND period >= DATE '2025-09-01' THEN CAST(round_even(n * CASE kind WHEN 'growth' THEN pow(1 + size, date_diff('day', DATE '2025-09-01', period) / 7.0 + 1) WHEN 'step' THEN 1 + size
  ELSE CASE WHEN date_diff('day', DATE '2025-09-01', period) / 7.0 < span THEN size ELSE 1 END END, 0) AS BIGINT) ELSE n END AS n FROM wk, s)
SELECT score_run, cluster_id, period, name, n, CAST(sum(n) OVER (PARTITION BY score_run, name, period) AS BIGINT) AS total FROM r""")
def st09_injected(spark, root):
    scenarios = spark.createDataFrame([(*s, 3) for s in _SCENARIOS], "name string, kind string, size double, span int, target long")
    return S.injected(weekly(spark, root), F.lit("2025-09-01").cast("date"), scenarios).select("score_run", "cluster_id", "period", "name", "n", "total")


@query(DY + """, e AS (SELECT *, (0.1 + 0.01 * cluster_id) * exp(0.05 * (isodow(period) - 1)) AS raw, sum(n) OVER (PARTITION BY score_run, period) AS total FROM dy)
SELECT score_run, cluster_id, period, round(raw / sum(raw) OVER w * total, 6) AS expected FROM e WINDOW w AS (PARTITION BY score_run, period)""")
def st11_daily_expected(spark, root):
    w = Window.partitionBy("score_run", "period")
    d = daily(spark, root).withColumn("raw", (0.1 + 0.01 * F.col("cluster_id")) * F.exp(0.05 * F.weekday("period"))).withColumn("total", F.sum("n").over(w))
    return d.select("score_run", "cluster_id", "period", F.round(F.col("raw") / F.sum("raw").over(w) * F.col("total"), 6).alias("expected"))


@query(DY + """, e AS (SELECT *, sin(cluster_id) + 0.01 * (period - DATE '2025-01-01') * cos(cluster_id) AS score, sum(n) OVER (PARTITION BY score_run, period) AS total FROM dy)
SELECT score_run, cluster_id, period, round(exp(score) / sum(exp(score)) OVER w * total, 6) AS expected FROM e WINDOW w AS (PARTITION BY score_run, period)""")
def st12_softmax_expected(spark, root):
    d = daily(spark, root).withColumn("total", F.sum("n").over(Window.partitionBy("score_run", "period")))
    d = d.withColumn("score", F.sin("cluster_id") + 0.01 * F.datediff("period", F.lit("2025-01-01").cast("date")) * F.cos("cluster_id"))
    return S.softmax_expected(d, ["score_run", "period"], "score", "total").select("score_run", "cluster_id", "period", F.round("expected", 6).alias("expected"))


@query(WK + " SELECT score_run, period, string_agg(n::VARCHAR, ',' ORDER BY cluster_id) AS counts FROM wk GROUP BY ALL")
def st27_period_matrix(spark, root):
    cells = F.array_sort(F.collect_list(F.struct("cluster_id", "n")))
    return weekly(spark, root).groupBy("score_run", "period").agg(cells.alias("c")).select("score_run", "period", F.array_join(F.transform("c", lambda c: c["n"].cast("string")), ",").alias("counts"))


@query(WK + """, s AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY score_run, period), 0) AS share FROM wk), d AS (SELECT *, share - avg(share) OVER (PARTITION BY score_run, cluster_id) AS d FROM s)
SELECT score_run, period, arg_max(cluster_id, {'a': round(abs(d), 9), 'b': -cluster_id}) AS cluster_id FROM d WHERE d IS NOT NULL GROUP BY ALL""")
def st20_largest_deviation(spark, root):
    s = weekly(spark, root).withColumn("share", F.expr("try_divide(n, sum(n) OVER (PARTITION BY score_run, period))"))
    d = s.withColumn("d", F.col("share") - F.avg("share").over(Window.partitionBy("score_run", "cluster_id"))).where("d IS NOT NULL")
    return d.groupBy("score_run", "period").agg(F.max_by("cluster_id", F.struct(F.round(F.abs("d"), 9), -F.col("cluster_id"))).alias("cluster_id"))
