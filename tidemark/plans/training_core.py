"""Queries of the general problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.rolling import surges, trailing
from tidemark.operators.tree_agg import heavy_keys, key_profile
from tidemark.session import table

WEEK, DAY = (4, 13), (7, 30)


def p2_key_profile(spark: SparkSession, root: str) -> DataFrame:
    return key_profile(table(spark, root, "prepared"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return heavy_keys(table(spark, root, "prepared"))


def p3_weekly_trailing(spark: SparkSession, root: str) -> DataFrame:
    return trailing(table(spark, root, "weekly_panel"), "week", *WEEK)


def p3_daily_trailing(spark: SparkSession, root: str) -> DataFrame:
    return trailing(table(spark, root, "daily_panel"), "day", *DAY)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return surges(table(spark, root, "weekly_panel"), "week", *WEEK).unionByName(surges(table(spark, root, "daily_panel"), "day", *DAY))


QUERIES = {f.__name__: f for f in (p2_key_profile, p2_found, p3_weekly_trailing, p3_daily_trailing, p3_found)}


def _trailing_sql(grain: str, short: int, long: int) -> str:
    tab, period, step = ("weekly_panel", "week", 7) if grain == "week" else ("daily_panel", "received_day", 1)
    return f"""
WITH held AS (
  SELECT score_run, CAST(cluster_id AS BIGINT) AS cluster_id, {period} AS period, COALESCE(complaint_count, 0) AS n FROM {tab}
  WHERE score_run IS NOT NULL AND cluster_id IS NOT NULL AND {period} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY score_run, cluster_id, {period} ORDER BY loaded_at DESC NULLS LAST, COALESCE(complaint_count, 0) DESC) = 1),
everything AS (SELECT * FROM held UNION ALL SELECT score_run, -1, period, sum(n) FROM held GROUP BY score_run, period),
span AS (SELECT score_run, min(period) AS a, max(period) AS b FROM held GROUP BY score_run),
grid AS (
  SELECT s.score_run, s.cluster_id, CAST(g.p AS DATE) AS period
  FROM (SELECT DISTINCT score_run, cluster_id FROM everything) s JOIN span USING (score_run),
       LATERAL (SELECT unnest(generate_series(span.a::TIMESTAMP, span.b::TIMESTAMP, INTERVAL {step} DAY)) AS p) g),
dense AS (SELECT score_run, cluster_id, period, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN everything USING (score_run, cluster_id, period)),
t AS (
  SELECT '{grain}' AS grain, score_run, cluster_id, strftime(period, '%Y-%m-%d') AS period_start, CAST(row_number() OVER w AS INTEGER) AS period_no, n AS complaint_count,
    CAST(sum(n) OVER (w ROWS BETWEEN {short - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS short_total,
    round(avg(n) OVER (w ROWS BETWEEN {short - 1} PRECEDING AND CURRENT ROW), 6) AS short_mean,
    CAST(sum(n) OVER (w ROWS BETWEEN {long - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS long_total,
    round(avg(n) OVER (w ROWS BETWEEN {long - 1} PRECEDING AND CURRENT ROW), 6) AS long_mean
  FROM dense WINDOW w AS (PARTITION BY score_run, cluster_id ORDER BY period))
"""


def _surges_sql(grain: str, short: int, long: int) -> str:
    return f"{_trailing_sql(grain, short, long)} SELECT grain, score_run, cluster_id, period_start FROM t WHERE period_no >= {long} AND long_total >= 20 AND 2 * short_total >= long_total"


_PROFILE = """
SELECT '{f}' AS field_name, {f} AS key_value, count(*) AS n_rows, count(narrative) AS n_narrative,
  CAST(COALESCE(sum(length(narrative)), 0) AS BIGINT) AS narrative_chars, count(*) FILTER (WHERE timely_response = 'No') AS n_untimely,
  min(date_received) AS first_received, max(date_received) AS last_received,
  round(CAST(sum(date_sent_to_company - date_received) AS DOUBLE) / nullif(count(date_sent_to_company - date_received), 0), 6) AS mean_lag_days
FROM prepared GROUP BY {f}"""
_HEAVY = "SELECT '{f}' AS field_name, {f} AS key_value FROM prepared WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) >= 0.02 * (SELECT count(*) FROM prepared)"

ORACLE = {
    "p2_key_profile": " UNION ALL ".join(_PROFILE.format(f=f) for f in ("company", "product")),
    "p2_found": " UNION ALL ".join(_HEAVY.format(f=f) for f in ("company", "product")),
    "p3_weekly_trailing": _trailing_sql("week", *WEEK) + "SELECT * FROM t",
    "p3_daily_trailing": _trailing_sql("day", *DAY) + "SELECT * FROM t",
    "p3_found": f"SELECT * FROM ({_surges_sql('week', *WEEK)}) UNION ALL SELECT * FROM ({_surges_sql('day', *DAY)})",
}
