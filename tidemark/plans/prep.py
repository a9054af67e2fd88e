"""Scans, contracts and lookups over the complaint tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contract as C
from tidemark.operators import lookups as L
from tidemark.session import table

QUERIES, ORACLE = {}, {}

#: Starts of the periods after the first, fixed values.
STARTS = [("train_2023_2024", "2023-01-01"), ("validation_2025_h1", "2025-01-01"), ("holdout_2025_h2", "2025-07-01"), ("ood_2026_partial", "2026-01-01")]
CONTEXT = "context_2015_2022"
RELIEF = {"Closed with money returned": True, "Closed with other relief": True, "Closed, explained": False}
MONEY = {"Closed with money returned": True, "Closed with other relief": False, "Closed, explained": False}
UNTIMELY = {"No": True, "Yes": False}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _at():
    """The load time as a number, the same in any time zone."""
    return F.unix_micros("loaded_at").alias("loaded_us")


def _prepared(spark, root):
    return table(spark, root, "prepared")


@query("SELECT complaint_id, date_received, product, company, epoch_us(loaded_at) AS loaded_us FROM prepared")
def src01_scan(spark, root):
    return _prepared(spark, root).select("complaint_id", "date_received", "product", "company", _at())


@query("SELECT complaint_id, product, issue FROM prepared WHERE date_received >= DATE '2024-01-01' AND date_received < DATE '2024-07-01'")
def src03_range_scan(spark, root):
    d = F.col("date_received")
    return _prepared(spark, root).where((d >= F.lit("2024-01-01").cast("date")) & (d < F.lit("2024-07-01").cast("date"))).select("complaint_id", "product", "issue")


@query("""SELECT complaint_id, length(narrative) AS n_chars, hash FROM prepared
WHERE complaint_id IN (SELECT complaint_id FROM sample_manifest WHERE sample_split = 'validation')
QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY loaded_at DESC, hash DESC) = 1""")
def src04_lookup_by_id(spark, root):
    ids = table(spark, root, "sample_manifest").where("sample_split = 'validation'").select("complaint_id").distinct()
    rows = _prepared(spark, root).select("complaint_id", F.length("narrative").alias("n_chars"), "hash", "loaded_at").join(ids, "complaint_id", "left_semi")
    return L.latest(rows, ["complaint_id"], "loaded_at", "hash").select("complaint_id", "n_chars", "hash")


@query("SELECT complaint_id, t1 FROM prepared WHERE period = 'train_2023_2024' AND eligible_t1_complete")
def src05_eligible_scan(spark, root):
    return _prepared(spark, root).where((F.col("period") == "train_2023_2024") & F.col("eligible_t1_complete")).select("complaint_id", "t1")


_ALL = "complaint_id date_received product sub_product issue sub_issue narrative company_public_response company state zip_code tags submitted_via date_sent_to_company company_response timely_response hash product_canonical issue_canonical known_product known_issue known_product_issue_pair period t1 t2 t3 t4 known_t1 known_t2 known_t3 known_t4 no_shared_text eligible_t1_complete eligible_t2_complete eligible_t3_complete eligible_t4_complete loaded_at".split()


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM prepared" for c in _ALL))
def src09_null_counts(spark, root):
    return C.null_counts(C.require_columns(_prepared(spark, root), _ALL))


@query("SELECT embedding_row, shard_no, len(embedding) AS size, embedding[1] AS first_value FROM fit_embeddings")
def src10_vector_shards(spark, root):
    return table(spark, root, "fit_embeddings").select("embedding_row", "shard_no", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")).alias("size"), F.get("embedding", F.lit(0)).alias("first_value"))


@query("""SELECT period, count(*) FILTER (WHERE d IS NOT NULL AND p IS NULL) AS n_unparsable, count(p) AS n_dates FROM (
  SELECT *, CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(d AS DATE) END AS p FROM (
    SELECT period, CASE WHEN state IS NULL THEN strftime(date_received, '%d/%m/%Y') WHEN state = 'OR' THEN NULL ELSE strftime(date_received, '%Y-%m-%d') END AS d FROM prepared)) GROUP BY period""")
def prj02_strict_dates(spark, root):
    d = F.when(F.col("state").isNull(), F.date_format("date_received", "dd/MM/yyyy")).when(F.col("state") != "OR", F.date_format("date_received", "yyyy-MM-dd"))
    return _prepared(spark, root).select("period", d.alias("d")).groupBy("period").agg(C.unparsable(F.col("d")).alias("n_unparsable"), F.count(C.strict_date(F.col("d"))).alias("n_dates"))


def _maps(p):
    fit = p.where(F.col("period") == "train_2023_2024")
    product = fit.where("product_canonical IS NOT NULL").groupBy(F.col("product").alias("raw")).agg(F.max("product_canonical").alias("canonical")).where("raw IS NOT NULL")
    issue = fit.where("issue_canonical IS NOT NULL").groupBy(F.col("issue").alias("raw")).agg(F.max("issue_canonical").alias("canonical")).where("raw IS NOT NULL")
    pairs = fit.where("product IS NOT NULL AND issue IS NOT NULL").select(F.col("product").alias("left"), F.col("issue").alias("right")).distinct()
    return product, issue, pairs


def _categorised(p):
    product, issue, pairs = _maps(p)
    rows = p.select("complaint_id", "date_received", "product", "issue", _at())
    rows = L.with_category(rows, "product", product, "product_mapped", "__UNKNOWN__", "product_known")
    rows = L.with_category(rows, "issue", issue, "issue_mapped", None, "issue_known")
    return L.with_pair_flag(rows, "product", "issue", pairs, "pair_known")


_MAPPED = """WITH fit AS (SELECT * FROM prepared WHERE period = 'train_2023_2024'),
pm AS (SELECT product AS raw, max(product_canonical) AS canonical FROM fit WHERE product_canonical IS NOT NULL AND product IS NOT NULL GROUP BY 1),
im AS (SELECT issue AS raw, max(issue_canonical) AS canonical FROM fit WHERE issue_canonical IS NOT NULL AND issue IS NOT NULL GROUP BY 1),
pp AS (SELECT DISTINCT product AS l, issue AS r FROM fit WHERE product IS NOT NULL AND issue IS NOT NULL),
mapped AS (SELECT complaint_id, date_received, product, issue, epoch_us(loaded_at) AS loaded_us, COALESCE(pm.canonical, '__UNKNOWN__') AS product_mapped, pm.raw IS NOT NULL AS product_known,
  im.canonical AS issue_mapped, im.raw IS NOT NULL AS issue_known, pp.l IS NOT NULL AS pair_known
  FROM prepared LEFT JOIN pm ON product = pm.raw LEFT JOIN im ON issue = im.raw LEFT JOIN pp ON product = pp.l AND issue = pp.r)
"""


@query(_MAPPED + "SELECT * FROM mapped")
def prj03_categories(spark, root):
    return _categorised(_prepared(spark, root))


@query(_MAPPED + "SELECT count(*) FILTER (WHERE NOT product_known) AS unknown_product, count(*) FILTER (WHERE NOT issue_known) AS unknown_issue, count(*) FILTER (WHERE NOT pair_known) AS unknown_pair FROM mapped WHERE date_received <= DATE '2024-12-31'")
def prj04_freeze_violations(spark, root):
    rows = _categorised(_prepared(spark, root)).where(F.col("date_received") <= F.lit("2024-12-31").cast("date"))
    return rows.agg(F.count_if(~F.col("product_known")).alias("unknown_product"), F.count_if(~F.col("issue_known")).alias("unknown_issue"), F.count_if(~F.col("pair_known")).alias("unknown_pair"))


_PERIOD_SQL = "CASE WHEN date_received IS NULL THEN NULL " + " ".join(f"WHEN date_received >= DATE '{d}' THEN '{n}'" for n, d in reversed(STARTS)) + f" ELSE '{CONTEXT}' END"


@query(f"SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, {_PERIOD_SQL} AS period FROM prepared")
def prj05_period(spark, root):
    return _prepared(spark, root).select("complaint_id", _at(), C.label_by_start(F.col("date_received"), STARTS, CONTEXT).alias("period"))


def _case(column, values):
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {str(v).upper()}" for k, v in values.items()) + " END"


@query(f"""SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, CASE WHEN known_issue AND known_product_issue_pair THEN issue_canonical END AS target_1, {_case('company_response', RELIEF)} AS target_2,
{_case('company_response', MONEY)} AS target_3, {_case('timely_response', UNTIMELY)} AS target_4, timely_response IN ('Yes', 'No') AND timely_response IS NOT NULL AS known_4 FROM prepared""")
def prj06_three_valued_targets(spark, root):
    t4 = C.three_valued(F.col("timely_response"), UNTIMELY)
    return _prepared(spark, root).select("complaint_id", _at(), F.when(F.col("known_issue") & F.col("known_product_issue_pair"), F.col("issue_canonical")).alias("target_1"), C.three_valued(F.col("company_response"), RELIEF).alias("target_2"), C.three_valued(F.col("company_response"), MONEY).alias("target_3"), t4.alias("target_4"), t4.isNotNull().alias("known_4"))


_SPLITS = [("calibration", "2024-07-01"), ("validation", "2025-01-01")]


@query("SELECT CASE WHEN date_received IS NULL THEN NULL WHEN date_received >= DATE '2025-01-01' THEN 'validation' WHEN date_received >= DATE '2024-07-01' THEN 'calibration' ELSE 'fit' END AS split, count(*) AS n_rows, count(DISTINCT complaint_id) AS n_ids FROM prepared GROUP BY 1")
def prj14_split(spark, root):
    C.contiguous([("fit", "2015-01-01", "2024-07-01"), ("calibration", "2024-07-01", "2025-01-01"), ("validation", "2025-01-01", "2027-01-01")])
    return _prepared(spark, root).groupBy(C.label_by_start(F.col("date_received"), _SPLITS, "fit").alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("complaint_id").alias("n_ids"))


@query(" UNION ALL ".join(f"SELECT period, '{t}' AS target, count(*) FILTER (WHERE known_{t}) AS n_complete, count(*) FILTER (WHERE known_{t} AND no_shared_text) AS n_no_shared FROM prepared GROUP BY period" for t in ("t1", "t2", "t3", "t4")))
def prj15_masks(spark, root):
    flags = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"known_{t}").alias("known")) for t in ("t1", "t2", "t3", "t4")])).alias("f")
    rows = _prepared(spark, root).select("period", "no_shared_text", flags)
    return rows.groupBy("period", F.col("f.target").alias("target")).agg(F.count_if("f.known").alias("n_complete"), F.count_if(F.col("f.known") & F.col("no_shared_text")).alias("n_no_shared"))


@query("SELECT count(*) FILTER (WHERE complaint_id IS NULL) AS null_complaint_id, count(*) FILTER (WHERE date_received IS NULL) AS null_date_received, count(*) FILTER (WHERE product IS NULL) AS null_product, count(*) FILTER (WHERE narrative IS NULL) AS null_narrative, count(complaint_id) - count(DISTINCT complaint_id) AS repeated_keys FROM prepared")
def prj17_input_violations(spark, root):
    return C.input_violations(_prepared(spark, root), ["complaint_id", "date_received", "product", "narrative"], "complaint_id")


@query("SELECT count(*) AS n_rows, count(DISTINCT complaint_id) AS n_keys, count(*) FILTER (WHERE complaint_id IS NULL) AS n_null_keys, count(*) FILTER (WHERE period IS NULL) AS n_null_periods, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT period AS p FROM prepared WHERE period IS NOT NULL)) AS periods FROM prepared")
def prj18_table_contract(spark, root):
    return C.table_contract(_prepared(spark, root), "complaint_id", "period")


@query("SELECT period, count(*) AS n_rows, count(*) FILTER (WHERE eligible_t1_complete) AS n_t1, count(*) FILTER (WHERE eligible_t2_complete) AS n_t2, count(*) FILTER (WHERE eligible_t3_complete) AS n_t3, count(*) FILTER (WHERE eligible_t4_complete) AS n_t4 FROM prepared GROUP BY period")
def prj19_audit(spark, root):
    return _prepared(spark, root).groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(f"eligible_t{i}_complete").alias(f"n_t{i}") for i in range(1, 5)])


@query("SELECT score_run, week, cluster_id, epoch_us(loaded_at) AS loaded_us, is_complete_week AS flag FROM weekly_panel")
def prj20_text_boolean(spark, root):
    text = F.when(F.col("cluster_id") % 2 == 0, F.upper(F.col("is_complete_week").cast("string"))).otherwise(F.col("is_complete_week").cast("string"))
    return table(spark, root, "weekly_panel").select("score_run", "week", "cluster_id", _at(), C.text_boolean(text).alias("flag"))


def _panel_sql(tab, period, total):
    return f"""WITH cell AS (SELECT score_run, split, {period} AS p, cluster_id, count(*) AS n, max(COALESCE(complaint_count, 0)) AS c, count(*) FILTER (WHERE complaint_count IS NULL) AS nulls,
  count(*) FILTER (WHERE complaint_count < 0) AS neg, min({total}) AS lo, max({total}) AS hi FROM {tab} GROUP BY ALL),
per AS (SELECT score_run, split, p, count(*) AS cells, sum(n - 1) AS repeats, sum(nulls) AS nulls, sum(neg) AS neg, sum(c) AS s, min(lo) AS lo, max(hi) AS hi FROM cell GROUP BY ALL),
k AS (SELECT score_run, split, count(DISTINCT cluster_id) AS k FROM {tab} GROUP BY ALL)
SELECT score_run, split, CAST(sum(repeats) AS BIGINT) AS repeated_rows, CAST(sum(nulls) AS BIGINT) AS null_counts, CAST(sum(neg) AS BIGINT) AS negative_counts, count(*) FILTER (WHERE lo <> hi) AS varying_totals,
  count(*) FILTER (WHERE hi <> s) AS wrong_totals, CAST(count(*) * any_value(k) - sum(cells) AS BIGINT) AS missing_cells FROM per JOIN k USING (score_run, split) GROUP BY score_run, split"""


@query(_panel_sql("weekly_panel", "week", "weekly_total"))
def prj21_weekly_panel_violations(spark, root):
    return C.panel_violations(table(spark, root, "weekly_panel"), ["score_run", "split"], "week", "complaint_count", "weekly_total")


@query(_panel_sql("daily_panel", "received_day", "daily_total"))
def prj21_daily_panel_violations(spark, root):
    return C.panel_violations(table(spark, root, "daily_panel"), ["score_run", "split"], "received_day", "complaint_count", "daily_total")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NULL) AS n_null, CAST(min(len(embedding)) AS INTEGER) AS min_size, CAST(max(len(embedding)) AS INTEGER) AS max_size, count(*) FILTER (WHERE norm = 0) AS n_zero, round(max(abs(norm - 1)) FILTER (WHERE norm > 0), 4) AS worst_norm
FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM fit_embeddings)""")
def prj22_vector_check(spark, root):
    return C.vector_check(table(spark, root, "fit_embeddings"), "embedding")


@query("SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, known_product AS is_product, known_issue AS is_issue, known_product_issue_pair AS is_product_issue_pair, known_t1 AS is_t1, known_t2 AS is_t2, known_t3 AS is_t3, known_t4 AS is_t4 FROM prepared")
def prj24_renamed(spark, root):
    return C.renamed(_prepared(spark, root).withColumn("loaded_us", _at()), "known_", "is_", ["complaint_id", "loaded_us"])


@query("""WITH m AS (SELECT avg(CAST(t2 AS INTEGER)) AS a FROM prepared WHERE period = 'train_2023_2024')
SELECT company, count(*) AS n_rows, round(COALESCE(avg(CAST(t2 AS INTEGER)) FILTER (WHERE period = 'train_2023_2024'), (SELECT a FROM m)), 6) AS rate FROM prepared GROUP BY company""")
def jn01_rate_with_default(spark, root):
    return L.rate_with_default(_prepared(spark, root), "company", F.col("t2"), F.col("period") == "train_2023_2024")


@query("""WITH t AS (SELECT DISTINCT hash AS h FROM prepared WHERE period = 'train_2023_2024' AND hash IS NOT NULL), v AS (SELECT DISTINCT hash AS h FROM prepared WHERE period = 'validation_2025_h1' AND hash IS NOT NULL)
SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, CASE WHEN period = 'validation_2025_h1' THEN t.h IS NULL WHEN period IN ('holdout_2025_h2', 'ood_2026_partial') THEN t.h IS NULL AND v.h IS NULL ELSE TRUE END AS not_shared
FROM prepared LEFT JOIN t ON hash = t.h LEFT JOIN v ON hash = v.h""")
def jn02_not_shared(spark, root):
    p = _prepared(spark, root).select("complaint_id", _at(), "period", "hash")
    rows = L.membership(p, "hash", p.where("period = 'train_2023_2024'").select("hash"), "in_train")
    rows = L.membership(rows, "hash", p.where("period = 'validation_2025_h1'").select("hash"), "in_validation")
    later = F.col("period").isin("holdout_2025_h2", "ood_2026_partial")
    flag = F.when(F.col("period") == "validation_2025_h1", ~F.col("in_train")).when(later, ~(F.col("in_train") | F.col("in_validation"))).otherwise(True)
    return rows.select("complaint_id", "loaded_us", flag.alias("not_shared"))


@query("""WITH r AS (SELECT DISTINCT complaint_id, hash FROM prepared), m AS (SELECT DISTINCT complaint_id, sample_split FROM sample_manifest)
SELECT m.complaint_id, hash, hash IS NULL OR hash NOT IN (SELECT hash FROM r JOIN m USING (complaint_id) WHERE sample_split = 'fit' AND hash IS NOT NULL) AS is_new FROM m JOIN r USING (complaint_id) WHERE sample_split = 'calibration'""")
def jn03_calibration_flag(spark, root):
    rows = _prepared(spark, root).select("complaint_id", "hash").distinct().join(table(spark, root, "sample_manifest").select("complaint_id", "sample_split").distinct(), "complaint_id")
    got = L.membership(rows.where("sample_split = 'calibration'").select("complaint_id", "hash"), "hash", rows.where("sample_split = 'fit'").select("hash"), "seen")
    return got.select("complaint_id", "hash", (~F.col("seen")).alias("is_new"))


@query("""WITH a AS (SELECT score_run, week, cluster_id, count(*) AS n FROM weekly_panel GROUP BY ALL), b AS (SELECT score_run, date_trunc('week', received_day)::DATE AS week, cluster_id, count(DISTINCT received_day) AS n FROM daily_panel GROUP BY ALL)
SELECT a.score_run, count(*) AS n_left, count(b.n) AS n_matched, count(*) FILTER (WHERE b.n IS NULL) AS n_missing, CAST(sum(a.n - 1) AS BIGINT) AS n_repeated FROM a LEFT JOIN b USING (score_run, week, cluster_id) GROUP BY a.score_run""")
def jn04_one_to_one_check(spark, root):
    keys = ["score_run", "week", "cluster_id"]
    a = table(spark, root, "weekly_panel").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, root, "daily_panel").select("score_run", F.date_trunc("week", "received_day").cast("date").alias("week"), "cluster_id", "received_day").groupBy(*keys).agg(F.count_distinct("received_day").alias("m"))
    return a.join(b, keys, "left").groupBy("score_run").agg(F.count(F.lit(1)).alias("n_left"), F.count("m").alias("n_matched"), F.count_if(F.col("m").isNull()).alias("n_missing"), F.sum(F.col("n") - 1).alias("n_repeated"))


@query("""SELECT w.score_run, w.week, w.cluster_id, epoch_us(w.loaded_at) AS loaded_us, w.complaint_count, s.main_product, s.p95_distance FROM weekly_panel w LEFT JOIN cluster_summary s ON w.cluster_id = s.cluster_id WHERE w.novel_count > 0""")
def jn06_with_summary(spark, root):
    s = L.small(table(spark, root, "cluster_summary").select("cluster_id", "main_product", "p95_distance"))
    return table(spark, root, "weekly_panel").where("novel_count > 0").join(s, "cluster_id", "left").select("score_run", "week", "cluster_id", _at(), "complaint_count", "main_product", "p95_distance")


@query("""SELECT m.complaint_id, m.embedding_row, e.shard_no, e.embedding_row IS NULL AS is_missing FROM (SELECT DISTINCT complaint_id, embedding_row FROM sample_manifest WHERE sample_split = 'fit') m
LEFT JOIN (SELECT embedding_row, min(shard_no) AS shard_no FROM fit_embeddings GROUP BY 1) e USING (embedding_row)""")
def jn07_aligned_rows(spark, root):
    m = table(spark, root, "sample_manifest").where("sample_split = 'fit'").select("complaint_id", "embedding_row").distinct()
    e = table(spark, root, "fit_embeddings").groupBy(F.col("embedding_row").alias("_row")).agg(F.min("shard_no").alias("shard_no"))
    return m.join(e, m.embedding_row == e._row, "left").select("complaint_id", "embedding_row", "shard_no", F.col("_row").isNull().alias("is_missing"))


@query("SELECT DISTINCT complaint_id, period FROM prepared WHERE period = 'train_2023_2024' AND complaint_id NOT IN (SELECT complaint_id FROM sample_manifest WHERE sample_split = 'fit' AND complaint_id IS NOT NULL)")
def jn08_outside_sample(spark, root):
    fit = table(spark, root, "sample_manifest").where("sample_split = 'fit'").select("complaint_id")
    return _prepared(spark, root).where("period = 'train_2023_2024'").select("complaint_id", "period").distinct().join(fit, "complaint_id", "left_anti")


@query("SELECT score_run, received_day, cluster_id, daily_total FROM daily_panel d WHERE EXISTS (SELECT 1 FROM weekly_panel w WHERE w.week = date_trunc('week', d.received_day) AND w.cluster_id = d.cluster_id AND w.score_run = d.score_run AND w.novel_count > 0)")
def jn12_composite_membership(spark, root):
    alerts = table(spark, root, "weekly_panel").where("novel_count > 0").select("score_run", "week", "cluster_id")
    d = table(spark, root, "daily_panel").withColumn("week", F.date_trunc("week", "received_day").cast("date"))
    return d.join(alerts, ["score_run", "week", "cluster_id"], "left_semi").select("score_run", "received_day", "cluster_id", "daily_total")


@query("""SELECT s.cluster_id, s.main_product, CASE WHEN a.cluster_id IS NULL THEN NULL ELSE concat(strftime(a.first_week, '%Y-%m-%d'), ' ', a.n) END AS alert_info
FROM cluster_summary s LEFT JOIN (SELECT cluster_id, min(week) AS first_week, count(*) AS n FROM weekly_panel WHERE novel_count > 1 GROUP BY 1) a USING (cluster_id)""")
def jn13_optional_hit(spark, root):
    a = table(spark, root, "weekly_panel").where("novel_count > 1").groupBy("cluster_id").agg(F.min("week").alias("w"), F.count(F.lit(1)).alias("n"))
    info = F.when(F.col("n").isNotNull(), F.concat_ws(" ", F.date_format("w", "yyyy-MM-dd"), F.col("n").cast("string")))
    return table(spark, root, "cluster_summary").join(a, "cluster_id", "left").select("cluster_id", "main_product", info.alias("alert_info"))


@query("""SELECT m.embedding_row, COALESCE(c.v, m.embedding_row * 1.0) AS value, c.v IS NOT NULL AS was_cached FROM (SELECT DISTINCT embedding_row FROM sample_manifest WHERE embedding_row IS NOT NULL) m
LEFT JOIN (SELECT embedding_row, max(CAST(embedding[1] AS DOUBLE)) AS v FROM fit_embeddings WHERE embedding IS NOT NULL GROUP BY 1) c USING (embedding_row)""")
def jn14_cached_or_new(spark, root):
    cached = table(spark, root, "fit_embeddings").where("embedding IS NOT NULL").groupBy("embedding_row").agg(F.max(F.get("embedding", F.lit(0)).cast("double")).alias("v"))
    m = table(spark, root, "sample_manifest").where("embedding_row IS NOT NULL").select("embedding_row").distinct()
    return m.join(cached, "embedding_row", "left").select("embedding_row", F.coalesce("v", F.col("embedding_row").cast("double")).alias("value"), F.col("v").isNotNull().alias("was_cached"))


@query("""WITH new AS (SELECT score_run, date_trunc('week', received_day)::DATE AS week, cluster_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT score_run, received_day, cluster_id, max(COALESCE(complaint_count, 0)) AS n FROM daily_panel GROUP BY ALL) GROUP BY ALL),
old AS (SELECT score_run, week, cluster_id, max(COALESCE(complaint_count, 0)) AS n FROM weekly_panel GROUP BY ALL)
SELECT score_run, week, cluster_id, n, 'frozen' AS source FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.score_run = old.score_run AND new.week = old.week) UNION ALL SELECT score_run, week, cluster_id, n, 'new' FROM new""")
def jn15_replaced_periods(spark, root):
    n = F.max(F.coalesce("complaint_count", F.lit(0))).alias("n")
    old = table(spark, root, "weekly_panel").groupBy("score_run", "week", "cluster_id").agg(n)
    days = table(spark, root, "daily_panel").groupBy("score_run", "received_day", "cluster_id").agg(n)
    new = days.groupBy("score_run", F.date_trunc("week", "received_day").cast("date").alias("week"), "cluster_id").agg(F.sum("n").alias("n"))
    return L.replaced(old, new, ["score_run", "week"])
