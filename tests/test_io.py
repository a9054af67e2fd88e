import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks
from tidemark.streaming.counts import period_counts, replace_periods, running_cusum


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("007", 'say "x"\nagain', 1.5), ("8", None, None)], "id string, t string, v double")
    assert sinks.write_parquet(df.coalesce(1), str(tmp_path / "a.parquet"), 2) == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_parquet(df, str(tmp_path / "a.parquet"))
    with pytest.raises(ValueError, match="instead of"):
        sinks.write_parquet(df, str(tmp_path / "b.parquet"), 3)
    sinks.write_parquet(spark.range(10).coalesce(1), str(tmp_path / "c.parquet"), rows_per_file=3)
    assert len(list((tmp_path / "c.parquet").glob("*.parquet"))) == 4
    (tmp_path / "d.csv").write_text('id,t\n007,"a ""b"""\n')
    got = readers.completed(readers.read_table(spark, str(tmp_path / "d.csv")), ["id"], ["t", "more"])
    assert got.first().asDict() == {"id": "007", "t": 'a "b"', "more": None}
    assert readers.read_table(spark, str(tmp_path / "a.parquet"), ["id"]).columns == ["id"]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError, match="missing"):
        readers.completed(df, ["nope"], [])
    part = next((tmp_path / "a.parquet").glob("part*"))
    assert readers.file_statistics(str(part))["t"]["n_null"] == 1
    readers.require_pinned({str(part): readers.file_sha256(str(part))})
    with pytest.raises(ValueError, match="changed"):
        readers.require_pinned({str(part): "0" * 64})
    assert readers.latest_run(str(tmp_path / "*.parquet")).endswith("c.parquet")
    with pytest.raises(FileNotFoundError):
        readers.latest_run(str(tmp_path / "none*"))
    sinks.publish(str(tmp_path / "c.parquet"), str(tmp_path / "final"))
    with pytest.raises(FileExistsError):
        sinks.publish(str(tmp_path / "a.parquet"), str(tmp_path / "final"))
    sinks.write_csv(df, str(tmp_path / "csv"), ("id",))
    sinks.write_report({"é": 1, "d": dt.date(2024, 1, 1)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text("utf-8")) == {"é": 1, "d": "2024-01-01"}
    with pytest.raises(ValueError):
        sinks.write_report({"x": float("nan")}, str(tmp_path / "n.json"))


def test_labels_and_names():
    from tidemark.functions.labels import flat_metrics, quantile_label, quantile_level

    for level, label in ((0.025, "p025"), (0.1, "p10"), (0.5, "p50"), (0.975, "p975")):
        assert quantile_label(level) == label and quantile_level(label) == level
    for bad in ("q5", "p", "px"):
        with pytest.raises(ValueError):
            quantile_level(bad)
    assert flat_metrics({"a": {"b": 1, "c": {"d": True, "e": None}}, "f": 2.5, "g": "x", "h": [1]}) == {"a/b": 1.0, "a/c/d": 1.0, "f": 2.5}


def test_fit_score_sample_and_resume(spark, tmp_path):
    from tidemark.operators import scoring

    rows = [(i, i % 2, [float(i % 2), 0.01 * (i % 5)], dt.date(2025, 1, 6) + dt.timedelta(i % 21)) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>, day date")
    scoring.fit(df, "label", str(tmp_path / "model"))
    new = df.unionByName(spark.createDataFrame([(900, 0, [9.0, 9.0], dt.date(2025, 1, 7)), (901, 0, None, dt.date(2025, 1, 7)), (None, 0, [0.0, 0.0], None)], df.schema))
    history = spark.createDataFrame([(dt.date(2024, 12, 30), 0, 40), (dt.date(2025, 1, 6), 0, 999)], "period date, cluster_id int, n long")
    scoring.score(new, str(tmp_path / "model"), str(tmp_path / "out"), "id", "day", history)
    report = json.loads((tmp_path / "out" / "score.json").read_text())
    assert report["n_rows"] == 213 and report["n_assigned"] == 211 and report["n_novel"] >= 1
    weekly = spark.read.parquet(str(tmp_path / "out" / "weekly"))
    assert weekly.count() == 6 and weekly.agg(F.sum("n")).first()[0] == 211
    predicted = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    assert predicted.where("period = DATE '2025-01-06' AND cluster_id = 0").first().n < 999 and predicted.where("period = DATE '2024-12-30'").count() == 1
    with pytest.raises(ValueError, match="repeated"):
        scoring.score(df.unionByName(df.limit(1)), str(tmp_path / "model"), str(tmp_path / "out2"), "id", "day")
    assert scoring.sampled(df, 20, "id", str(tmp_path / "sample")) == 20
    scoring.sampled(df.orderBy(F.desc("id")), 20, "id", str(tmp_path / "again"))
    ids = lambda name: sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert ids("sample") == ids("again")
    with pytest.raises(ValueError, match="other settings"):
        for settings in ({"v": 1}, {"v": 2}):
            scoring.resumable(df, "id", lambda d: d.select("id"), str(tmp_path / "part"), settings, buckets=2)


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 14, 5), "k", str(i % 20)) for i in range(28)]
    spark.createDataFrame(rows, "at timestamp, k string, id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string, id string").parquet(str(tmp_path / "in"))
    q = period_counts(stream, "at", "k", "7 days").writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable(), q.stop()
    assert sorted(map(tuple, spark.table("weeks").collect())) == [(dt.datetime(2024, 1, 1), "k", 14), (dt.datetime(2024, 1, 8), "k", 14)]

    z = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 1, 1, 1, -2, 3])], "k string, i int, z double")
    z.where("i < 2").coalesce(1).write.parquet(str(tmp_path / "z"))
    z.where("i >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "z"))
    source = spark.readStream.schema("k string, i int, z double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "z"))
    q = running_cusum(source, "k", "i", "z", 0.5, 1.2).writeStream.format("memory").queryName("sums").outputMode("append").start()
    q.processAllAvailable(), q.stop()
    got = sorted(map(tuple, spark.table("sums").collect()), key=lambda r: r[1])
    assert [round(r[2], 6) for r in got] == [0.5, 1.0, 1.5, 0.5, 0.0, 2.5]

    put = replace_periods(str(tmp_path / "out"), "p")
    put(spark.createDataFrame([(1, 5), (2, 6)], "n int, p int"), 0)
    put(spark.createDataFrame([(9, 6)], "n int, p int"), 1)
    assert sorted((r.n, r.p) for r in spark.read.parquet(str(tmp_path / "out")).select("n", F.col("p")).collect()) == [(1, 5), (9, 6)]
