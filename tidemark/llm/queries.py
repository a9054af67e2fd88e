"""Queries of the problems that go with language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.clusters import cluster_members, described, near_members
from tidemark.llm.copies import all_copies, canonical_columns, canonical_payloads, distinct_records
from tidemark.llm.languages import document_languages, mislabelled, segments
from tidemark.llm.leaks import leaked_items
from tidemark.llm.mixing import Mix
from tidemark.llm.neighbours import close_pairs, most_similar, recall
from tidemark.llm.overlap import overlap_report, overlapping, split_overlaps


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return most_similar(_table(spark, root, "fit_embeddings"), _table(spark, root, "sample_manifest"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return close_pairs(p1_neighbours(spark, root))


def p1_recall(spark: SparkSession, root: str) -> DataFrame:
    """Recall of the five most similar against brute force."""
    return recall(p1_neighbours(spark, root), _table(spark, root, "fit_embeddings"), _table(spark, root, "sample_manifest"))


def _records(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {
        "prepared": canonical_columns(_table(spark, root, "prepared"), "complaint_id", ["date_received", "company", "narrative"]),
        "raw_records": canonical_payloads(_table(spark, root, "raw_records"), "record_id", "payload"),
    }


def p4_records(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct record once, with the number of its stored rows."""
    parts = [distinct_records(rows)[0].select(F.lit(name).alias("table_name"), "first_id", "n_rows") for name, rows in _records(spark, root).items()]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    parts = [all_copies(*distinct_records(rows)).select(F.lit(name).alias("table_name"), "first_id", "copy_id") for name, rows in _records(spark, root).items()]
    return parts[0].unionByName(parts[1])


def p4_prepared_copies(spark: SparkSession, root: str) -> DataFrame:
    """The copies in columns alone, which SQL can check."""
    return all_copies(*distinct_records(_records(spark, root)["prepared"]))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    members = cluster_members(_table(spark, root, "fit_embeddings"), _table(spark, root, "cluster_summary"))
    return described(members, _table(spark, root, "sample_manifest"), _table(spark, root, "prepared"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return near_members(cluster_members(_table(spark, root, "fit_embeddings"), _table(spark, root, "cluster_summary")))


def p6_overlap_report(spark: SparkSession, root: str) -> DataFrame:
    return overlap_report(*split_overlaps(_table(spark, root, "sample_manifest"), _table(spark, root, "prepared")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    found = overlapping(*split_overlaps(_table(spark, root, "sample_manifest"), _table(spark, root, "prepared")))
    return found.select(F.col("id").alias("complaint_id"), F.col("split").alias("sample_split")).distinct()


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(_table(spark, root, "documents"), _table(spark, root, "eval_items"))


def p7_leaks_by_item(spark: SparkSession, root: str) -> DataFrame:
    """Per item in how many documents it leaked; items that leaked nowhere are left out."""
    return p7_leaks(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("coverage").alias("most_coverage"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_leaks(spark, root).select("doc_id", "item_id")


def _mix(spark: SparkSession, root: str) -> Mix:
    vocabulary = spark.conf.get("tidemark.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return Mix(_table(spark, root, "documents"), _table(spark, root, "mix_targets"), vocabulary)


def p8_schedule(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root).schedule


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root).report


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root).report.where("NOT reachable").select("source")


def p9_segments(spark: SparkSession, root: str) -> DataFrame:
    return segments(_table(spark, root, "documents"))


def p9_documents(spark: SparkSession, root: str) -> DataFrame:
    return document_languages(segments(_table(spark, root, "documents")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return mislabelled(segments(_table(spark, root, "documents")))


QUERIES = {f.__name__: f for f in (p1_neighbours, p1_found, p1_recall, p4_records, p4_found, p4_prepared_copies, p5_clusters, p5_found, p6_overlap_report, p6_found, p7_leaks, p7_leaks_by_item, p7_found, p8_schedule, p8_report, p8_found, p9_segments, p9_documents, p9_found)}
#: Brute force over all pairs of vectors, and grouping by the canonical text; for small tables.
ORACLE: dict[str, str] = {
    "p1_found": """WITH v AS (SELECT embedding_row AS r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM fit_embeddings WHERE embedding IS NOT NULL AND embedding_row IN (SELECT embedding_row FROM sample_manifest)
  QUALIFY row_number() OVER (PARTITION BY embedding_row ORDER BY encoded_at DESC NULLS LAST) = 1),
n AS (SELECT r, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
s AS (SELECT a.r AS a, b.r AS b, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS c, row_number() OVER (PARTITION BY a.r ORDER BY list_dot_product(a.e, b.e) / (a.norm * b.norm) DESC, b.r) AS i FROM n a JOIN n b ON a.r <> b.r)
SELECT DISTINCT least(a, b) AS row_a, greatest(a, b) AS row_b FROM s WHERE i <= 5 AND c >= 0.85""",
    "p4_prepared_copies": """WITH k AS (SELECT DISTINCT complaint_id AS id, concat_ws(chr(31), replace(CAST(date_received AS VARCHAR), '-', ''), regexp_replace(lower(company), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(narrative), '[^\\p{L}\\p{N}]', '', 'g')) AS canon
  FROM prepared WHERE complaint_id IS NOT NULL AND date_received IS NOT NULL AND company IS NOT NULL AND narrative IS NOT NULL),
f AS (SELECT canon, min(id) AS first_id FROM k GROUP BY 1) SELECT DISTINCT first_id, id AS copy_id FROM k JOIN f USING (canon) WHERE id <> first_id""",
}
