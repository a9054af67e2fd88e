"""Text and category features in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import ngrams, tokens


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 5, most_terms: int = 100_000) -> DataFrame:
    """(key, term, weight, norm): words and word pairs, 1 + ln tf times ln((1 + n) / (1 + df)) + 1, unit length per document.

    Terms in fewer than ``min_df`` documents are left out, as are those beyond the ``most_terms`` most frequent (ties by
    term); with that bound the table of document frequencies is small enough to be sent to all tasks.
    """
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    tf = words.select(key, F.explode(F.concat("w", ngrams(F.col("w"), 2))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("c")).where(F.col("df") >= min_df).orderBy(F.desc("c"), "term").limit(most_terms)
    n = docs.select(key).distinct().agg(F.count(F.lit(1)).alias("docs"))
    idf = df.join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").select(key, "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"), norm.alias("norm"))


def category_codes(df: DataFrame, fit: DataFrame, column: str) -> DataFrame:
    """``df`` with ``code``, the place of its value among the sorted values of ``fit`` from 0; null for null and unseen values."""
    values = fit.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    codes = values.withColumn("code", F.row_number().over(Window.orderBy("_v")) - 1)  # over one row per category
    return df.join(codes, df[column] == F.col("_v"), "left").drop("_v")


def class_terms(rows: DataFrame, part: str, term: str, top: int) -> DataFrame:
    """(part, term, weight) of the ``top`` terms by share of the class times ln(1 + mean class size / count in all classes)."""
    n = rows.groupBy(part, term).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(term).agg(F.sum("n").alias("a"))
    size = n.groupBy(part).agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("m"))
    scored = n.join(total, term).join(F.broadcast(size), part).join(F.broadcast(mean)).withColumn("weight", F.col("n") / F.col("size") * F.log1p(F.col("m") / F.col("a")))
    w = Window.partitionBy(part).orderBy(F.desc(F.round("weight", 9)), term)
    return scored.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= top).select(part, term, "weight")
