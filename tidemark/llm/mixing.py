"""Mixing sources to target shares of tokens (problem 8): a low-discrepancy schedule over shuffled equal-token blocks.

Slots of ``block_tokens`` tokens are dealt to sources by the golden-ratio sequence through the cumulative shares, so every
run of slots has nearly the target shares. A slot's rank among its source's slots names the block of the source's shuffled
token line to take, and how often the line was used before; a document that crosses the end of a block lies in both with a
part of its tokens. Ranks and token offsets are prefix sums in two levels (per chunk or hash bucket, then inside it), so a
source that holds most documents is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

#: Slots by which a source's number of slots may differ from its share of them at most (the sequence's discrepancy grows with the logarithm of its length).
NEAR = 64
#: Golden ratio of 2 ** 32, a fixed value: multiples modulo 2 ** 32 are the sequence.
GOLDEN = 2654435769
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) of documents with an id and a source; a null text has no tokens. Texts are counted whole.

    ``vocabulary`` is a file of base64 tokens and ranks on the driver's disk or a shared store; it is sent to the executors.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.where("doc_id IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, tokens long")


class Mix:
    """A mix of documents: ``schedule`` (slot, source, repeat_no, doc_id, first_token, tokens) and ``report`` (one row per target source).

    A row of the schedule is a document or the part of it in the slot's block, ``tokens`` from ``first_token`` (0 is the
    first) on. All blocks of a source but its last have just ``block_tokens`` tokens.

    Targets with a null source are left out, a null share counts as 0, a null or non-positive max_repeats as 1, of
    repeated sources the largest share holds, and shares are scaled to sum to 1. Documents with a null id or source, or a
    source without a target, take no part; repeated ids count as often as stored. A document without tokens is in no block. No
    token is used more often than its source may be repeated. Slots beyond a source's last block and repeat stay empty and
    are reported. Without targets or tokens the schedule is empty.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str, block_tokens: int = 4096, seed: int = 11, buckets: int = 4096):
        spark = documents.sparkSession
        # The targets are a configuration: a row per source of the mix.
        rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).cast("long").alias("max_repeats")).orderBy("source").collect()
        whole = sum(r["share"] for r in rows) or 1.0
        wanted = spark.createDataFrame([(r["source"], r["share"] / whole, r["max_repeats"]) for r in rows], "source string, target_share double, max_repeats long")
        self.tokens = staged(token_counts(documents.join(F.broadcast(wanted.select("source")), "source", "left_semi"), vocabulary))
        held = self.tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("tokens"))
        have = {r["source"]: r["tokens"] for r in held.collect()}  # at most a row per target
        self.total = sum(have.values())
        plan = [(r["source"], have.get(r["source"], 0), -(-have.get(r["source"], 0) // block_tokens)) for r in rows]
        sizes = spark.createDataFrame(plan, "source string, all_tokens long, n_blocks long")

        bucket = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets))
        lined = self.tokens.withColumn("bucket", bucket)
        per = lined.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        per = per.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
        inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        offset = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
        blocks = lined.where("tokens > 0").join(per, ["source", "bucket"]).withColumn("offset", offset)
        cut = F.explode(F.sequence(F.floor(F.col("offset") / block_tokens), F.floor((F.col("offset") + F.col("tokens") - 1) / block_tokens)))
        blocks = blocks.withColumn("block", cut).withColumn("first_token", F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("offset")))
        held_here = F.least(F.col("tokens"), (F.col("block") + 1) * block_tokens - F.col("offset")) - F.col("first_token")
        blocks = blocks.select("source", "doc_id", "block", "first_token", held_here.alias("tokens"))

        slots = spark.range(-(-self.total // block_tokens)).withColumnRenamed("id", "slot")
        point = F.pmod((F.pmod(F.col("slot") + 1, F.lit(1 << 31))) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))
        source, low = F.lit(None).cast("string"), 0.0
        for i, r in enumerate(rows):
            low += r["share"] / whole
            source = F.when(F.col("u") < low, F.lit(r["source"])) if i == 0 else source.when(F.col("u") < low, F.lit(r["source"]))
        source = source.otherwise(F.lit(rows[-1]["source"])) if rows else source
        dealt = slots.withColumn("u", point).select("slot", source.alias("source"), F.floor(F.col("slot") / 65_536).alias("chunk"))
        counts = dealt.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
        rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
        ranked = dealt.join(counts, ["source", "chunk"]).withColumn("rank", rank).join(F.broadcast(sizes), "source").join(F.broadcast(wanted), "source")
        at = F.when(F.col("n_blocks") > 0, F.floor(F.col("rank") / F.col("n_blocks")))
        ranked = ranked.withColumn("repeat_no", at).withColumn("filled", F.coalesce(F.col("repeat_no") < F.col("max_repeats"), F.lit(False)))
        used = ranked.where("filled").select("slot", "source", "repeat_no", (F.col("rank") - F.col("repeat_no") * F.col("n_blocks")).alias("block"))
        self.schedule = used.join(blocks, ["source", "block"]).select("slot", "source", "repeat_no", "doc_id", "first_token", "tokens")

        done = self.schedule.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max("repeat_no").alias("last_repeat"))
        empty = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("slots"), F.count_if(~F.col("filled")).alias("empty_slots"))
        report = wanted.join(F.broadcast(sizes), "source").join(held.select("source", "n_documents"), "source", "left").join(done, "source", "left").join(empty, "source", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        report = report.select("source", "target_share", "max_repeats", zero("n_documents"), F.col("all_tokens").alias("tokens"), zero("slots"), zero("empty_slots"), zero("mixed_tokens"), (zero("last_repeat") + F.when(F.col("last_repeat").isNotNull(), 1).otherwise(0)).alias("times_used"), F.coalesce(F.col("n_blocks") * F.col("max_repeats") - F.col("slots") <= NEAR + F.col("max_repeats"), F.lit(True)).alias("used_up"))
        mixed = Window.partitionBy(F.lit(1))  # over one row per target
        report = report.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.sum("mixed_tokens").over(mixed), 6))
        # The schedule tells which sources it uses up, to the nearest blocks (each repeat has a partly filled last one); tokens tell exactly.
        short = F.col("used_up") & (F.col("tokens") * F.col("max_repeats") < F.col("target_share") * F.lit(self.total))
        self.report = report.withColumn("reachable", ~short).drop("used_up")
