"""Records that differ in formatting only (problem 4): recursive radix partitioning on canonical bytes, counting tries.

A record's canonical bytes are its letters and digits, case-folded, field by field. Buckets are prefixes of these bytes;
a bucket with too many records is split by further bytes, again and again, until each fits or holds copies of one record
only. Each block of input first counts its own records in a trie, so that a record with any number of copies leaves a
block once; then each bucket counts its records in a path-compressed trie with terminal counters. Ids go back to their
record by its digest, with records of very many copies joined apart from the others.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

FIELD_END, PAIR_END = "\x1f", "\x1e"
FEW = 100_000  # prefixes or records that may be sent to all tasks


def letters_and_digits(c: Column) -> Column:
    """The case-folded letters and digits of a text, in order; null stays null."""
    return F.regexp_replace(F.translate(F.lower(F.upper(c)), "ς", "σ"), r"[^\p{L}\p{N}]+", "")


def plain(text: str) -> str:
    """``letters_and_digits`` for a Python string."""
    return "".join(filter(str.isalnum, text.upper().lower().replace("ς", "σ")))


_LABEL = r"([^\W\d_][^\n:=;|]{0,40}?)"
_FIRST = re.compile(rf"\s*{_LABEL}\s*([:=])")


def fields(payload: str) -> list[tuple[str, str]]:
    """Label and value pairs of a record, in any of these styles: a JSON object; ``label: value`` lines; ``label=value`` parts between semicolons or bars.

    A part without a label goes on with the value before it. A text in none of the styles is one value without a label;
    a JSON null is an empty value.
    """
    body = payload.strip()
    if body[:1] == "{":
        try:
            pairs = json.loads(body, object_pairs_hook=list, strict=False)
            if isinstance(pairs, list):
                return [(str(k), "" if v is None else v if isinstance(v, str) else json.dumps(v)) for k, v in pairs]
        except ValueError:
            pass
    first = _FIRST.match(body)
    if not first:
        return [("", payload)]
    mark = re.escape(first[2])
    for ends in ("\n", ";", "|") if first[2] == ":" else (";", "|", "\n"):
        starts = list(re.finditer(rf"(?:^|{re.escape(ends)})\s*{_LABEL}\s*{mark}", body))
        if len(starts) > 1:
            break
    else:
        starts = [first]
    stops = [m.start() for m in starts[1:]] + [len(body)]
    return [(m[1], body[m.end() : stop]) for m, stop in zip(starts, stops)]


def canonical_record(payload: str) -> str:
    """The pairs of a record as canonical text, sorted, so that their order doesn't matter."""
    return PAIR_END.join(sorted(plain(k) + FIELD_END + plain(v) for k, v in fields(payload)))


def canonical_payloads(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(id, canon) of records held as one text each; null ids and payloads are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([canonical_record(p) for p in b.column("p").to_pylist()], pa.string())], names=["id", "canon"])

    rows = records.select(F.col(key).cast("string").alias("id"), F.col(payload).alias("p")).where("id IS NOT NULL AND p IS NOT NULL")
    return rows.mapInArrow(run, "id string, canon string")


def canonical_columns(records: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """(id, canon) of records held in columns; rows with a null id or a null in any of ``columns`` are left out."""
    columns = list(columns)
    rows = records.dropna(subset=[key, *columns])
    return rows.select(F.col(key).cast("string").alias("id"), F.concat_ws(FIELD_END, *[letters_and_digits(F.col(c).cast("string")) for c in columns]).alias("canon"))


class Trie:
    """A path-compressed trie over bytes; each terminal counts its key and keeps the smallest id seen with it."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [{}, None]  # children by first byte as [label, node]; terminal

    def add(self, key: bytes, n: int, first: str) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                child: list = [{}, None]
                node[0][key[at]] = [key[at:], child]
                node = child
                break
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)  # the length shared with the label, by halving
            while low < high:
                mid = (low + high + 1) // 2
                if key.startswith(label[:mid], at):
                    low = mid
                else:
                    high = mid - 1
            fork: list = [{label[low]: [label[low:], child]}, None]
            node[0][key[at]] = [label[:low], fork]
            node, at = fork, at + low
        if node[1] is None:
            node[1] = [n, first]
        else:
            node[1][0] += n
            node[1][1] = min(node[1][1], first)

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        todo: list[tuple[bytes, list]] = [(b"", self.root)]
        while todo:
            key, node = todo.pop()
            if node[1] is not None:
                yield key, *node[1]
            todo += [(key + label, child) for label, child in node[0].values()]


_PIECE = pa.schema([("leaf", pa.int64()), ("canon", pa.binary()), ("n", pa.int64()), ("first_id", pa.string())])


def split_prefixes(rows: DataFrame, bucket_rows: int, start: int = 8) -> list[set[bytes]]:
    """Per level the prefixes whose buckets are too large and are split by further bytes; level i has prefixes of ``start << i`` bytes.

    Only prefixes of more than ``bucket_rows`` rows come to the driver, at most rows / bucket_rows of them a level; the
    rows of the next level are picked by a join with them, not by a list in the plan. A bucket of copies of one record
    isn't split, as no further byte can split it.
    """
    levels: list[set[bytes]] = []
    left, width = rows.select(F.col("canon").cast("binary").alias("canon"), "digest"), start
    while True:
        head = F.substring("canon", 1, width)
        sizes = left.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        split = staged(sizes.where((F.col("n") > bucket_rows) & (F.col("a") != F.col("b"))).select("head"))
        over = {bytes(r["head"]) for r in split.toLocalIterator()}
        if not over:
            return levels
        levels.append(over)
        left = left.join(F.broadcast(split) if len(over) <= FEW else split, head == F.col("head"), "left_semi")
        width *= 2


def _leaf(key: bytes, levels: list[set[bytes]], start: int) -> int:
    width = start
    for over in levels:
        if key[:width] not in over:
            break
        width *= 2
    head = key[:width]
    return zlib.crc32(head) << 20 | len(head)


def _blocks(levels: list[set[bytes]], start: int, block_rows: int):
    def out(trie: Trie) -> Iterator[pa.RecordBatch]:
        got = list(trie.terminals())
        for a in range(0, len(got), 4096):
            part = got[a : a + 4096]
            yield pa.record_batch([pa.array([_leaf(k, levels, start) for k, _, _ in part], pa.int64()), pa.array([k for k, _, _ in part], pa.binary()), pa.array([n for _, n, _ in part], pa.int64()), pa.array([i for _, _, i in part], pa.string())], schema=_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, n = Trie(), 0
        for b in batches:
            for key, i in zip(b.column("canon").cast(pa.binary()).to_pylist(), b.column("id").to_pylist()):
                trie.add(key, 1, i)
            n += b.num_rows
            if n >= block_rows:
                yield from out(trie)
                trie, n = Trie(), 0
        yield from out(trie)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of one bucket after the other; rows come sorted by bucket."""

    def out(trie: Trie) -> pa.RecordBatch:
        got = list(trie.terminals())
        return pa.record_batch([pa.array([k for k, _, _ in got], pa.binary()), pa.array([n for _, n, _ in got], pa.int64()), pa.array([i for _, _, i in got], pa.string())], names=["canon", "n_rows", "first_id"])

    trie, at, held = Trie(), None, 0
    for b in batches:
        for leaf, key, n, first in zip(b.column("leaf").to_pylist(), b.column("canon").to_pylist(), b.column("n").to_pylist(), b.column("first_id").to_pylist()):
            if leaf != at and held > 2000:
                yield out(trie)
                trie, held = Trie(), 0
            at, held = leaf, held + 1
            trie.add(key, n, first)
    if held:
        yield out(trie)


def distinct_records(rows: DataFrame, bucket_rows: int = 200_000, block_rows: int = 20_000, start: int = 8) -> tuple[DataFrame, DataFrame]:
    """From (id, canon): one row per distinct record (digest, first_id, n_rows), and the staged rows (id, digest).

    ``first_id`` is the smallest id as text, ``n_rows`` the number of stored rows. An empty table gives no rows; an empty
    canonical text is a record like any other.
    """
    held = staged(rows.withColumn("digest", F.unhex(F.md5(F.col("canon").cast("binary")))))
    levels = split_prefixes(held, bucket_rows, start)
    pieces = held.select("id", "canon").mapInArrow(_blocks(levels, start, block_rows), "leaf long, canon binary, n long, first_id string")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // (2 * bucket_rows)))
    pieces = pieces.repartition(tasks, "leaf").sortWithinPartitions("leaf")
    counted = pieces.mapInArrow(_counted, "canon binary, n_rows long, first_id string")
    return counted.select(F.unhex(F.md5("canon")).alias("digest"), "first_id", "n_rows"), held.select("id", "digest")


def copies(classes: DataFrame, ids: DataFrame, hot_rows: int = 100_000, few: int = FEW) -> DataFrame:
    """(first_id, copy_id) for each other id of a record, each pair once.

    Records of more than ``hot_rows`` rows are sent to all tasks while they are few (``FEW``), else joined by their digest
    and one of 64 parts of their ids; others are joined by their digest.
    """
    many = classes.where("n_rows > 1")
    hot = many.where(F.col("n_rows") > hot_rows).select("digest", "first_id")
    cold = many.where(F.col("n_rows") <= hot_rows).select("digest", "first_id")
    if hot.limit(few + 1).count() <= few:
        of_hot = ids.join(F.broadcast(hot), "digest")
    else:
        parts = hot.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
        of_hot = ids.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64).cast("long"))).join(parts, ["digest", "part"]).drop("part")
    joined = of_hot.unionByName(ids.join(cold, "digest"))
    return joined.where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def all_copies(classes: DataFrame, ids: DataFrame, hot_rows: int = 100_000, few: int = FEW) -> DataFrame:
    """As ``copies``, with the classes staged, as two branches read them."""
    return copies(staged(classes), ids, hot_rows, few)
