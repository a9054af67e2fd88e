import random

import pytest

from tidemark.llm.copies import Trie, all_copies, canonical_columns, canonical_payloads, canonical_record, distinct_records, fields, plain


def test_styles_of_one_record_are_the_same():
    a = '{"Date received": "2024-01-02", "Company": "A-B Co.", "Narrative": "It failed; again: yes"}'
    b = "company=a b co; narrative=It failed; again: yes; date_received=2024/01/02"
    c = "NARRATIVE: it  FAILED again, yes\nDATE_RECEIVED: 20240102\nCOMPANY: ab co"
    assert canonical_record(a) == canonical_record(b) == canonical_record(c)
    assert canonical_record(a) != canonical_record(a.replace("yes", "no"))
    assert canonical_record(a) != canonical_record('{"Company": "A-B Co.", "Narrative": "It failed; again: yes"}')


def test_odd_payloads():
    assert fields("") == [("", "")] and fields("no labels here") == [("", "no labels here")]
    assert fields('{"a": null, "b": [1]}') == [("a", ""), ("b", "[1]")]
    assert fields('{"broken": ') and canonical_record("{}") == ""
    assert plain("Straße ÉTÉ ς") == "strasseétéσ"


def test_trie_counts_like_a_dict():
    rng = random.Random(0)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))).encode() for _ in range(3000)]
    want: dict = {}
    trie = Trie()
    for i, k in enumerate(keys):
        trie.add(k, 1, f"{i:05d}")
        n, first = want.get(k, (0, f"{i:05d}"))
        want[k] = (n + 1, first)
    assert {k: (n, f) for k, n, f in trie.terminals()} == want


@pytest.mark.parametrize("bucket_rows", [3, 200_000])
def test_copies_in_columns(spark, bucket_rows):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["same", "start", "of", "each", "text"]) for _ in range(6)) for _ in range(60)]
    rows = [(str(i), "2024-01-01", "Bank", t) for i, t in enumerate(texts)]
    rows += [(str(100 + i), "2024-01-01", "BANK", t.upper().replace(" ", " - ")) for i, t in enumerate(texts[:20])]
    rows += [("5", "2024-01-01", "Bank", texts[5]), ("900", "2024-01-01", None, texts[0]), ("901", "2024-01-01", "Bank", None), (None, "2024-01-01", "Bank", texts[0]), ("902", "2024-01-01", "Bank", ""), ("903", "2024-01-01", "Bank", "?!"), ("904", "2024-01-01", "Bank", "x" * 50_000), ("905", "2024-01-01", "bank", "X" * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "cid string, d string, company string, narrative string, digest string")
    classes, ids = distinct_records(canonical_columns(df, "cid", ["d", "company", "narrative"]), bucket_rows=bucket_rows, block_rows=16)
    groups: dict = {}
    for i, d, c, n in rows:
        if None not in (i, d, c, n):
            groups.setdefault((plain(d), plain(c), plain(n)), []).append(i)
    got = {(r.first_id, r.n_rows) for r in classes.collect()}
    assert got == {(min(v), len(v)) for v in groups.values()}
    want = {(min(v), i) for v in groups.values() for i in set(v) if i != min(v)}
    for hot, few in ((2, 100), (2, 0), (100_000, 100)):
        pairs = [(r.first_id, r.copy_id) for r in all_copies(classes, ids, hot, few).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_payloads_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x: 1\ny: 2"), ("b", "Y=2; X=1"), ("c", None), (None, "x: 1"), ("d", "x: 1")], "record_id string, payload string")
    classes, ids = distinct_records(canonical_payloads(df, "record_id", "payload"))
    assert {(r.first_id, r.copy_id) for r in all_copies(classes, ids).collect()} == {("a", "b")}
    classes, ids = distinct_records(canonical_payloads(df.limit(0), "record_id", "payload"))
    assert classes.count() == 0 and all_copies(classes, ids).count() == 0
