import pytest

from tidemark.llm.mixing import Mix, token_counts

D = "doc_id long, text string, source string, block string, tokens string"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
T = "source string, target_share double, max_repeats int, slot int"


def docs(spark, spec):
    rows, i = [], 0
    for source, n in spec.items():
        for _ in range(n):
            rows.append((i, "some words about a letter " * (1 + i % 5), source, "x", "y"))
            i += 1
    return spark.createDataFrame([*rows, (900, None, "a", "x", "y"), (901, "", "a", "x", "y"), (None, "text", "a", "x", "y"), (902, "text", None, "x", "y"), (903, "text " * 50, "untargeted", "x", "y")], D)


def test_shares_repeats_and_unreachable(spark):
    given = docs(spark, {"a": 300, "b": 100, "c": 4})
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.3, 3, 0), ("c", 0.1, 2, 0), ("none", 0.1, 5, 0), (None, 0.5, 1, 0)], T)
    mix = Mix(given, targets, VOCABULARY, block_tokens=128)
    s = mix.schedule.toPandas()
    report = {r.source: r for r in mix.report.collect()}
    uses = s.groupby(["doc_id", "first_token"]).agg(n=("slot", "size"), source=("source", "first"))
    assert (uses.n <= uses.source.map({"a": 1, "b": 3, "c": 2})).all()
    assert not s.duplicated(["doc_id", "first_token", "repeat_no"]).any() and set(s.source) == {"a", "b", "c"}
    assert not report["c"].reachable and not report["none"].reachable and report["a"].reachable and report["b"].reachable
    assert report["none"].mixed_tokens == 0 and report["none"].empty_slots == report["none"].slots > 0
    a, b = report["a"], report["b"]
    assert abs(b.mixed_tokens / a.mixed_tokens - 0.3 / 0.5) < 0.08
    size = s.groupby("slot").tokens.sum()
    assert (size == 128).sum() >= len(size) - 6 and size.max() == 128  # only a source's last block is smaller
    whole = s.groupby(["doc_id", "repeat_no"]).agg(tokens=("tokens", "sum"), n=("slot", "size"))
    counts = {r.doc_id: r.tokens for r in mix.tokens.collect()}
    assert (whole.n > 1).any() and all(whole.loc[(d, 0)].tokens == counts[d] for d in s[(s.source == "b") & (s.repeat_no == 0)].doc_id.unique())
    share = {r.source: r.mixed_tokens / (0.5 * sum(x.tokens for x in report.values())) for r in report.values()}
    assert abs(share["a"] - 1) < 0.1 and abs(report["a"].actual_share + report["b"].actual_share + report["c"].actual_share - 1) < 1e-5
    first = s[s.slot < 20].groupby("source").slot.nunique()  # every run of slots has about the shares
    assert 8 <= first["a"] <= 12 and 4 <= first["b"] <= 8


def test_token_counts_match_the_tokenizer(spark):
    got = {r.doc_id: r.tokens for r in token_counts(docs(spark, {"a": 3}), VOCABULARY).collect()}
    assert got[900] == 0 and got[901] == 0 and got[1] > got[0] > 3


@pytest.mark.parametrize("no", ["targets", "documents"])
def test_empty(spark, no):
    given, targets = docs(spark, {"a": 3}), spark.createDataFrame([("a", 1.0, None, 0)], T)
    mix = Mix(given.limit(0) if no == "documents" else given, targets.limit(0) if no == "targets" else targets, VOCABULARY)
    assert mix.schedule.count() == 0 and mix.report.count() == (1 if no == "documents" else 0)
