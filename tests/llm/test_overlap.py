import random

import pytest

from tidemark.llm.overlap import overlap_report, overlapping, split_overlaps, word_edits, words

M = "complaint_id string, sample_split string, doc string"
VOCABULARY = [f"v{i}" for i in range(40)]
P = "complaint_id string, narrative string, submitted_via string, key string"


def plain_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_word_edits_against_the_matrix():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        assert word_edits(a, b) == plain_edits(a, b)


def texts(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))] for _ in range(n)]


def test_exact_and_almost(spark):
    rng = random.Random(4)
    base = texts()
    manifest, prepared = [], []
    for i, t in enumerate(base):
        manifest.append((f"f{i}", "fit", "x")), prepared.append((f"f{i}", " ".join(t), "web", "x"))
    want = set()
    for i in range(20):
        t = [w.upper() + "," for w in base[i]]
        for _ in range(len(t) // 12):
            t[rng.randrange(len(t))] = "changed"
        manifest.append((f"e{i}", "validation", "x")), prepared.append((f"e{i}", "  ".join(t), None if i % 2 else "phone", "x"))
        want.add((f"e{i}", "validation"))
    for i, t in enumerate(texts(seed=9, n=30)):
        manifest.append((f"n{i}", "calibration", "x")), prepared.append((f"n{i}", " ".join(t), "web", "x"))
    manifest += [("e0", "validation", "x"), ("gone", "validation", "x"), (None, "validation", "x"), ("u", None, "x"), ("nul", "validation", "x"), ("empty", "validation", "x"), ("f0", "calibration", "x")]
    prepared += [("nul", None, "web", "x"), ("empty", "", "web", "x"), ("e0", prepared[60][1], "phone", "x"), ("u", " ".join(base[0]), "web", "x"), (None, "a b", "web", "x")]
    want.add(("f0", "calibration"))
    parts = split_overlaps(spark.createDataFrame(manifest, M), spark.createDataFrame(prepared, P))
    got = {(r.id, r.split) for r in overlapping(*parts).collect()}
    assert got == want
    report = {(r.sample_split, r.submitted_via): r for r in overlap_report(*parts).collect()}
    assert report["validation", "phone"].n_overlapping == 10 and report["validation", None].n_complaints == 10
    assert report["calibration", "web"].n_overlapping == 1 and report["calibration", "web"].n_exact == 1


def test_very_many_copies_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    manifest = [(f"f{i}", "fit", "x") for i in range(200)] + [("e", "validation", "x"), ("l", "validation", "x")]
    prepared = [(f"f{i}", "the same text every time it comes" if i else long, "web", "x") for i in range(200)] + [("e", "The same text, every time it comes!", "web", "x"), ("l", long.replace("word77 ", "other "), "web", "x")]
    parts = split_overlaps(spark.createDataFrame(manifest, M), spark.createDataFrame(prepared, P))
    assert {(r.id, r.is_exact) for r in overlapping(*parts).collect()} == {("e", True), ("l", False)}


@pytest.mark.parametrize("n", [30, 3000])
def test_unseen_words_in_copies_at_growing_n(spark, n):
    # Common words weigh the less beside a word that occurs once, the more texts there are.
    rng = random.Random(n)
    base = [[rng.choice(VOCABULARY) for _ in range(rng.randrange(30, 90))] for _ in range(n)]
    manifest, prepared, want = [(f"f{i}", "fit", "x") for i in range(n)], [(f"f{i}", " ".join(t), "web", "x") for i, t in enumerate(base)], set()
    for i, t in enumerate(base[:30]):
        t = list(t)
        for k in sorted(rng.sample(range(len(t)), len(t) // 10), reverse=True):
            t[k : k + 1] = [[f"typo{i}x{k}"], [f"typo{i}x{k}", t[k]], []][i % 3]
        manifest.append((f"e{i}", "validation", "x")), prepared.append((f"e{i}", " ".join(t), "web", "x"))
        want.add((f"e{i}", "validation"))
    parts = split_overlaps(spark.createDataFrame(manifest, M), spark.createDataFrame(prepared, P))
    assert {(r.id, r.split) for r in overlapping(*parts).collect()} == want


@pytest.mark.parametrize("block_rows", [3])
def test_links_are_all_pairs_within_the_edits(spark, block_rows):
    # Heavily repeated words, edits of any kind, up to beyond the limit: the links are those of brute force.
    rng = random.Random(8)
    fit = [[rng.choice("abcdefgh") if rng.random() < 0.5 else rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 130))] for _ in range(60)]
    held = []
    for t in fit * 2:
        t = list(t)
        for _ in range(int(len(t) * rng.uniform(0, 0.25))):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = [rng.choice(["a", "new", f"u{rng.random()}"])] * rng.randrange(2)
        held.append(t)
    fit, held = ([t for t in {" ".join(t) for t in x}] for x in (fit, held))
    rows = [(f"f{i}", "fit", t) for i, t in enumerate(fit)] + [(f"e{i}", "calibration", t) for i, t in enumerate(held)]
    _, docs, links = split_overlaps(spark.createDataFrame([(i, s, "x") for i, s, _ in rows], M), spark.createDataFrame([(i, t, "web", "x") for i, _, t in rows], P), block_rows=block_rows)
    said = {r.doc: " ".join(words(r.words)) for r in docs.collect()}
    got = {(said[r.doc], said[r.other]) for r in links.collect()}
    h, f = ({" ".join(words(t)) for t in x} for x in (held, fit))
    assert got == {(a, b) for a in h for b in f if a != b and plain_edits(a.split(), b.split()) <= 0.1 * max(len(a.split()), len(b.split())) + 1e-9}
    assert len(got) > 50


def test_empty(spark):
    parts = split_overlaps(spark.createDataFrame([], M), spark.createDataFrame([("a", "b", "c", "d")], P))
    assert overlapping(*parts).count() == 0 and overlap_report(*parts).count() == 0
    assert words("A—b  'c-d' ...") == ["a", "b", "cd"]


@pytest.mark.parametrize(("size", "vocabulary", "changed"), [(30, 120, 1), (30, 120, 3), (50, 2000, 5)])
def test_up_to_one_word_in_ten_whatever_the_vocabulary(spark, size, vocabulary, changed):
    rng = random.Random(size + changed)
    said = [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(400 * size)]
    base = [said[i * size : (i + 1) * size] for i in range(400)]
    manifest, prepared = [(f"f{i}", "fit", "x") for i in range(400)], [(f"f{i}", " ".join(t), "web", "x") for i, t in enumerate(base)]
    for i, t in enumerate(base[:100]):
        t = list(t)
        for k in rng.sample(range(size), changed):
            t[k] = f"w{rng.randrange(vocabulary)}" if i % 2 else f"new{rng.random()}"
        manifest.append((f"e{i}", "validation", "x")), prepared.append((f"e{i}", " ".join(t), "web", "x"))
    parts = split_overlaps(spark.createDataFrame(manifest, M), spark.createDataFrame(prepared, P))
    assert {r.id for r in overlapping(*parts).collect()} >= {f"e{i}" for i in range(100)}
