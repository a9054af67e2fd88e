import random

import pytest

from tidemark.llm.leaks import Rule, _covered, _path, _places, _stretches, leaked_items

D = "doc_id long, text string, item_id string"
I = "item_id long, passage string, doc_id string"


def text(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def edited(ws):
    ws = list(ws)
    for i in range(5, len(ws), 12):
        ws[i] = "changed" if i % 2 else ws[i] + " added"
    return ws


def found(spark, docs, items, **how):
    got = leaked_items(spark.createDataFrame([(k, v if v is None else " ".join(v), "x") for k, v in docs], D), spark.createDataFrame([(k, v if v is None else " ".join(v), "x") for k, v in items], I), **how).toPandas()
    assert not got.duplicated(["doc_id", "item_id"]).any()
    return got


@pytest.mark.parametrize("small_rows", [1_000_000, 0])  # every task has all passages; a join on the q-gram
def test_quotes_edits_and_near_misses(spark, small_rows):
    rng = random.Random(0)
    items = [text(rng, 100) for _ in range(4)]
    noise = lambda n: text(rng, n)
    docs = {
        1: noise(50) + items[0] + noise(50),
        2: noise(20) + edited(items[0][10:70]) + noise(5),
        3: noise(30) + items[1][:26] + noise(40) + items[1][50:78] + noise(9),  # two stretches
        4: items[1][50:72] + noise(40) + items[1][:22],  # the wrong way round: neither order reaches the share
        5: items[2][:24],
        6: noise(4000) + items[3][40:95],
        7: [],
        8: noise(100),
        11: noise(9) + items[2][:39],  # a word short of the share
        12: noise(9) + items[2][:40],
    }
    rows = [*docs.items(), (9, None), (None, items[0]), (10, [w.upper() + "," for w in items[0]]), (1, docs[1])]
    given = [*enumerate(items), (7, None), (None, ["a", "b"]), (8, []), (9, items[0])]
    want = {(1, 0), (2, 0), (3, 1), (6, 3), (10, 0), (1, 9), (2, 9), (10, 9), (12, 2)}
    got = found(spark, rows, given, small_rows=small_rows)
    assert set(got[["doc_id", "item_id"]].itertuples(index=False, name=None)) == want
    two = got[(got.doc_id == 3) & (got.item_id == 1)].iloc[0]
    assert two.n_stretches == 2 and two.coverage == 0.54


@pytest.mark.parametrize("small_rows", [1_000_000, 0])
def test_short_passages(spark, small_rows):
    rng = random.Random(1)
    items, docs, want = [], [], set()
    for n in [*range(6, 41), 60]:
        ws, need = text(rng, n), -(-2 * n // 5)
        items.append((n, ws))
        a = rng.randrange(n - need + 1)
        docs.append((n, text(rng, 30) + ws[a : a + need] + text(rng, 30)))
        want.add((n, n))
        docs.append((100 + n, text(rng, 30) + ws[: need - 1] + text(rng, 30)))
        if need >= 6:
            half = need // 2
            docs.append((200 + n, ws[:half] + text(rng, 30) + ws[n - (need - half) :] + text(rng, 30)))
            want.add((200 + n, n))
    got = found(spark, docs, items, small_rows=small_rows)
    assert set(got[["doc_id", "item_id"]].itertuples(index=False, name=None)) == want


def test_edits_of_the_longest_words_and_stock_phrases(spark):
    # Edits at the lemma's expense: the longest words, spread evenly; and texts that share stock sentences with all passages.
    rng = random.Random(2)
    stock = [text(rng, 9) for _ in range(5)]
    items, docs, want = [], [], set()
    for k in range(30):
        ws = [w for s in stock[:3] for w in text(rng, 20) + s] + text(rng, 30)
        items.append((k, ws))
        part = ws[20:70]
        for i in range(4, 50, 11):
            part[i] = ["notthere", part[i] + "x", ""][k % 3]
        docs.append((k, text(rng, 40) + [w for w in part if w] + stock[4]))
        want.add((k, k))
        docs.append((100 + k, [w for s in stock for w in s + text(rng, 12)]))
    got = found(spark, docs, items)
    assert set(got[["doc_id", "item_id"]].itertuples(index=False, name=None)) == want


def test_bound_against_all_stretches():
    rng = random.Random(3)
    for n in (6, 12, 25, 39, 80):
        rule = Rule(0.4, 10, 3)
        q, least = rule.choose(n)
        for _ in range(200):
            need = rule.need(n)
            first = rng.randrange(3, need - 2) if need >= 6 and rng.random() < 0.5 else need
            whole = list(range(n))
            a = rng.randrange(0, n - need + 1)
            b = rng.randrange(a + first, n - (need - first) + 1)
            kept = set()
            for lo, hi in ((a, a + first), (b, b + need - first)):
                held = whole[lo:hi]
                for _ in range((hi - lo) // 10):
                    held[rng.randrange(1, hi - lo - 1)] = -rng.random()
                kept |= {i for i, w in enumerate(held[: len(held) - q + 1], lo) if all(x == i + k for k, x in enumerate(held[i - lo : i - lo + q]))}
            assert len(kept) >= least


def test_empty(spark):
    assert not len(found(spark, [], [(1, list("abc"))])) and not len(found(spark, [(1, list("abc"))], []))


def test_alignment_and_cover():
    item = list("abcdefghij")
    assert _path(item, _places(list("xxabcdefghijyy")), 0, 10, 0, 3) == [(i, i + 2) for i in range(10)]
    assert _path(item, _places(list("abcdXefghij")), 0, 10, 0, 3) == [(i, i + (i > 3)) for i in range(10)]
    assert _path(item, _places(list("abcdeghij")), 0, 10, -3, 3) == [(i, i - (i > 5)) for i in range(10) if i != 5]
    assert _stretches([(i, i + (i > 3)) for i in range(10)], 10, 3) == [(0, 10, 0, 11)]
    assert set(_stretches([(i, i + (i > 3)) for i in range(9)], 10, 3)) == {(4, 9, 5, 10), (0, 4, 0, 4)}
    assert _covered([(0, 4, 10, 14), (4, 9, 20, 25), (6, 9, 0, 3)]) == (9, 2)
    assert _covered([]) == (0, 1)
