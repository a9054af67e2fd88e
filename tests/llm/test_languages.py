import itertools

import numpy as np
import pytest

from tidemark.llm.languages import _ranks, document_languages, fit_profiles, mislabelled, segments, sentences, stretches

D = "doc_id long, text string, lang string, label string, seg_no int"
EN = ["The letter from the bank was never answered and nobody called me back about it.", "I asked for a written copy of the contract several times during the winter.", "They told me that the refund would arrive within ten days but nothing has happened.", "Please correct the account and return the money that was taken without my consent."]
ES = ["La carta del banco nunca fue respondida y nadie me devolvió la llamada sobre el asunto.", "Pedí una copia escrita del contrato varias veces durante el invierno pasado.", "Me dijeron que el reembolso llegaría dentro de diez días pero todavía espero una respuesta.", "Por favor corrijan la cuenta y devuelvan el dinero que cobraron sin mi permiso."]
DE = ["Der Brief der Bank wurde nie beantwortet und niemand hat mich deswegen zurückgerufen.", "Ich habe im Winter mehrmals um eine schriftliche Kopie des Vertrags gebeten.", "Man sagte mir, dass die Erstattung innerhalb von zehn Tagen kommt, aber nichts ist passiert.", "Bitte korrigieren Sie das Konto und zahlen Sie das Geld zurück, das ohne meine Erlaubnis abgebucht wurde."]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, i = [], 0
    for lang, said in (("en", EN), ("es", ES), ("de", DE)):
        for order in itertools.permutations(said, 3):
            rows.append((i, " ".join(order), lang, "x", 1))
            i += 1
    return spark.createDataFrame(rows, D)


def test_stretches_and_labels(spark, corpus):
    profiles = fit_profiles(corpus)
    rows = [
        (1, " ".join(EN), "en-US", "x", 1),
        (2, " ".join(ES), "EN", "x", 1),
        (3, " ".join(EN[:2] + ES[:3] + DE[:2]), "en", "x", 1),
        (4, " ".join(DE), None, "x", 1),
        (5, " ".join(EN[:2] + ES[:1] + EN[2:]), "en", "x", 1),  # one foreign sentence is no stretch
        (6, "12-34 | $5.00 | 01.02.2024\n56-78 | $6.00", "en", "x", 1),
        (7, None, "en", "x", 1),
        (8, "", None, "x", 1),
        (9, " ".join(w.rstrip(".") for w in ES * 6), "", "x", 1),
        (10, " ".join(EN) * 400, "en", "x", 1),
        (None, " ".join(ES), "en", "x", 1),
    ]
    got = segments(spark.createDataFrame(rows, D), profiles=profiles)
    found = sorted((r.doc_id, r.seg_no, r.lang) for r in mislabelled(got).collect())
    assert found == [(2, 1, "es"), (3, 1, "en"), (3, 2, "es"), (3, 3, "de"), (4, 1, "de"), (9, 1, "es")]
    assert all(0 < r.confidence <= 1 for r in got.collect())
    one = {r.doc_id: r for r in document_languages(got).collect()}
    assert one[1].label_holds and one[3].n_languages == 3 and not one[2].label_holds and set(one) == {1, 2, 3, 4, 5, 9, 10}


def test_scripts_and_languages_of_the_labels(spark, corpus):
    zh = ["银行的信从来没有得到回复。", "我在冬天多次要求提供合同的书面副本。", "他们告诉我退款会在十天内到账！", "请更正账户并退还未经我同意扣除的款项。"]
    el = "Η επιστολή της τράπεζας δεν απαντήθηκε ποτέ. Ζήτησα αντίγραφο του συμβολαίου πολλές φορές. Μου είπαν ότι τα χρήματα θα έρθουν."
    assert len(sentences("".join(zh))) == 4
    rows = [(1, "".join(zh), None, "x", 1), (2, el, "en", "x", 1), (3, " ".join(EN[:2]) + " " + "".join(zh), "en", "x", 1)]
    got = segments(spark.createDataFrame(rows, D), profiles=fit_profiles(corpus))
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in got.collect()) == [(1, 1, "und"), (2, 1, "und"), (3, 1, "en"), (3, 2, "und")]
    labelled = corpus.unionByName(spark.createDataFrame([(1000 + i, "".join(p), "zh-CN", "x", 1) for i, p in enumerate(itertools.permutations(zh, 3))], D))
    profiles = fit_profiles(labelled)
    assert profiles.languages == ("de", "en", "es", "zh")
    got = segments(spark.createDataFrame(rows, D), profiles=profiles)
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in got.collect()) == [(1, 1, "zh"), (2, 1, "und"), (3, 1, "en"), (3, 2, "zh")]


def test_ranks_by_counting_and_by_sorting():
    rng = np.random.default_rng(1)
    text, count = np.repeat(np.arange(30), 20), rng.integers(1, 9, 600)
    assert np.allclose(_ranks(text, count, 30), _ranks(text, count, 1 << 23))


def test_empty(spark, corpus):
    assert segments(corpus.limit(0)).count() == 0


def test_cheapest_division_against_all_divisions():
    rng = np.random.default_rng(0)
    for n in (4, 5, 6, 7):
        for _ in range(10):
            cost = rng.random((n, 3))
            got = stretches(cost, 0.4)
            price = sum(cost[i:j, lang].sum() for i, j, lang in got) + 0.4 * (len(got) - 1)

            def best(at, last):
                if at == n:
                    return 0.0
                return min(cost[at:to, k].sum() + (0.4 if at else 0) + best(to, k) for to in range(at + 2, n + 1) if n - to != 1 for k in range(3) if k != last)

            assert price <= best(0, -1) + 1e-9


def test_sentences():
    assert sentences("The firm Inc. answered late again. It was Mr. nobody there today! Was it?") == ["The firm Inc. answered late again. ", "It was Mr. nobody there today! Was it?"]
    assert sentences("") == [] and sentences("... 12 34") == [] and len(sentences("several words that go on without any end " * 10)) > 1
