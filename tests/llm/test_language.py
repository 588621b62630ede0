from collections import Counter

import pytest

from aeroledger.llm import language
from aeroledger.llm.language import SAMPLE, _sample, fit, predict

EN, DE = "the of and ing tion that with this was from".split(), "der die und ung heit mit ist nicht auch schon".split()


def corpus(n, seed=1):
    import random

    r = random.Random(seed)
    return [(i, " ".join(r.choices(EN if i % 2 else DE, k=20)) + ".", "en" if i % 2 else "de") for i in range(n)]


def test_learns_and_predicts(spark, documents, rows):
    model = fit(documents(*corpus(200), (1000, None, "en"), (1001, "", "de"), (1002, "text", None)))
    assert model.languages == ["de", "en"]
    new = corpus(100, seed=2)
    extra = [(200, None), (201, ""), (202, "12 34 !?"), (203, "²½"), (None, new[1][1]), (204, new[1][1] * 2000), (204, new[1][1])]
    found = predict(documents(*new, *extra), model)
    assert found.count() == 107
    got = rows(found)
    assert all(got[i]["lang_pred"] == lang and got[i]["lang_score"] > 0.5 for i, _, lang in new)
    assert all((got[i]["lang_pred"], got[i]["lang_score"]) == ("und", 0.0) for i in (200, 201, 202, 203))
    assert got[204]["lang_pred"] == got[None]["lang_pred"] == "en" and got[5]["lang"] == "en"


def test_nothing_to_learn(spark, documents):
    assert fit(documents()) is None
    assert fit(documents((1, "text", None))) is None
    assert [r["lang_pred"] for r in predict(documents((1, "text")), None).collect()] == ["und"]
    one = fit(documents((1, "text here", "en"), (2, "text here", "en")))
    assert [(r["lang_pred"], r["lang_score"]) for r in predict(documents((1, "was")), one).collect()] == [("en", 1.0)]
    assert predict(documents(), one).count() == 0 and SAMPLE >= 1000


def test_copies_do_not_thin_the_sample(spark, documents):
    few = [(i, f"wort {i} nicht auch", "de") for i in range(20)] + [(i, "der die und", "de") for i in range(100, 30_100)]
    many = [(i, f"word {i} and was", "en") for i in range(SAMPLE + 200)] + [(i, "the of and", "en") for i in range(9000)]
    packed, names = _sample(documents(*few, *many))
    assert Counter(names) == {"de": 21, "en": SAMPLE} and len(packed) == len(names)


def test_every_language_has_a_landmark(spark, documents, monkeypatch):
    monkeypatch.setattr(language, "LANDMARKS", 1)
    words = {"a": "the of and was", "b": "και του της που", "c": "что это как его", "d": "այդ մեր նրա են"}
    docs = [(i, f"{text} {text.split()[i % 4]}", lang) for lang, text in words.items() for i in range(4)]
    found = predict(documents(*docs), fit(documents(*docs))).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_more_languages_than_the_bound_are_refused(spark, documents, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    assert fit(documents((1, "one", "a"), (2, "two", "b"))).languages == ["a", "b"]
    with pytest.raises(ValueError):
        fit(documents((1, "one", "a"), (2, "two", "b"), (3, "three", "c")))


def test_columns_of_the_same_names_are_replaced(spark, documents):
    model = fit(documents(*corpus(100)))
    table = documents((1, "the of and was", "en"), (2, None)).selectExpr("*", "'old' AS lang_pred", "9 AS LANG_SCORE")
    found = predict(table, model)
    assert [c.lower() for c in found.columns].count("lang_pred") == 1 and found.columns[-2:] == ["lang_pred", "lang_score"]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in found.collect()) == [(1, "en"), (2, "und")]
