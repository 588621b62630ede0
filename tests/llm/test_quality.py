import numpy as np
import pytest

from aeroledger.llm import quality
from aeroledger.llm.quality import N_FEATURES, QualityModel, pooled, score_quality, tokens, train


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, score double")


def test_learns_and_holds_out(spark, documents, sentences, rows):
    good, bad = sentences(200, 30), [t.replace(" ", " ### ") for t in sentences(200, 30, seed=5)]
    docs = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (901, ""), (None, good[0]), (902, good[1] * 400)]
    known = labels(spark, [(i, int(i < 200), 0, 1.0) for i in range(0, 400, 2)] + [(0, 1, 0, None), (2, None, 0, 0.0), (None, 1, 0, 0.0)])
    scored = score_quality(documents(*docs), known)
    assert scored.count() == len(docs)
    got = rows(scored)
    right = [(got[i]["score"] >= 0.5) == (i < 200) for i in range(1, 400, 2)]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("marked, score", [([], 0.5), ([(1, 1, 0, 0.0)], 1.0)])
def test_without_both_labels(spark, documents, marked, score):
    found = score_quality(documents((1, "a b"), (2, None)), labels(spark, marked)).collect()
    assert [r["score"] for r in found] == [score] * 2


def test_empty_table(spark, documents):
    assert score_quality(documents(), labels(spark, [(1, 1, 0, 0.0)])).count() == 0


def test_tokens_do_not_cross_texts():
    data = np.frombuffer(b"ab ab12ab", np.uint8)
    word, row = tokens(data, np.array([0, 4, 9]))
    assert row.tolist() == [0, 0, 1, 1, 1] and len(set(word.tolist())) == 4
    assert pooled(np.zeros((8192, 32), np.float32), data, np.array([0, 0, 9])).shape == (2, N_FEATURES)


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 5))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = train(x, y)
    p = model.scores(x)
    for low in (0.1, 0.4, 0.7):
        here = (p >= low) & (p < low + 0.2)
        assert abs(p[here].mean() - y[here].mean()) < 0.1
    assert isinstance(model, QualityModel) and train(x, y).scores(x).tolist() == p.tolist()


def test_copies_are_sampled_in_proportion(spark, documents, sentences, monkeypatch):
    monkeypatch.setattr(quality, "MOST_TRAINING", 300)
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((x, y)) or train(x, y))
    copied, others = sentences(6, 30, seed=9), sentences(600, 30)
    docs = [*enumerate(others), *((1000 + i, copied[i % 6]) for i in range(600))]
    score_quality(documents(*docs), labels(spark, [(i, i % 2, 0, 0.0) for i, _ in docs]))
    _, copies = np.unique(seen[0][0], axis=0, return_counts=True)
    # A quarter of 100 copies of each of six texts; all or none of a group before.
    assert len(seen[0][0]) == 300 and all(5 < n < 60 for n in sorted(copies)[-6:]) and (copies > 1).sum() == 6


def test_rounds_do_not_depend_on_the_number_of_rows(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 200)
    rounds, split = [], np.array_split
    monkeypatch.setattr(np, "array_split", lambda *a: rounds.append(1) or split(*a))
    for n in (100, 20_000):
        rounds.clear()
        train(np.random.default_rng(1).normal(size=(n, 2)), np.arange(n) % 3 % 2)
        assert len(rounds) == 200
