import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aeroledger.llm import lexical
from aeroledger.llm.lexical import ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(documents, items, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    docs = [(i, Counter(t), len(t)) for i, t in ((i, terms(text)) for i, text in documents) if t]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda s: s[:2] + ((s[2],) if s[2] is not None else ()))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(scored[:k], 1)]
    return out


@pytest.fixture
def tables(spark, documents):
    def make(texts, items):
        asked = spark.createDataFrame(items, "item_id string, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
        return documents(*texts), asked

    return make


def compare(tables, texts, items, k=20, **options):
    found = ranked_search(*tables(texts, items), k=k, **options).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in found), key=key) == sorted(brute_force(texts, items, k), key=key)


@pytest.mark.parametrize("short_list", [4, 64, 10**6])
def test_equals_scoring_everything(tables, monkeypatch, short_list):
    # With few lists read whole at once, most documents are only bounded for some levels.
    monkeypatch.setattr(lexical, "SHORT_LIST", short_list)
    r = random.Random(short_list)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [(i, " ".join(r.choices(words, weights, k=r.choice([3, 20, 200])))) for i in range(400)]
    items = [(f"i{j}", " ".join(r.choices(words, weights, k=12))) for j in range(12)]
    compare(tables, texts, items, k=7)


def test_ties_go_to_smaller_ids_and_nulls_last(tables):
    texts = [(i, "same words here") for i in (9, 3, None, 5, 1)] + [(2, "other")]
    compare(tables, texts, [("a", "same"), ("b", "words WORDS words")], k=3)
    found = ranked_search(*tables(texts, [("a", "same")]), k=10).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [1, 3, 5, 9, None]


def test_defined_cases(tables):
    texts = [(1, None), (2, ""), (3, "... !!"), (4, "Énigme ÉNIGME énigme"), (5, "a-b_c9 " * 3000), (5, "b"), (6, "b")]
    items = [(None, "b"), ("x", None), ("y", "?!"), ("z", "énigme Énigme"), ("z", "c9 nowhere"), ("v", "nowhere")]
    compare(tables, texts, items)


def test_empty_tables(tables):
    assert ranked_search(*tables([], [("a", "b")])).collect() == []
    assert ranked_search(*tables([(1, "b")], [])).collect() == []
    assert ranked_search(*tables([(1, None)], [("a", "b")])).collect() == []


def test_items_in_groups_give_the_same(tables):
    texts = [(i, f"alpha beta{i % 7} gamma{i % 3}") for i in range(60)]
    items = [(f"i{j}", f"alpha beta{j} gamma{j % 3}") for j in range(9)]
    compare(tables, texts, items, k=4, item_chars=40)


def test_only_what_can_still_matter_is_held(tables, monkeypatch):
    held, original = [], lexical.write_table

    def noted(df, name, **options):
        table, path = original(df, name, **options)
        if name == "intervals":
            held.append(sum(len(r["items"]) for r in table.collect()))
        return table, path

    monkeypatch.setattr(lexical, "write_table", noted)
    texts = [(i, "common " * (i % 5) + f"filler{i} more{i} words{i}") for i in range(3000)]
    texts += [(5000 + i, f"common rare{i % 2} gem{i % 2}") for i in range(40)]
    compare(tables, texts, [("a", "common rare0 gem0"), ("b", "common rare1 gem1")], k=5)
    assert 10 <= max(held) <= 40


def test_levels_are_read_until_all_is_settled(tables, monkeypatch):
    depths, original = [], lexical._hold
    monkeypatch.setattr(lexical, "_hold", lambda rows, bounds, depth: depths.append(depth) or original(rows, bounds, depth))
    texts = [(i, " ".join(["a"] * (1 + i % 9) + ["b"] * (i % 4) + ["c"] * (i % 3) + ["d"] * (i % 50))) for i in range(600)]
    compare(tables, texts, [("x", "a b c"), ("y", "b c d d")], k=3)
    assert len(depths) > 2 and depths[:-1] == sorted(depths[:-1], reverse=True)
