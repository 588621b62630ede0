import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroledger.llm import jaccard
from aeroledger.llm.graph import components
from aeroledger.llm.jaccard import jaccard_components, keep_one, prefix_length

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(text, n, edits, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = text.split()
        for _ in range(r.randrange(edits + 1)):
            words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_equals_brute_force(spark, documents, sentences, rows, k, percent):
    base = sentences(12, 120)
    texts = [x for i, t in enumerate(base) for x in family(t, 12, 4, i)]
    passage = sentences(1, 60, seed=9)[0]
    texts += [f"{t} {passage}" for t in sentences(15, 20, seed=10)]  # one passage in many
    texts += [f"{passage} {i}" for i in range(12)] + ["one", "ONE", "two  words", "two words\n", "", None, " \t "]
    docs = list(enumerate(texts)) + [(500, texts[3] + " "), (None, texts[0]), (501, base[0] * 200), (3, texts[3])]
    found = jaccard_components(documents(*docs), k=k, percent=percent)
    assert found.count() == len(docs)
    got = rows(found)
    assert got[None]["component_id"] is None
    want = brute(docs, k, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == want
    kept = [r["doc_id"] for r in keep_one(documents(*docs), k=k, percent=percent).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})


def test_prefix_is_long_enough():
    for n in range(1, 200):
        assert prefix_length(n, 90) == n - -(-9 * n // 10) + 1 >= 1


def test_no_rows(spark, documents):
    assert jaccard_components(documents()).count() == 0
    assert [r["component_id"] for r in jaccard_components(documents((1, None), (2, ""))).orderBy("doc_id").collect()] == [1, 2]


def test_components_of_a_long_chain(spark):
    n = 40
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    found = dict(components(edges).collect())
    assert found == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100}


def test_one_row_of_each_group_stays(spark, documents, sentences):
    a, b, c, d = sentences(4, 60)
    docs = [(5, a), (5, a), (5, a + " more"), (6, a.upper()), (None, b), (None, b), (None, b + " more"), (None, None), (None, "")]
    docs += [(None, c), (9, c + " more"), (1, d), (1, sentences(1, 60, seed=5)[0]), (2, None), (2, None), (3, " ")]
    table = documents(*docs)
    kept = keep_one(table, k=5, percent=80)
    assert kept.columns == table.columns
    found = sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept.collect())
    want = [(5, a), (0, b), (0, ""), (0, ""), (9, c), (1, d), (1, docs[12][1]), (2, ""), (3, " ")]
    assert found == sorted((i, t[:9]) for i, t in want)


def test_no_round_tables_or_shuffles_are_left(spark, documents, sentences, tmp_path, monkeypatch):
    monkeypatch.setattr("aeroledger.workspace.shared_folder", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    texts = [x for i, t in enumerate(sentences(6, 80)) for x in family(t, 5, 3, i)]
    found = jaccard_components(documents(*enumerate(texts)))
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("aeroledger/*/*")}
    assert left <= {"jaccard-documents", "jaccard-distinct", "jaccard-near", "jaccard-pairs", "jaccard-contents", "jaccard-sets"}
    assert found.count() == 30
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_texts_reach_python_in_small_batches(spark, documents, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    joined = jaccard._joined
    monkeypatch.setattr(jaccard, "_joined", lambda *a: (seen.append(int(spark.conf.get(key))), joined(*a))[1])
    before = spark.conf.get(key)
    jaccard_components(documents((1, "a b c d"), (2, "a b c d")))
    assert seen and max(seen) <= 1000 and spark.conf.get(key) == before


def test_only_contents_of_listed_sets_are_joined(spark):
    names = [i.to_bytes(8, "little") + bytes(8) for i in range(1000)]
    contents = spark.createDataFrame([(bytearray(x), [i]) for i, x in enumerate(names)], "set binary, shingles array<bigint>")
    listed = spark.createDataFrame([(bytearray(x),) for x in names[::50] * 2], "set binary")
    got = {r["shingles"][0] for r in jaccard._listed(contents, listed, []).collect()}
    assert set(range(0, 1000, 50)) <= got and len(got) < 30
    assert jaccard._listed(contents, listed.limit(0), []).count() == 0
    assert jaccard._listed(contents.limit(0), listed, []).count() == 0


def test_a_passage_of_many_documents_is_no_candidate_where_rarer_ones_are(spark, documents):
    passage = " ".join(c * 30 for c in "abcdef")  # long, so it comes first but for its number
    texts = documents(*[(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(12)]).select(
        F.col("doc_id").alias("id"), "text")
    levels = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)  # as where so many shingles share a counter that none stands out
    hot = jaccard.hot_shingles(texts.select("text"), 3, 80, levels)

    def most(held):
        found = jaccard._described(texts, 3, 80, levels, held, "bigint").select(F.explode("prefix").alias("token"))
        return found.groupBy("token").count().agg(F.max("count")).first()[0]

    assert most(np.zeros_like(hot)) == 12 and most(hot) == 1
