import random

import numpy as np

from aeroledger.llm.decontaminate import ItemIndex, _hashes, drop_leaks, find_leaks, shingle_texts, words_of

ITEMS = "item_id bigint, text string, score double"


def brute(docs, items):
    found = {}
    for i, item in items:
        wanted = shingle_texts(words_of(item))
        for d, text in docs:
            n = len(wanted & shingle_texts(words_of(text)))
            if wanted and n >= 0.8 * len(wanted) - 1e-9:
                found[d, i] = (len(wanted), n)
    return found


def test_equals_brute_force(spark, documents, sentences):
    texts, asked = sentences(30, 300), sentences(6, 30, seed=2)
    words = asked[0].split()
    near = " ".join(["other", *words[1:-1], "other"])  # 24 of 26 shingles
    far = " ".join(w if i % 6 else "other" for i, w in enumerate(words))
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [
        (100, f"{texts[0]} {asked[0].upper()}! {texts[1]}"), (101, f"{texts[2]} {near} {texts[3]}"), (102, far), (103, asked[1]),
        (103, asked[1]), (104, None), (105, ""), (106, "two words"), (None, asked[2]), (107, " ".join(asked[3:5])),
    ]
    items = [*enumerate(asked), (50, "Two, words."), (51, None), (52, "..."), (0, asked[0])]
    table = spark.createDataFrame([(*i, 1.0) for i in items], ITEMS)
    got = [r.asDict() for r in find_leaks(documents(*docs), table, block_chars=400).collect()]
    assert {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in got} == brute(docs, items)
    assert sum(r["doc_id"] == 103 for r in got) == 2 and len(got) == len(brute(docs, items)) + 1
    kept = [r["doc_id"] for r in drop_leaks(documents(*docs), table).collect()]
    assert sorted(kept) == [*range(30), 102, 104, 105]


def test_short_items_are_found_in_long_documents():
    random.seed(3)
    item = [f"w{random.randrange(10**6)}" for _ in range(14)]
    missed = 0
    for n in (100, 3000, 20_000):
        for _ in range(10):
            words = [f"v{random.randrange(10**6)}" for _ in range(n)]
            words[n // 2:n // 2] = item[:12]  # 8 of its 10 shingles
            missed += 0 not in ItemIndex([(0, " ".join(item))]).candidates(_hashes(words))
    assert missed == 0


def test_items_of_few_shingles_are_found_in_long_documents(spark, documents):
    random.seed(5)
    docs = [(n, " ".join(f"v{random.randrange(10**6)}" for _ in range(size))) for n, size in enumerate((1029, 2052, 20_000))]
    items = []
    for _, text in docs:
        words = text.split()
        for length in (5, 6, 8, 12, 13):
            for at in random.sample(range(len(words) - length), 100 if length == 5 else 15):
                item = words[at:at + length]
                items.append((len(items), " ".join(item if length < 9 else [*item[:-1], "other"])))
    short = [" ".join(docs[0][1].split()[:3]), "not there at all anywhere"]
    items += list(enumerate(short, len(items)))
    index = ItemIndex(items)
    sets = [(d, set(_hashes(words_of(t)).tolist())) for d, t in docs]
    missed = {(d, i) for d, found in sets for i, s in enumerate(index.sets)
              if len(found.intersection(s.tolist())) >= 0.8 * len(s)} - {
        (d, int(i)) for d, t in docs for i in index.candidates(_hashes(words_of(t)))}
    assert not missed, len(missed)
    few = [i for i in items if len(i[1].split()) < 13][::7]
    got = find_leaks(documents(*docs), spark.createDataFrame([(*i, 1.0) for i in few], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in got} == brute(docs, few)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert find_leaks(documents((1, "a b c d e f")), none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f", 0.0)], ITEMS)
    assert find_leaks(documents(), one).count() == 0
    assert len(_hashes([])) == 0 and isinstance(_hashes(["a"]), np.ndarray)
