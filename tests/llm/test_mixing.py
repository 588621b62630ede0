import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from aeroledger.llm import mixing
from aeroledger.llm.mixing import BLOCK_WORDS, MOST_BLOCKS, _permutation, _plan, block_size, fill_targets, mix_sources, shard_rows, split_blocks


def test_targets():
    assert fill_targets([100, 100, 100], [5, 2, 1], Fraction(450)) == [200, Fraction(500, 3), Fraction(250, 3)]
    assert fill_targets([1, 1000], [5, 2], Fraction(1501)) == [2, 1499]
    assert fill_targets([0, 0], [5, 2], Fraction(0)) == [0, 0]


def test_split_uses_every_block_once():
    counts = np.array([0, 7, 1000, 33])
    out = split_blocks(counts, 13, 1)
    assert out.sum(axis=1).tolist() == counts.tolist() and out.min() >= 0
    size = out.sum(axis=0)
    assert size.max() - size.min() <= 4
    assert (split_blocks(counts, 13, 1) == out).all()


def test_permutations():
    for n in (1, 2, 3, 10, 64, 997):
        a, b = _permutation(n, f"k{n}")
        assert sorted((a * j + b) % n for j in range(n)) == list(range(n))


def test_mix(spark, documents, sentences):
    docs = [(i, " ".join(sentences(1, 1 + i % 50, seed=i)), None, ("a", "b", "c", "", None)[min(i % 11, 4)]) for i in range(300)]
    docs += [(400, None, None, "a"), (401, " \x0b\n", None, "empty"), (None, "one  two\tthree", None, "b"), (7, docs[7][1], None, docs[7][3])]
    docs += [(500, "word " * 20_000, None, "long")]
    mix = mix_sources(documents(*docs), block_words=64, shards=8)
    found = mix.collect()
    assert len(found) == len(docs)
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = Counter()
    for _, text, _, source in docs:
        want[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sizes == want and {r["source"]: r["source_size"] for r in found} == dict(want)
    names = sorted((s for s in want if s is not None)) + [None]
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    assert [target[s] for s in names] == [float(t) for t in fill_targets([want[s] for s in names], weights, Fraction(3, 2) * sum(want.values()))]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    spans = defaultdict(list)
    for r in shard_rows(mix).collect():
        assert 0 <= r["shard"] < 8
        if r["doc_id"] not in (None, 7):  # ids of one row
            spans[r["doc_id"], r["epoch"]].append((r["word_from"], r["word_to"]))
    for parts in spans.values():  # slices of an epoch are disjoint
        parts.sort()
        assert all(a < b for a, b in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
    again = mix_sources(documents(*docs).repartition(7), block_words=64, shards=8).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_empty(spark, documents):
    assert mix_sources(documents()).count() == 0
    assert [r["taken"] for r in mix_sources(documents((1, None))).collect()] == [0]


def test_blocks_grow_with_the_corpus():
    assert block_size([1000, 10**9], 2) == BLOCK_WORDS and block_size([], 2) == BLOCK_WORDS
    sizes = [6 * 10**12, 3 * 10**12, 7, 0, 10**13]  # 100 TB of text
    words = block_size(sizes, 2)
    assert sum(2 * -(-size // words) for size in sizes) <= MOST_BLOCKS
    stats = [{"source": str(i), "n": 10, "size": size} for i, size in enumerate(sizes)]
    rows = _plan(stats, (5, 2, 1), Fraction(3, 2), 2, 64, words, 17)
    for r in rows:
        assert sum(e["quota"] for e in r[6]) == round(Fraction(r[5])) or r[5] > 2**53
        assert all(e["a"] * e["n"] < 2**62 and e["ends"] == sorted(e["ends"]) for e in r[6])


def plain_mix(docs, rows, words):
    """Words taken of each document and shard, word by word: streams of sources, cut into blocks, dealt by the plan."""
    taken = Counter()
    for source, _, _, buckets, _, _, epochs in rows:
        own = sorted((d for d in docs if d[1] == source), key=lambda d: (d[3] % buckets, d[3], d[0], d[2]))
        stream = [i for i, _, size, _ in own for _ in range(size)]
        for e in epochs:
            left = e["quota"]
            blocks = [stream[j:j + words] for j in range(0, len(stream), words)]
            for rank, j in sorted(((e["a"] * j + e["b"]) % e["n"], j) for j in range(len(blocks))):
                shard = sum(end <= rank for end in e["ends"])
                for i in blocks[j][:left]:
                    taken[i, shard] += 1
                left -= len(blocks[j][:left])
    return taken


def test_equals_a_plain_version(spark, documents, sentences, monkeypatch):
    texts = [" ".join(sentences(1, 1 + i * 7 % 90, seed=i)) for i in range(120)] + ["word " * 900]
    table = documents(*[(i, t, None, "abcd"[min(i % 9, 3)]) for i, t in enumerate(texts)])
    place = table.selectExpr("doc_id", "source", "xxhash64(17, doc_id) AS place").collect()
    docs = [(r["doc_id"], r["source"], len(texts[r["doc_id"]].split()), r["place"]) for r in place]
    stats = [{"source": s, "n": sum(d[1] == s for d in docs), "size": sum(d[2] for d in docs if d[1] == s)} for s in "abcd"]
    want = plain_mix(docs, _plan(stats, (5, 2, 1), Fraction(3, 2), 2, 6, 32, 17), 32)
    for sent in (mixing.MOST_SENT, 0):  # a plan that is broadcast, and one that is a table
        monkeypatch.setattr(mixing, "MOST_SENT", sent)
        mix = mix_sources(table, block_words=32, shards=6)
        found = Counter()
        for r in shard_rows(mix).collect():
            found[r["doc_id"], r["shard"]] += r["word_to"] - r["word_from"]
        assert found == want
        assert sum(r["taken"] for r in mix.collect()) == sum(want.values())
