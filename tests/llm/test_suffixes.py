import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from aeroledger.llm import induced_sort, suffix_dedup
from aeroledger.llm.induced_sort import sort_suffixes, sorted_with_prefixes
from aeroledger.llm.suffix_dedup import LENGTH, merged, remove_repeats


def strings(n):
    r = random.Random(n)
    for _ in range(n):
        text = [r.randint(1, r.choice([2, 3, 50])) for _ in range(r.randint(2, 150))]
        yield np.array(text + text[:r.randint(0, 60)] + [1] * r.randint(0, 9) + text[5:40] + [0], np.uint16)


@pytest.fixture(params=[None, 3])
def pieces(request, monkeypatch):
    """Batches and pieces as they are, or so small that every string takes many."""
    if request.param:
        monkeypatch.setattr(induced_sort, "BATCH", request.param)
        monkeypatch.setattr(induced_sort, "NAMED_AT_ONCE", request.param)


@pytest.mark.parametrize("limit, base", [(5, 1), (64, 3), (1 << 20, 1 << 20)])
def test_suffixes_are_sorted_whatever_is_held_in_memory(limit, base, pieces):
    for text in strings(25):
        t = text.tolist()
        with tempfile.TemporaryDirectory() as folder:
            assert sort_suffixes(text, 10**9, folder, 0, limit, base).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("cap, limit, base", [(4, 5, 1), (100, 64, 2), (100, 1 << 20, 1 << 20)])
def test_common_prefixes(cap, limit, base, pieces):
    for text in strings(25):
        t = text.tolist()
        with tempfile.TemporaryDirectory() as folder:
            found = [x for p, c in sorted_with_prefixes(text, cap, folder, limit, base) for x in zip(p.tolist(), c.tolist())]
        for (p, _), (q, n) in zip(found, found[1:]):
            assert t[p:p + cap] >= t[q:q + cap]
            common = next((i for i in range(cap) if t[p + i:p + i + 1] != t[q + i:q + i + 1] or not t[p + i:]), cap)
            assert n == common


def brute(docs):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - LENGTH + 1):
            w = raw[s:s + LENGTH]
            if w in seen:
                gone[s:s + LENGTH] = b"1" * LENGTH
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(map(bool, gone)), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def texts(sentences):
    s = sentences(40, 60)
    r = random.Random(3)
    docs = [(i, t) for i, t in enumerate(s)]
    docs += [(100 + i, f"{s[i][:200]} é {s[2 * i]}{s[i + 1][37:300]}") for i in range(15)]
    docs += [(200 + i, f"{i} {s[0][:120]}{r.random()}") for i in range(30)]  # one passage in many
    docs += [(300, "a" * 700), (301, "ab" * 300), (302, "x" * 99), (303, s[0][:100]), (304, None), (305, ""), (306, s[5] * 3), (None, s[7])]
    return docs


def test_equals_brute_force(spark, documents, sentences, rows):
    docs = texts(sentences)
    got = rows(remove_repeats(documents(*docs).repartition(6)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == brute(docs)


def test_crowded_anchors_and_long_texts_are_split(spark, documents, sentences, rows, monkeypatch):
    for name, value in (("CROWDED", 3), ("SHARD_BYTES", 5000)):  # used on the driver
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = texts(sentences)
    got = rows(remove_repeats(documents(*docs)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == brute(docs)


def test_a_text_longer_than_a_piece(spark, documents):
    r = random.Random(8)
    block = "".join(r.choices("abcdefgh ", k=300_000))
    found = remove_repeats(documents((1, block + block))).collect()
    assert found[0]["n_removed"] == 300_000 and bytes(found[0]["kept"]).decode() == block


def test_repeated_rows_are_one_document(spark, documents, sentences):
    text = sentences(1, 60)[0]
    found = remove_repeats(documents((1, text), (1, text), (2, text))).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in found] == [0, 0, len(text)]
    assert remove_repeats(documents()).count() == 0


def test_spans_that_touch_are_one():
    assert [x.tolist() for x in merged(np.array([5, 0, 30, 10]), np.array([10, 4, 40, 12]))] == [[0, 5, 30], [4, 12, 40]]


def test_a_window_is_found_wherever_its_anchor_lies(spark, documents, rows):
    r = random.Random(11)
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    windows = [noise(LENGTH) for _ in range(120)]
    docs = [(2 * i + j, noise(r.randint(0, 90)) + w + noise(r.randint(0, 90))) for i, w in enumerate(windows) for j in (0, 1)]
    got = rows(remove_repeats(documents(*docs)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == brute(docs)
    assert all(got[2 * i + 1]["n_removed"] >= LENGTH for i in range(len(windows)))


def test_only_windows_that_another_class_may_have_are_sorted(monkeypatch, tmp_path):
    """Of three classes with one anchor, two share it and the 60 bytes after it, and the third only 20 of them."""
    r = random.Random(12)
    noise = lambda n: bytes(r.choices(range(97, 122), k=n))
    anchor, after = noise(suffix_dedup.GRAM), noise(60)
    common = noise(16) + anchor + after  # one window
    raw = [noise(40) + common, noise(40) + common, noise(56) + anchor + after[:20] + noise(40)]
    n = len(raw)
    batch = pa.RecordBatch.from_arrays(
        [*[pa.array(v, pa.int64()) for v in (range(n), [0] * n, [7] * n, [41] * n, [0] * n, [56] * n)], pa.array(raw, pa.binary())],
        ["doc", "tie", "first", "windows", "skipped", "offset", "bytes"])
    sorted_texts = []
    real = suffix_dedup.sorted_with_prefixes
    monkeypatch.setattr(suffix_dedup, "sorted_with_prefixes", lambda text, *rest: sorted_texts.append(len(text)) or real(text, *rest))
    found = [row for out in suffix_dedup._sorted_shard([batch, batch.slice(0, 0)], str(tmp_path)) for row in out.to_pylist()]
    assert found == [{"doc": 1, "tie": 0, "again": [7 + 40]}]
    assert 2 * (LENGTH + 1) < sorted_texts[0] < 2 * (len(raw[0]) + 1)
    assert list(suffix_dedup._sorted_shard([batch.slice(1)], str(tmp_path))) == [] and len(sorted_texts) == 1


def test_texts_pass_python_in_small_batches(spark, documents, sentences, rows, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    earliest = suffix_dedup.earliest_places
    monkeypatch.setattr(suffix_dedup, "earliest_places", lambda *a: (seen.append(int(spark.conf.get(key))), earliest(*a))[1])
    texts = sentences(7)
    docs = documents(*[(i, f"{t} {texts[0]}") for i, t in enumerate(texts)], (90, None), (91, texts[3])).coalesce(1)
    whole = rows(remove_repeats(docs))
    monkeypatch.setattr(suffix_dedup, "BATCH_ROWS", 2)
    before = spark.conf.get(key)
    assert rows(remove_repeats(docs)) == whole and whole[91]["n_removed"] > 0
    assert max(seen) <= 1000 and spark.conf.get(key) == before
