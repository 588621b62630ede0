import math

import pytest

from aeroledger.llm.topk import exact_topk

SCHEMA = "vec_id bigint, embedding array<float>, score double, rank int, query int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2, 3) for i, v in rows], SCHEMA)


def brute(queries, rows, k):
    def parts(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    whole = [(i, p) for i, v in rows if i is not None and (p := parts(v)) is not None]
    out = []
    for i, q in {(i, tuple(p)) for i, v in queries if i is not None and (p := parts(v)) is not None}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_equals_brute_force(spark, bins):
    import random

    r = random.Random(1)
    rows = [(i, [float(r.choice([-1, -0.5, 0, 0.25, 1])) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(40)]  # one common vector
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [1.0, 2.0]), (304, []), (None, rows[0][1]), (20, rows[20][1])]
    rows += [(305, [float("inf")] * 6), (306, [0.5, 0.5])]
    asked = [x for x in rows if x[0] is None or x[0] % 10 == 0] + [(303, [1.0, 2.0]), (10, rows[10][1])]
    found = exact_topk(table(spark, rows).repartition(5), table(spark, asked), 5, bins=bins, block_bytes=600)
    assert sorted(tuple(x) for x in found.collect()) == brute(asked, rows, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e5, 1.0]), (1, [3e5, 1.0]), (2, [3e5, 1.00390625]), (3, [-3e5, 0.0])]
    found = exact_topk(table(spark, rows), table(spark, rows[:1]), 2)
    assert [tuple(x) for x in found.orderBy("rank").collect()] == brute(rows[:1], rows, 2)


def test_few_rows(spark):
    none = table(spark, [])
    one = table(spark, [(0, [1.0]), (1, [2.0])])
    assert exact_topk(none, one).count() == exact_topk(one, none).count() == exact_topk(none, none).count() == 0
    assert [tuple(x) for x in exact_topk(one, one.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
