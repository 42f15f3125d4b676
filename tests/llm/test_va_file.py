from math import floor

import numpy as np
import pytest

from ledgerwind.llm import va_file as va

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k):
    """Every row against every query row, in Python's integers."""
    ok = [(vec, [floor(64 * float(np.float32(x))) for x in e]) for vec, e, _ in rows if vec is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q in sorted(set(asked)):
        scores = sorted((-sum(a * b for a, b in zip(e, x, strict=True)), c) for own, e in ok if own == q for c, x in ok if c != q and len(x) == len(e))
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 900.0])
def test_results_match_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(va, "LEAST_SHARD", 50)
    rng = np.random.default_rng(1)
    rows = [(i, (scale * rng.normal(size=12)).tolist(), "x") for i in range(500)]
    rows += [(1000 + i, rows[3][1], "x") for i in range(60)]  # a hot vector
    rows += [(2000 + i, (rng.normal(size=5)).tolist(), "x") for i in range(8)]  # another length
    rows += [(3000, None, "x"), (3001, [1.0, None] * 6, "x"), (3002, [float("nan")] * 12, "x"), (3003, [float("inf")] * 12, "x"), (None, rows[0][1], "x"), (3005, [], "x"), (3006, [0.0] * 12, "x")]
    rows += [rows[7], rows[44], (9, rows[8][1], "x"), *[(12, rows[30][1], "x")] * 30]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [3, 7, 9, 12, 1005, 2000, 3000, 3002, 3005, 3006, 44]
    got = sorted(tuple(r) for r in va.top_k(df, df.filter(df.vec_id.isin(asked)), 20).collect())
    assert got == brute(rows, asked, 20)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [0.5, 0.5], "")], SCHEMA)
    assert [tuple(r) for r in va.top_k(df, df.filter("vec_id = 1"), 5).collect()] == [(1, 1, 2, 64 * 32 + 128 * 32)]
    assert va.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert va.top_k(df, df.limit(0), 5).count() == 0


@pytest.mark.parametrize("largest", [2.0**21, 2.0**60])
def test_large_components_and_long_vectors(spark, largest):
    """Components of 2**20 and more: sums beyond 2**53, and beyond 2**63 as long as these are no result."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3000).tolist(), "x") for i in range(40)]
    rows += [(100 + i, (rng.normal(size=3000) * (largest if largest < 2**30 else 1)).tolist(), "x") for i in range(10)]
    rows = [(i, [abs(x) for x in e[:6]] + e[6:], x) for i, e, x in rows]
    rows += [(200, [-largest] * 6 + [0.0] * 2994, "x"), (201, [1.0] * 6 + [0.0] * 2994, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [3, 100, 201, 7]
    want = brute(rows, asked, 5)
    assert sorted(tuple(r) for r in va.top_k(df, df.filter(df.vec_id.isin(asked)), 5).collect()) == want
    assert max(abs(r[3]) for r in want) > 2**40 or largest > 2**30


def test_scores_that_no_long_can_hold_are_errors(spark):
    df = spark.createDataFrame([(1, [2.0**40, 0.0], "x"), (2, [2.0**40, 1.0], "x"), (3, [-(2.0**40), 1.0], "x")], SCHEMA)
    for query in (1, 3):
        with pytest.raises(Exception, match="does not fit a long"):
            va.top_k(df, df.filter(df.vec_id == query), 5).collect()


def test_inner_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (2.0**10, 2.0**26, 2.0**30, 2.0**33, 2.0**70):
        q, x = (np.floor(rng.normal(size=(50, 9)) * size) for _ in range(2))
        assert va.inner(q, x) == [sum(int(a) * int(b) for a, b in zip(i, j, strict=True)) for i, j in zip(q, x, strict=True)]
