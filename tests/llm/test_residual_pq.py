from math import ceil, floor

import duckdb
import numpy as np
import pytest

from ledgerwind.llm import catalog
from ledgerwind.llm import residual_pq as pq

SCHEMA = "vec_id long, embedding array<float>, label int, q string, codes int"


def brute(rows, asked, positive=5, negative=5, least=80, most=100):
    """Every row against every anchor, in Python's integers."""
    ok = [(v, label, tuple(floor(256 * float(np.float32(c))) for c in e)) for v, e, label, *_ in rows if v is not None and label is not None and e and all(c is not None and np.isfinite(c) for c in e)]
    out = []
    for anchor, own, a in sorted({r for r in ok if r[0] in asked}):
        scores = sorted((-sum(x * y for x, y in zip(a, e, strict=True)), v, label == own) for v, label, e in ok if v != anchor and len(e) == len(a))
        for ps, p in [(-s, v) for s, v, same in scores if same][:positive]:
            inside = [(-s, v) for s, v, same in scores if not same and least * ps <= -100 * s <= most * ps]
            out += [(anchor, p, r, v, ps, s) for r, (s, v) in enumerate(inside[:negative], 1)]
    return sorted(out)


def mined(spark, rows, asked, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = pq.mine(df, df.filter(df.vec_id.isin(asked)), **more)
    assert got.columns == pq.NAMES
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(4, 11))
    own = [(i, (middle[i % 4] + rng.normal(size=11)).tolist(), i % 5, "x", 1) for i in range(600)]
    own += [(1000 + i, own[3][1], i % 2, "x", 1) for i in range(80)]  # a hot vector under two labels
    own += [(2000 + i, rng.normal(size=4).tolist(), i % 3, "x", 1) for i in range(40)]  # another length
    own += [own[7], own[44], (9, own[8][1], 4, "x", 1), *[(12, own[30][1], 2, "x", 1)] * 30]
    return own + [(3000, None, 1, "x", 1), (3001, [1.0, None] * 5, 1, "x", 1), (3002, [float("nan")] * 11, 1, "x", 1), (3003, [float("inf")] * 11, 1, "x", 1), (3004, [], 1, "x", 1), (3005, own[0][1], None, "x", 1), (None, own[0][1], 1, "x", 1), (3006, [0.0] * 11, 1, "x", 1)]


@pytest.mark.parametrize(("centroids", "sample"), [(256, 8192), (4, 100), (1, 1)])
def test_results_match_brute_force(spark, monkeypatch, rows, centroids, sample):
    """With good codebooks and with ones that hardly tell rows apart."""
    for name, value in (("CENTROIDS", centroids), ("SAMPLE", sample), ("LEAST_SHARD", 100), ("HELD", 3000)):
        monkeypatch.setattr(pq, name, value)
    asked = [3, 7, 9, 12, 44, 100, 200, 1000, 1005, 2000, 2003, 3000, 3004, 3005, 3006]
    want = brute(rows, asked)
    assert len(want) > 150 and mined(spark, rows, asked) == want


def test_other_windows_and_counts(spark, rows):
    asked = list(range(0, 600, 50))
    more = {"positive": 3, "negative": 8, "least": -50, "most": 110}
    assert mined(spark, rows, asked, **more) == brute(rows, asked, **more)


def test_scores_below_nought_have_empty_windows(spark):
    rows = [(i, [(-1.0) ** i * (i + 1), 1.0], i % 2, "x", 1) for i in range(6)] + [(10, [-9.0, 0.0], 2, "x", 1), (11, [9.0, 0.0], 2, "x", 1), (12, [0.0, 0.0], 3, "x", 1), (13, [0.0, 0.0], 3, "x", 1)]
    asked = [0, 1, 10, 11, 12]
    want = brute(rows, asked)
    assert not [r for r in want if r[4] < 0] and [r for r in want if r[4] == 0] and mined(spark, rows, asked) == want


def test_few_rows_and_none(spark, rows):
    df = spark.createDataFrame(rows[:1], SCHEMA)
    assert pq.mine(df, df).count() == 0 and pq.mine(df.limit(0), df).count() == 0 and pq.mine(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [2.0**13, 2.0**18])
def test_large_components(spark, largest):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=400) * largest).tolist(), i % 2, "x", 1) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 8][1]) * (0.8 + 0.02 * i)).tolist(), i % 3, "x", 1) for i in range(16)]
    want = brute(rows, [1, 2, 3, 101])
    assert max(abs(r[4]) for r in want) > largest**2 * 2**20 and mined(spark, rows, [1, 2, 3, 101]) == want


def test_scores_that_no_long_can_hold_are_errors(spark):
    df = spark.createDataFrame([(i, [2.0**40, float(i)], 1, "x", 1) for i in range(3)], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        pq.mine(df, df).collect()


def test_windows_are_whole_numbers():
    for score in (*range(-30, 31), 2**62, 2**62 + 1):
        low, high = pq.window(score, 80, 100)
        assert 100 * (low - 1) < 80 * score <= 100 * low and high == score
    assert pq.window(7, 80, 100) == (ceil(5.6), 7)


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(3)
    x, q = (np.floor(rng.normal(size=(n, 7)) * 100) for n in (300, 20))
    books = [pq.codebook(np.ascontiguousarray(pq._parts(x)[:50, p]), 9) for p in range(4)]
    codes, norms, most = pq.encode(x, books)
    left = np.linalg.norm(pq._parts(x) - np.stack([b[codes[:, p]] for p, b in enumerate(books)], axis=1), axis=2)
    assert (norms * most[:, None] / 255 * (1 + 1e-9) >= left).all() and (norms * most[:, None] / 255 <= left + most[:, None] / 254).all()


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.execute(catalog.OP13_SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in catalog.op13_residual_pq(spark, sf).select(*names).collect()) == sorted(want.fetchall())
