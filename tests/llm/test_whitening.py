from fractions import Fraction
from math import floor

import numpy as np
import pytest

from ledgerwind.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n string, r int"


def brute(rows):
    """Exact sums and a covariance of fractions, then numpy's eigenvectors: by length, what each row must give."""
    ok = [(v, [floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for v, e, *_ in rows if e and all(c is not None and np.isfinite(c) for c in e)]
    out = {}
    for dim in {len(x) for _, x in ok}:
        own = [(v, tuple(x)) for v, x in ok if len(x) == dim]
        fit = sorted(set(x for _, x in own))
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
        out[dim] = n, sums, centred, own
    return out


def check(got, rows, most=16):
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["n"], []).append(r)
    assert sum(min(dim, most) * len(own) for dim, (_, _, _, own) in want.items()) == len(got)
    for dim, (n, sums, centred, own) in want.items():
        k, rs = min(dim, most), by[n]
        assert sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["component"]) for r in rs) == sorted((v is not None, v or 0, c) for v, _ in own for c in range(1, k + 1))
        values = np.sort(np.linalg.eigvalsh(centred.T @ centred / n))[::-1]
        deviation = {(v, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for v, x in own}
        assert {(r["vec_id"], int(r["deviation"])) for r in rs} == deviation
        for c in range(1, k + 1):
            some = [r for r in rs if r["component"] == c]
            if values.sum() > 0:
                assert all(r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9, abs=1e-12) for r in some)
        first = {v: [] for v, _ in own}
        for r in sorted(rs, key=lambda r: r["component"]):
            first[r["vec_id"]].append(r["whitened"])
        if len(first) == len(own) == n and values[k - 1] > 1e-9 * values[0]:
            w = np.array([first[v] for v, _ in own])
            assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
            x = np.array([x for _, x in own], float) - np.array([float(Fraction(s, n)) for s in sums])
            basis = np.linalg.lstsq(x, w, rcond=None)[0] * np.sqrt(values[:k])
            assert np.abs(np.linalg.norm(basis, axis=0) - 1).max() < 1e-9
            assert np.abs((x.T @ x / n) @ basis - basis * values[:k]).max() < 1e-8 * values[0]
            assert 0 <= rs[0]["identity_error"] < 1e-9


def test_rows_match_exact_sums_and_eigenvectors(spark):
    rng = np.random.default_rng(1)
    basis = rng.normal(size=(24, 24)) * np.linspace(3, 0.2, 24)[:, None]
    rows = [(i, (rng.normal(size=24) @ basis).tolist(), "a", i) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(40)  # two levels of the tree
    check(wh.whiten(df).collect(), rows)


def test_copies_lengths_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), "a", 1) for i in range(80)]
    rows += [(1000 + i, rows[3][1], "a", 1) for i in range(60)]  # copies count once in the fit
    rows += [rows[5], rows[5], (None, rows[7][1], "a", 1), (9, rows[8][1], "b", 2)]
    rows += [(2000 + i, rng.normal(size=3).tolist(), "a", 1) for i in range(30)]
    rows += [(3000, None, "x", 1), (3001, [1.0, None] * 3, "x", 1), (3002, [float("nan")] * 6, "x", 1), (3003, [float("inf")] * 6, "x", 1), (3004, [], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("r", "dim")
    check(wh.whiten(df).collect(), rows)
    check(wh.whiten(df, 2).collect(), rows, 2)


def test_components_without_variance(spark):
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one) == [(v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2)]
    flat = wh.whiten(spark.createDataFrame([(i, [float(i), 5.0], "", 1) for i in range(4)], SCHEMA)).collect()
    assert {r["component"]: (r["whitened"] is None, round(r["explained"], 9)) for r in flat} == {1: (False, 1.0), 2: (True, 0.0)}
    assert all(r["identity_error"] < 1e-12 for r in flat)
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [2.0**30, 2.0**50])
def test_large_components_are_exact_or_an_error(spark, size):
    rows = [(i, [size * i, float(i % 3), 1.0 + i * i], "", 1) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    if size < 2.0**40:
        check(wh.whiten(df).collect(), rows)
    got = {(r["vec_id"], int(r["deviation"])) for r in wh.whiten(df).collect()}
    n, sums, _, own = brute(rows)[3]
    assert got == {(v, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for v, x in own}
    with pytest.raises(Exception, match="does not fit a long"):
        wh.whiten(spark.createDataFrame([(1, [2.0**80], "", 1)], SCHEMA)).collect()


def test_many_lengths_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(wh, "MODEL_BYTES", 1000)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=2 + sum(i >= least for least in (10, 30, 60))).tolist(), "", 1) for i in range(100)]
    check(wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
