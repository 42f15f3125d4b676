import random
from datetime import date, timedelta
from math import sqrt

import pytest
from pyspark.sql import functions as F

from ledgerwind.functions import calendars as cal
from ledgerwind.operators import duplicates, evaluate, features, model, portfolio, ranking, store, study, temporal
from ledgerwind.operators.events import entry_dates

TRADE = "trade_id long, filing_id long, filer_id long, document_type string, amends_filing_id long, filed_on date, ticker string, side string, trade_date date, shares int, price int, role string, is_10b5_1 boolean, line_no long, source string, owner string, owned_after int, issuer long"
D = date(2024, 1, 10)


def random_trades(n=400, seed=1):
    rng, rows, order = random.Random(seed), [], 0
    for f in range(n):
        amends = rng.randrange(f) if f and rng.random() < 0.4 else None
        for line in range(rng.randrange(1, 6)):
            order += 1
            rows.append((order, f, rng.randrange(4), "4/A" if amends is not None else "4", amends, D + timedelta(rng.randrange(30)), rng.choice(["A", "B", None]), rng.choice(["buy", "sell"]), D + timedelta(rng.randrange(3)), rng.choice([None, 1, 2]), rng.choice([None, 5, 6]), None, False, line, "edgar", None, None, 1))
    return rows


def greedy(rows):
    """Amendment lines take the first unused original line, rule after rule."""
    by, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[13], r[0])):
        by.setdefault(r[1], []).append(r)
    rules = [("amendment_duplicate", (7, 8, 9, 10)), ("amendment_correction", (7, 8)), ("amendment_correction", (7, 9, 10))]
    for lines in by.values():
        used = set()
        for kind, key in rules:
            for t in lines:
                if t[4] is not None and t[0] not in out:
                    for o in by.get(t[4], []):
                        if o[0] not in used and all(o[k] == t[k] for k in key):
                            out[t[0]] = (o[0], kind)
                            used.add(o[0])
                            break
    return out


def test_amendment_matching_is_the_greedy_one(spark):
    rows = random_trades()
    got = duplicates.amendment_matches(spark.createDataFrame(rows, TRADE)).collect()
    assert {r.trade_id: (r.original_id, r.kind) for r in got} == greedy(rows) and len(got) > 100


def test_repeats_match_the_first_filing_line_by_line(spark):
    row = lambda t, f, day, line, doc="4", shares=1: (t, f, 1, doc, None, D + timedelta(day), None, "buy", D, shares, 5, None, False, line, "edgar", None, None, 1)
    rows = [row(1, 10, 0, 0), row(2, 10, 0, 1), row(3, 20, 3, 0), row(4, 20, 3, 1), row(5, 20, 3, 2), row(6, 30, 1, 0), row(7, 40, 2, 0, "4/A"), row(8, 50, 4, 0, shares=None)]
    got = duplicates.repeat_matches(spark.createDataFrame(rows, TRADE)).collect()
    assert {r.trade_id: r.original_id for r in got} == {3: 1, 4: 2, 6: 1}


def lagged(spark, rows):
    base = [(i, i, f, "4", None, d, t, s, td, 1, p, "CEO", False, 0, "edgar", None, None, 1) for i, (f, d, t, s, td, p) in enumerate(rows)]
    df = spark.createDataFrame(base, TRADE)
    return features.lags(duplicates.effective_dates(df, duplicates.duplicates(df)), cal.calendar(spark), "2024-12-31")


def test_lag_zscore_needs_three_earlier_filings_and_floors_the_spread(spark):
    at = lambda days, lag, f=1: (f, D + timedelta(days), "A", "buy", D + timedelta(days - lag), 5 + days)
    rows = [at(0, 1), at(1, 2), at(2, 2), at(6, 2), at(6, 1, 2)]
    df = lagged(spark, rows).withColumn("lag_days", F.element_at(F.array(*(F.lit(x) for x in (1, 2, 3, 4, 9))), (F.col("trade_id") + 1).cast("int")))
    got = {r.trade_id: r.filer_lag_zscore for r in features.filer_lag_zscore(df).collect()}
    assert list(got) == [3] and abs(got[3] - 2 / sqrt(2 / 3)) < 1e-9


def test_market_rank_is_that_of_a_sorted_list(spark):
    rng = random.Random(2)
    rows = [(i, date(2020, 1, 1) + timedelta(rng.randrange(900)), "A", rng.choice(["buy", "sell"]), date(2019, 12, 1), rng.randrange(1, 60)) for i in range(700)]
    df = lagged(spark, rows)
    got = {r.trade_id: (r.n, r.score) for r in features.market_size(df, 7).collect()}
    for i, (_, d, _, s, _, p) in enumerate(rows):
        old = [q for _, e, _, t, _, q in rows if t == s and d - timedelta(365) <= e < d]
        want = (len(old), (sum(q < p for q in old) + 0.5 * sum(q == p for q in old)) / len(old)) if len(old) >= 100 else None
        assert (want is None) == (i not in got) and (want is None or (got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-12))


def test_cluster_counts_filers_known_by_then(spark):
    d = lambda n: D + timedelta(n)
    rows = [(1, d(20), "A", "buy", d(0), 1), (2, d(20), "A", "buy", d(14), 2), (3, d(21), "A", "buy", d(-14), 3), (4, d(20), "A", "buy", d(15), 4), (5, d(20), "A", "sell", d(0), 5), (1, d(20), "A", "buy", d(1), 6), (6, d(20), None, "buy", d(0), 7)]
    got = {r.trade_id: r.cluster_count for r in features.cluster_counts(lagged(spark, rows)).collect()}
    assert got == {0: 2, 1: 3, 2: 2, 3: 3, 4: 1, 5: 3}


def test_asof_bounds(spark):
    left = spark.createDataFrame([(i, k, D + timedelta(n)) for i, (k, n) in enumerate([("A", 0), ("A", 5), ("A", 6), ("A", -1), ("B", 0), (None, 0), ("A", 400)])], "id int, k string, at date")
    right = spark.createDataFrame([("A", D, 1.0), ("A", D + timedelta(300), 2.0)], "k string, date date, v double")
    run = lambda **kw: {r.id: r.x_v for r in temporal.asof(left, right, "k", "at", ["v"], "x", 5, **kw).collect()}
    assert run() == {0: 1.0, 1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert run(strict=True) == {0: None, 1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert run(forward=True) == {0: 1.0, 1: None, 2: None, 3: 1.0, 4: None, 5: None, 6: None}


def test_entry_date_by_time_of_acceptance(spark):
    rows = [("2024-01-10 14:29:00", date(2024, 1, 10)), ("2024-01-10 14:30:00", date(2024, 1, 11)), ("2024-01-13 12:00:00", date(2024, 1, 16)), (None, date(2024, 1, 11)), ("2024-01-11 02:00:00", date(2024, 1, 11))]
    df = spark.createDataFrame([(D, a, w) for a, w in rows], "f date, a string, want date").withColumn("a", F.col("a").cast("timestamp"))
    assert entry_dates(df, cal.calendar(spark), "f", "a", "e").filter("not e <=> want").count() == 0


def test_spread_tiers(spark):
    got = spark.createDataFrame([(v,) for v in (None, 0.0, 49_999.0, 5e4, 5e5, 4.9e6, 5e6, 5e7)], "v double").select(evaluate.half_spread_bps(F.col("v"))).collect()
    assert [r[0] for r in got] == [150, 150, 150, 75, 30, 30, 10, 2]


def test_summaries_by_hand(spark):
    rows = [("g", v, c) for v, c in ((0.1, 1), (0.2, 1), (-0.1, 2), (0.4, 3))] + [("one", 0.5, 1), ("same", 0.5, 1), ("same", 0.5, 2)]
    got = {r.g: r for r in study.summarize(spark.createDataFrame(rows, "g string, v double, c int"), ["g"], "v", "c").collect()}
    x = [(0.1 - 0.15) + (0.2 - 0.15), -0.1 - 0.15, 0.4 - 0.15]
    assert abs(got["g"].t_cluster - 0.15 / sqrt(sum(a * a for a in x) / 16 * 3 / 2)) < 1e-9 and got["g"].hit == 0.75
    assert got["one"].t is None and got["one"].t_cluster is None and got["same"].t is None
    half = study.contrast(spark.createDataFrame([(1, 0.3, 1, True), (1, 0.1, 2, True), (1, 0.0, 1, False), (1, 0.2, 2, False)], "g int, v double, c int, a boolean"), ["g"], F.col("a"), "v", "c").first()
    assert abs(half["diff"] - 0.1) < 1e-12 and abs(half["t"] - 0.1 / sqrt(2 * (0.1**2 + 0.1**2))) < 1e-9


def test_order_statistics_and_ranks(spark):
    df = spark.createDataFrame([("a", float(v)) for v in random.Random(1).sample(range(100), 100)] + [("b", 7.0)] * 3, "g string, v double").repartition(5)
    got = {r.g: r for r in ranking.order_statistics(df, ["g"], "v", ranking.quantile_places(5)).collect()}
    assert [got["a"][f"cut{k}"] for k in range(1, 5)] == [20, 40, 60, 80] and got["b"].cut4 == 7
    assert ranking.order_statistics(df, [], "v", {"m": F.lit(0)}).first()["m"] == 0
    assert sorted(r["rank"] for r in ranking.numbered(df.filter("g = 'a'"), [], [F.col("v")]).collect()) == list(range(1, 101))
    assert {r["k"] for r in ranking.average_ranks(df, ["g"], "v", "k").filter("g = 'b'").collect()} == {2.0}


def test_bounded_least_squares_against_a_grid():
    gram, right = [[2.0, 0.5], [0.5, 1.0]], [3.0, -1.0]
    loss = lambda a, b: gram[0][0] * a * a + 2 * gram[0][1] * a * b + gram[1][1] * b * b - 2 * (right[0] * a + right[1] * b)
    w = model.bounded_least_squares(gram, right, 1.0)
    assert loss(*w) <= min(loss(a / 50, b / 50) for a in range(51) for b in range(51)) + 1e-9


def test_model_fit_finds_a_planted_effect(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        ceo = rng.random() < 0.3
        rows.append((D + timedelta(i % 300), f"T{i}", "buy", i, (0.1 if ceo else 0.0) + rng.gauss(0, 0.02), None if i % 9 else 0.1, "CEO" if ceo else "director", 1e5, None, 1, 0, None, None, 1e6))
    schema = "filing_date date, ticker string, side string, filer_id long, y double, drift double, role string, value double, stake_change double, cluster_count int, repeat_buys int, drawdown double, track_record double, dollar_volume double"
    df = spark.createDataFrame(rows, schema)
    m = model.fit(df)
    ys = sorted(r[4] for r in rows)
    cut = [min(max(r[4], ys[int(0.01 * 1499)]), ys[int(0.99 * 1499)]) for r in rows]
    ceo = [y for y, r in zip(cut, rows, strict=True) if r[6] == "CEO"]
    assert abs(m.tables["role"]["CEO"] - len(ceo) / (len(ceo) + 500) * (sum(ceo) / len(ceo) - sum(cut) / 1500)) < 1e-9
    assert m.weights["role"] > 0.9 and m.n_train == 1500 and abs(m.overall - sum(cut) / 1500) < 1e-9
    assert model.Model.from_json(m.to_json()) == m
    with pytest.raises(ValueError):
        model.Model.from_json(m.to_json().replace('"version": 1', '"version": 2'))
    assert model.fit(df.limit(0)) is None


def test_portfolio_by_hand(spark):
    d = [date(2024, 1, n) for n in (2, 3, 4, 5)]
    bar = lambda t, i, o, c: (t, d[i], i + 1, o, c)
    raw = [bar("SPY", i, 100.0, 100.0 + i) for i in range(4)] + [bar("A", i, 10.0 + i, 11.0 + i) for i in range(4)] + [bar("B", i, 20.0, 20.0) for i in range(3)]
    bars = evaluate.numbered(spark.createDataFrame([(t, x, o, c, o, c, 1.0) for t, x, _, o, c in raw], "ticker string, date date, open double, close double, adj_open double, adj_close double, volume double"))
    picks = [(0.9, d[0], d[2], 0.01, d[0], "A", "buy", 1), (0.8, d[0], d[1], 0.02, d[0], "B", "buy", 2), (0.7, d[0], d[1], 0.0, d[0], "C", "buy", 3), (0.99, d[1], d[3], 0.0, d[1], "A", "buy", 4)]
    df = spark.createDataFrame(picks, "score double, entry date, exit date, cost double, filing_date date, ticker string, side string, filer_id long")
    taken = portfolio.admitted(df, 2)
    assert [t[0] for t in taken] == ["A", "B"]  # C finds no slot, the second A is held already
    got = {r.date: (r.excess, r.positions) for r in portfolio.daily(spark.createDataFrame(taken, "ticker string, entry date, exit date, cost double"), bars, slots=2).collect()}
    want = {d[0]: (((11 / 10 - 1) - 0 - 0.005) + (0 - 0 - 0.01)) / 2, d[1]: (((12 / 11 - 1) - 0.01) + (0 - 0.01 - 0.01)) / 2, d[2]: ((13 / 12 - 1) - (102 / 101 - 1) - 0.005) / 2}
    assert set(got) == set(want) and all(abs(got[k][0] - v) < 1e-12 for k, v in want.items()) and [got[k][1] for k in sorted(got)] == [2, 2, 1]
    assert abs(portfolio.max_drawdown([0.1, -0.5, 0.2]) + 0.5) < 1e-12
    assert portfolio.half_life({0: 0.04, 1: 0.03, 2: 0.02}, 2.5) == 2 and portfolio.half_life({0: 0.04, 1: 0.0}, 1.0) is None


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "k string, v int, s string")
    new = spark.createDataFrame([("b", 9, "y"), ("c", 3, "y"), ("c", 4, "y")], "k string, v int, s string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.insert_missing(old, new, ["k"])) == [("a", 1, "x"), ("b", 2, "x"), ("c", 3, "y")]
    assert rows(store.last_write(old, new.filter("v <> 4"), ["k"], ("s",))) == [("a", 1, "x"), ("b", 9, "x"), ("c", 3, "y")]
    assert rows(store.cascade(old, new, "k")) == [("a", 1, "x")]
    gaps = spark.createDataFrame([("a", None), ("b", 5)], "k string, v int")
    assert rows(store.fill_nulls(gaps, spark.createDataFrame([("a", 7), ("b", 8)], "k string, v int"), ["k"], ["v"])) == [("a", 7), ("b", 5)]
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, r string")
    assert [x[1] for x in rows(store.set_null(refs, new, "k", "r"))] == ["a", None, None]
    assert rows(store.first_name(spark.createDataFrame([("a", "n1", 1)], "k string, n string, o int"), spark.createDataFrame([("a", "n2", 2)], "k string, n string, o int"), ["k"], "n", "o")) == [("a", "n1", 1)]
