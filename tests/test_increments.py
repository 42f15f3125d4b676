"""Increments, replays and quotas against full recomputes and plain loops."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwind.functions import calendars, text
from ledgerwind.operators import duplicates, features, increments, ranking, reports, store, temporal
from ledgerwind.plans import catalog
from ledgerwind.sources import prices
from ledgerwind.streaming import ingest, quota

SF = "/root/testdata/sf0.001"


def test_small_late_loads_touch_what_they_can_change(spark):
    d = catalog.Domain.of(spark, SF)
    lagged = lambda trades: features.lags(duplicates.effective_dates(trades, duplicates.duplicates(trades)), d.days, catalog.AS_OF)
    plain = lambda df: sorted(str(tuple(r)) for r in df.select("trade_id", *(F.round(c, 9) if k == "double" else F.col(c) for c, k in sorted(df.dtypes) if c != "trade_id")).collect())
    own = d.trades.filter("filer_id < 30")
    whole = lagged(own).cache()
    total = whole.count()
    want = plain(features.features(whole, d.bars))
    for late, most in (("filer_id = 7 and (document_type = '4/A' or filed_on >= '2001-01-01')", 0.3),):
        before = lagged(own.filter(f"not ({late})")).cache()
        got, n = increments.update(features.features(before, d.bars), before, whole, d.bars)
        assert plain(got) == want and 0 < n < most * total, (late, n, total)
    none = increments.changed(whole, whole)
    assert none.count() == 0 and increments.affected(whole, whole.join(none, "trade_id", "left_semi")).count() == 0


def test_replay_sees_what_was_known(spark):
    rows = [(1, None, "2024-01-02", "2024-01-05", 10), (2, None, "2024-01-02", "2024-01-09", 20), (3, 1, "2024-01-02", "2024-01-08", 30), (4, 1, "2024-01-02", "2024-01-20", 40), (5, None, "2024-02-01", "2024-02-01", 50)]
    df = spark.createDataFrame(rows, "id int, amends int, dated string, known string, v int").withColumns({c: F.col(c).cast("date") for c in ("dated", "known")})
    spans = temporal.known_spans(df, "id", "known", "amends")
    assert {r.id: str(r.known_to) for r in spans.collect()} == {1: "2024-01-08", 2: "None", 3: "None", 4: "None", 5: "None"}
    got = {(str(r.cut), r.state): r.v for r in temporal.replay(spans, ["2024-01-01", "2024-01-05", "2024-01-08", "2024-03-01"], "dated", "known", [], [F.sum("v").alias("v")]).collect()}
    assert got == {("2024-01-05", "current"): 10, ("2024-01-05", "unknown"): 90, ("2024-01-08", "current"): 30, ("2024-01-08", "replaced"): 10, ("2024-01-08", "unknown"): 60, ("2024-03-01", "current"): 140, ("2024-03-01", "replaced"): 10}


def walk(calls, cooldown, stale):
    """What each call of one account finds, one after the other."""
    out, until, since = {}, None, None
    for i, (call, at, symbol, kind) in enumerate(calls):
        seen = calls[: i + 1]
        cooling, busy = until is not None and at < until, False
        if kind == "limit":
            until = at + cooldown
        elif kind == "start":
            busy = since is not None and at - since < stale
            since = since if busy else at
        elif kind == "end":
            since = None
        month = {s for _, t, s, _ in seen if (t.year, t.month) == (at.year, at.month)}
        out[call] = (sum(t > at - timedelta(hours=1) for _, t, _, _ in seen), sum(t > at - timedelta(days=1) for _, t, _, _ in seen), len(month), cooling, busy)
    return out


def test_quota_state_over_several_batches(spark, tmp_path):
    rng = random.Random(4)
    calls = [(a, 1000 * a + i, datetime(2024, 1, 25) + timedelta(minutes=rng.randrange(12 * 24 * 60)), rng.choice("ABCDEF"), rng.choice(["limit", "start", "end", "get", "get"])) for a in range(3) for i in range(120)]
    calls += [(9, 9000, datetime(2024, 1, 25), "A", "start"), (9, 9001, datetime(2024, 2, 5), "A", "start")]  # silent for longer than any timer
    folder, table, state = (str(tmp_path / x) for x in ("calls", "table", "state"))
    bounds = [datetime(2024, 1, 25), datetime(2024, 1, 29), datetime(2024, 2, 2), datetime(2024, 3, 1)]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = [c for c in calls if low <= c[2] < high]
        spark.createDataFrame(part, "account long, call_id long, at timestamp, symbol string, kind string").coalesce(1).write.mode("append").parquet(folder)
        ingest.run_to_table(quota.used(quota.call_stream(spark, folder), timedelta(hours=3), timedelta(minutes=50)), table, state)
    got = {r.call_id: (r.hour_calls, r.day_calls, r.month_symbols, r.cooling, r.busy) for r in spark.read.parquet(table).collect()}
    want = {}
    for a in {c[0] for c in calls}:
        want |= walk(sorted((c[1:] for c in calls if c[0] == a), key=lambda c: (c[1], c[0])), timedelta(hours=3), timedelta(minutes=50))
    assert got == want and any(v[4] for v in want.values()) and any(v[3] for v in want.values())


def test_coverage_by_status(spark):
    wanted = spark.createDataFrame([("2020q1", t, 1, 2) for t in "abcdefg"], "quarter string, ticker string, buys long, trades long")
    status = spark.createDataFrame([("a", "ok", "2020-03-31", "2021-01-01"), ("b", "ok", "2020-04-01", "2021-01-01"), ("c", "empty", None, None), ("d", "error", None, None), ("e", "failed", None, None), ("f", "odd", None, None)], "ticker string, status string, first string, last string")
    row = reports.coverage_by_status(wanted, status.withColumns({c: F.col(c).cast("date") for c in ("first", "last")})).first()
    assert (row.tickers, row.covered, row.out_of_range, row.not_found, row.failed, row.pending, row.buys_covered, row.trades_covered, row.trades) == (7, 1, 1, 1, 2, 1, 1, 2, 14)


def test_rank_correlation_has_ties_and_gaps(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 2.0, 9.0), ("a", 5.0, 9.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    got = {r.g: r.ic for r in ranking.rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", "ic").collect()}
    assert got["a"] == pytest.approx(4 / 4.5) and got["b"] is None and got["c"] is None


def test_names_urls_and_logs(spark, tmp_path):
    row = spark.range(1).select(text.filing_url("https://x", F.lit("00012"), F.lit("0001-24-07")).alias("u"), text.filing_url("https://x", F.lit("000"), F.lit("1")).alias("n"), text.safe_name(F.lit("BRK/B ü-1.A")).alias("s")).first()
    assert (row.u, row.n, row.s) == ("https://x/12/00012407/0001-24-07-index.htm", None, "BRK_B__-1.A")
    log = spark.createDataFrame([("a", 1)], "ticker string, n int")
    assert Counter(map(tuple, store.log_calls(log, log).collect())) == {("a", 1): 2}
    bars = spark.createDataFrame([("A", date(2024, 1, 2), 1.0, 2.0, 1.0, 2.0, 5.0)], "ticker string, date date, open double, close double, adj_open double, adj_close double, volume double")
    bars.write.parquet(str(tmp_path / "bars"))
    assert [tuple(r) for r in prices.open_bars(spark, f"table:{tmp_path}/bars").collect()] == [tuple(r) for r in bars.collect()]


def test_quarter_ranges(spark):
    cases = {"2015q3-2016q2": ["2015q3", "2015q4", "2016q1", "2016q2"], "2020q4": ["2020q4"], "2016q1-2015q1": [], "2015q5": None, "2015q1-": None, "x": None, "2015q1-2015q2-2015q3": None}
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", calendars.quarters(F.col("s")).alias("q")).collect()
    assert {r.s: r.q for r in rows} == cases
    assert tuple(spark.range(1).select(*calendars.quarter_bounds(F.lit("2023q4"))).first()) == (date(2023, 10, 1), date(2023, 12, 31))


def test_cache_state_and_universe_files(spark, tmp_path):
    assert prices.state_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "state.json").write_text('{"cooldown_until": "2024-01-02T03:04:05", "cooldown_reason": "hourly limit"}')
    assert [tuple(r) for r in prices.state_file(spark, str(tmp_path / "state.json")).collect()] == [(datetime(2024, 1, 2, 3, 4, 5), "hourly limit")]
    (tmp_path / "empty.json").write_text("{}")
    assert prices.state_file(spark, str(tmp_path / "empty.json")).count() == 0
    rows = [("2020q1", "A", 1, 2), ("2020q2", "B", 0, 5)]
    prices.write_universe(spark.createDataFrame(rows, "quarter string, ticker string, buys long, trades long"), str(tmp_path / "universe"))
    assert sorted(map(tuple, prices.universe_file(spark, str(tmp_path / "universe")).collect())) == rows
