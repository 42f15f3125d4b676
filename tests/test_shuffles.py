"""How often rows are moved: tables that grow with the input are dealt out as seldom as the job allows."""

import contextlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerwind.functions import calendars
from ledgerwind.operators import duplicates, evaluate, events, features, model, portfolio, ranking, reports, signals, study, temporal
from ledgerwind.plans import adapter, catalog, files, fixtures
from ledgerwind.sources import filings

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """The exchanges by a hash of a plan in which nothing is small enough to be broadcast."""

    def count(df):
        return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield count
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_are_read_once_for_all_versions_of_trades(spark, shuffled):
    df = adapter.trades(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*l_orderkey", plan)) == 1
    assert shuffled(df) <= 2  # lines and orders


def test_packed_trades_come_back_whole(spark):
    trades = catalog.Domain.of(spark, SF).trades
    back = adapter.unpacked(adapter.packed(trades)).select(*trades.columns)
    assert trades.exceptAll(back).count() == 0 and back.count() == trades.count()


def test_amendments_move_once(spark, shuffled):
    assert shuffled(duplicates.amendment_matches(catalog.Domain.of(spark, SF).trades)) == 1


def test_events_and_clusters_move_lines_once_each(spark, shuffled):
    lagged = catalog.Domain.of(spark, SF).lagged
    assert shuffled(features.cluster_counts(lagged)) <= 4
    rows = lagged.withColumnRenamed("original_id", "duplicate_of_trade_id").selectExpr("*", "1 AS cluster_count")
    assert shuffled(events.events(rows)) == 1
    assert shuffled(events.holdings(rows)) == 1


def test_several_lookups_move_rows_once(spark, shuffled):
    d = catalog.Domain.of(spark, SF)
    assert shuffled(features.drift(d.lagged, d.bars)) == 1
    assert shuffled(d.study.outcomes.drop("issuer")) <= 4  # events with bars; issuers' sectors are broadcast
    assert shuffled(d.study.legs) == 0 and shuffled(d.study.returns) == 0


def test_lookups_of_several_dates_are_those_of_one_after_the_other(spark):
    left = spark.sql("SELECT k, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM VALUES ('x', '2020-01-05', '2020-01-01'), ('x', '2020-01-05', '2020-01-01'), ('x', null, '2020-01-09'), ('y', '2020-01-05', '2020-01-05'), (null, '2020-01-05', '2020-01-05') AS t(k, a, b)")
    right = spark.sql("SELECT k, CAST(d AS DATE) AS date, v FROM VALUES ('x', '2020-01-02', 1), ('x', '2020-01-05', 2), ('x', '2020-01-20', 3) AS t(k, d, v)")
    one = temporal.asof(temporal.asof(left, right, "k", "a", ["v"], "p", 2), right, "k", "b", ["v"], "q", 5, forward=True)
    both = temporal.asof_all(left, right, "k", [("a", ["v"], "p", 2, False), ("b", ["v"], "q", 5, True)])
    assert both.columns == one.columns
    told = lambda df: sorted(map(str, df.collect()))
    assert told(both) == told(one) and both.filter("q_v = 1").count() == 2


def test_exits_are_the_last_bars_up_to_their_day(spark):
    rows = "('x', '2020-01-02'), ('x', '2020-01-04'), ('x', '2020-01-08'), ('x', '2020-01-09'), ('x', '2020-03-30')"  # the fourth is a Saturday
    bars = spark.sql(f"SELECT t AS ticker, CAST(d AS DATE) AS date, CAST(day(CAST(d AS DATE)) AS DOUBLE) AS adj_close FROM VALUES {rows} AS v(t, d)")
    days = calendars.calendar(spark)
    got = {str(r["date"]): r for r in evaluate.with_exits(bars, days).collect()}
    for h in evaluate.HORIZONS:
        asked = calendars.add_business_days(bars.drop("adj_close"), days, "date", h - 1, "nyse", "target")
        for r in temporal.asof(asked, bars, "ticker", "target", ["adj_close"], "x", evaluate.EXIT_DAYS).collect():
            assert got[str(r["date"])][f"exit{h}_date"] == (r["x_date"] if r["x_date"] and r["x_date"] >= r["date"] else None)


def test_replaced_filings_do_not_move_the_trades(spark, shuffled):
    trades = catalog.Domain.of(spark, SF).trades
    assert shuffled(temporal.known_spans(trades, "filing_id", "filed_on", "amends_filing_id")) == 0


def test_a_histogram_of_lags_stores_no_lagged_trades(spark):
    held = catalog.Domain.of(spark, SF)
    vars(held).pop("lagged", None)
    rows = {r["bucket"]: r["n"] for r in catalog.lag_histogram(spark, SF).collect()}
    assert "lagged" not in vars(held)
    assert sum(rows.values()) == held.trades.count()
    assert rows == {r["bucket"]: r["n"] for r in reports.lag_histogram(held.lagged).collect()}


def test_a_lookup_carries_the_values_of_its_own_way_alone(spark):
    left = spark.sql("SELECT 'x' AS k, DATE '2020-01-05' AS a, DATE '2020-01-06' AS b")
    right = spark.sql("SELECT 'x' AS k, DATE '2020-01-05' AS date, 'near' AS v, 'far' AS w")
    found = temporal.asof_all(left, right, "k", [("a", ["v", "w"], "p", 2, True), ("b", ["v"], "q", 2, False)])
    row = found.first()
    assert (row["p_v"], row["p_w"], row["q_v"]) == ("near", "far", "near")
    carried = re.search(r"struct\(([^)]*)\) AS _r0", found._jdf.queryExecution().analyzed().toString())[1]
    assert "v, v#" in carried and "w, w#" not in carried


def test_a_documents_owner_is_found_where_the_document_is(spark, shuffled):
    parsed = filings.parsed_documents(spark.createDataFrame([("a", "<x/>")], "accession string, xml string"))
    assert shuffled(filings.document_lines(parsed)) == 0


def test_faults_store_no_documents(spark, monkeypatch):
    held = []
    monkeypatch.setattr(filings, "stored", lambda df, name: held.append(df.columns) or df)
    files.document_faults(spark, SF)
    assert held == [["accession", "fault"]]


def test_rows_that_end_a_tenth_are_scored_once_before_they_are_put_in_order(spark, monkeypatch):
    plans, put = [], ranking.numbered
    monkeypatch.setattr(model.ranking, "numbered", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(df, *more))
    labels = {c: F.lit("x").alias(f"b_{c}") for c in model.NAMES}
    rows = spark.range(40).select(F.lit(1).alias("filer_id"), F.concat(F.lit("T"), "id").alias("ticker"), F.lit("buy").alias("side"), F.lit("2020-01-01").cast("date").alias("filing_date"), (F.col("id") / 100).alias("y"), F.lit(0.1).alias("drift"), F.lit(0).alias("since"), *labels.values())
    found, _ = model.fits(rows, ["all"], [model.Variant("v")])
    assert found[0, "v"].threshold is not None
    assert len(plans) == 1 and "Generate" not in plans[0]


def test_events_move_once_to_their_filers(spark, shuffled):
    s = catalog.Domain.of(spark, SF).study
    assert shuffled(signals.listed(s)) == 1 and shuffled(signals.build(s)) == 1


def test_history_at_the_filer_is_that_of_counts_apart(spark):
    s = catalog.Domain.of(spark, SF).study
    apart = signals.repeat_buys(s.events).join(signals.track_record(s.results, s.returns), events.KEYS)
    figures = [*events.KEYS, "repeat_buys", "track_n", F.round("track_record", 9).alias("track")]
    told = lambda df: sorted(map(str, df.select(*figures).collect()))
    whole, some = signals.build(s), signals.listed(s)
    assert told(whole) == told(apart) and whole.filter("repeat_buys > 0").count() > 0 and whole.filter("track_n > 1").count() > 0
    assert told(some) == told(whole.filter(signals.shown())) and some.count() > 0
    legs = s.returns.filter("h = 20").select(*events.KEYS, "exit", F.round("net", 9).alias("y"))
    found = some.filter("exit is not null").select(*events.KEYS, "exit", F.round("y", 9).alias("y"))
    assert found.count() > 0 and found.exceptAll(legs).count() == 0


def test_late_entries_meet_their_bars_in_one_shuffle(spark, shuffled):
    d = catalog.Domain.of(spark, SF)
    assert shuffled(portfolio.delayed_excess(d.listed, d.study.numbered)) == 1


def test_trades_and_bars_meet_in_one_shuffle(spark, shuffled):
    d = catalog.Domain.of(spark, SF)
    assert shuffled(reports.coverage(d.trades, d.bars)) <= 2  # the second one of sums
    days = "('x', '2020-01-05'), ('x', '2020-01-04'), ('x', '2020-01-13'), ('x', null), ('y', '2020-01-05'), (null, '2020-01-05'), ('x', '2020-05-07')"
    left = spark.sql(f"SELECT k, CAST(d AS DATE) AS d FROM VALUES {days} AS t(k, d)")
    right = spark.sql("SELECT k, CAST(d AS DATE) AS date FROM VALUES ('x', '2020-01-12'), ('x', '2020-05-10'), (null, '2020-01-05') AS t(k, d)")
    rows = {(r.k, str(r.d)): r.hit for r in temporal.met(left, right, "k", "d", 7, "hit").collect()}
    assert len(rows) == 7 and {k for k, hit in rows.items() if hit} == {("x", "2020-01-05"), ("x", "2020-05-07")}


def test_each_table_of_a_quarter_is_read_once(spark):
    found, lines = filings.quarter(spark, f"{fixtures.zipped_quarters(spark, SF)}/*.zip")
    reads = lambda df: len(re.findall(r"BatchScan zipped_tables", df._jdf.queryExecution().executedPlan().toString()))
    assert reads(found) == 2 and reads(lines) == 4  # submissions and owners; their lines and footnotes beside them


def test_bars_are_numbered_where_events_meet_them(spark, shuffled, monkeypatch):
    d, held, keep = catalog.Domain.of(spark, SF), [], evaluate.stored
    monkeypatch.setattr(evaluate, "stored", lambda df, name: held.append(name) or keep(df, name))
    s = evaluate.Study(d.events, d.bars, d.study.sectors, d.days)
    assert shuffled(s.outcomes) == 2  # bars as they are, and events
    bought = s.bought
    assert not {"numbered-bars", "ended"} & set(held)
    assert bought.count() > 0 and bought.exceptAll(s.at(20).filter("side = 'buy'").select(*bought.columns)).count() == 0


def test_lags_are_known_with_no_join_of_ordinary_lines(spark, shuffled):
    d = catalog.Domain.of(spark, SF)
    assert shuffled(features.filer_lag_zscore(d.lagged)) == 1
    odd = F.when(F.col("filing_id") % 5 == 0, F.col("filing_id") + 2).otherwise(F.col("amends_filing_id"))  # ordinary documents that amend others
    nulls = {"document_type": F.when(F.col("filing_id") % 17 != 0, F.col("document_type")), "shares": F.when(F.col("filing_id") % 19 != 0, F.col("shares"))}
    for trades in (d.trades, d.trades.withColumn("amends_filing_id", odd), d.trades.withColumn("amends_filing_id", odd).withColumns(nulls)):
        want = duplicates.effective_dates(trades, duplicates.duplicates(trades)).select("trade_id", "filer_id", "kind", "filing_date")
        got = duplicates.dated(trades, "filer_id")
        assert want.exceptAll(got.select(*want.columns)).count() == 0 and got.count() == want.count()


def test_a_supplier_s_bars_move_once(spark, shuffled):
    df = adapter.bars(spark, SF)
    assert len(re.findall(r"Exchange hashpartitioning\(ticker", df._jdf.queryExecution().executedPlan().toString())) == 1 and shuffled(adapter.day_range(spark, SF)) == 1
    assert df.filter("ticker is null").count() == 0 and df.groupBy("ticker", "date").count().filter("count > 1").count() == 0


def test_rejects_are_counted_with_no_line_put_in_order(spark, shuffled):
    want = sorted(map(tuple, catalog.store.reject_counts(catalog.validate_rejects(spark, SF)).collect()))
    rows, trades = adapter.unnumbered(spark, SF), catalog.Domain.of(spark, SF).trades
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString() and rows.exceptAll(trades.select(*rows.columns)).count() == 0 and rows.count() == trades.count()
    days, known = adapter.day_range(spark, SF), {"trade_after_filing": F.col("filed_on") < "1997-01-01"}
    assert all(sorted(map(tuple, catalog.store.counted_rejects(t, days, known).collect())) == want for t in (rows, trades))
    assert len(want) == 3


def test_a_line_s_value_does_not_move_to_its_event(spark, shuffled):
    rows = catalog.Domain.of(spark, SF).lagged.withColumnRenamed("original_id", "duplicate_of_trade_id").selectExpr("*", "1 AS cluster_count")
    df = events.events(rows)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    moved = tree.split("RepartitionByExpression", 1)[1].splitlines()[1]  # what goes into the shuffle
    assert shuffled(df) == 1 and "_valued" in moved and "trade_value" not in moved.split("AS _valued")[-1]


def test_trades_move_once_to_be_ranked_by_size(spark, shuffled, monkeypatch):
    d, plans, keep = catalog.Domain.of(spark, SF), {}, features.stored
    monkeypatch.setattr(features, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    features.market_size_of(d.valued)
    assert len(re.findall("Exchange", plans["market-ranks"])) == 1 and "Generate" not in plans["market-ranks"]


def test_half_ranks_are_those_of_a_loop_over_days(spark):
    rng = random.Random(5)
    near = [(i, rng.choice("ab"), rng.randrange(500), float(rng.randrange(40)), rng.random() < 0.8) for i in range(1500)]
    far = [(1500 + i, "c" if i % 3 else f"k{i}", rng.choice([-700_000, 0, 3, 2_900_000]), float(i % 7), True) for i in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        for rows, days in ((near, None), (near, 90), (far + near, 400)):
            df = spark.createDataFrame(rows, "id int, k string, day int, value double, own boolean").repartition(3, "k")
            got = {r.id: r.halves for r in ranking.halves(df, ["k"], days).collect()}
            for i, k, day, value, _ in rows:
                seen = [v for _, q, e, v, own in rows if own and q == k and e < day and (days is None or e >= day - days)]
                assert got[i] == sum(2 * (v < value) + (v == value) for v in seen)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_filer_s_trades_move_once_to_be_ranked(spark, shuffled):
    df = features.own_size_of(catalog.Domain.of(spark, SF).valued)
    assert shuffled(df) == 1 and "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_sizes_are_found_with_no_join_of_trades_and_few_scores_held(spark, monkeypatch):
    d, plans, keep = catalog.Domain.of(spark, SF), {}, features.stored
    own, market = features.own_size(d.lagged).withColumnRenamed("score", "o"), features.market_size(d.lagged).withColumnRenamed("score", "m")
    want = own.join(market, "trade_id", "full_outer").select("trade_id", F.coalesce("o", "m").alias("size_score"), F.when(F.col("o").isNotNull(), "filer").otherwise("market").alias("size_basis"))
    monkeypatch.setattr(features, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    got = features.sizes_of(d.valued)
    assert len(re.findall("Exchange", plans["market-ranks"])) == 2 and "Join" not in plans["market-ranks"]
    assert want.exceptAll(got).count() == 0 and got.count() == want.count() and got.groupBy("size_basis").count().count() == 2
    few = spark.createDataFrame([("filer", 0.25), ("filer", 0.5), ("market", 0.1), ("market", 0.2), ("market", 0.9), ("market", None)], "size_basis string, size_score double")
    table = reports.size_basis(few)
    assert "percentile" not in table._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, table.collect())) == [("filer", 2, 0.375), ("market", 3, 0.2), ("none", 1, None)]
    assert sorted(map(tuple, reports.size_basis(few.filter("size_score is not null"), 9).collect())) == [("filer", 2, 0.375), ("market", 3, 0.2), ("none", 4, None)]


def test_returns_meet_their_cuts_where_they_are(spark, shuffled):
    rows = spark.range(60).select((F.col("id") % 2).alias("h"), (F.col("id") / 7).alias("drift_pct"), (F.col("id") / 9).alias("r"), (F.col("id") % 5).alias("cluster"))
    top = lambda df: re.search(r"(\w+Join)", df._jdf.queryExecution().executedPlan().toString())[1]
    assert top(study.with_drift_quintile(rows, ["h"])) == "BroadcastHashJoin"
    assert top(study.contrast(rows, ["h"], F.col("r") > 3, "r", "cluster")) == "BroadcastHashJoin"
