"""Registered queries against their DuckDB SQL, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerwind.functions import stored
from ledgerwind.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["calendar_days", "duplicate_lines_amendment", "filer_lag_zscore", "market_size_percentile", "trade_features", "event_status", "event_legs", "contrasts", "component_buckets", "link_amendments", "upsert_prices", "events_rate_windows", "price_queue", "normal_equations", "year_table", "quarter_lines", "pit_replay", "fill_counts"]


def plain(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert rows == sorted(tuple(plain(x) for x in r) for r in got.select(*sorted(got.columns)).collect())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"fitted_weights", "portfolio_daily"} <= set(entry.queries())


def test_domain_tables_are_shared_and_made_anew_when_gone(spark):
    one = catalog.Domain.of(spark, SF)
    assert one.trades.count() > 0 and catalog.Domain.of(spark, SF) is one
    stored.clear(spark)
    two = catalog.Domain.of(spark, SF)
    assert two is not one and two.trades.count() > 0 and catalog.Domain.of(spark, SF) is two


def test_rate_windows_are_all_there_open_ones_too(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    rows = entry.queries()["events_rate_windows"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == 2 * n  # an hour every half hour: a row is in two windows


def test_status_import_adds_unstored_tickers_and_writes_over_stored_ones(spark):
    n, rows = spark.read.parquet(f"{SF}/supplier.parquet").count(), entry.queries()["price_status_import"](spark, SF).collect()
    stored_before, added = ([r for r in rows if r["ticker"][0] == c] for c in "SN")
    assert len(stored_before) == n and {r["detail"] for r in stored_before} == {"old", "new"}
    assert 0 < len(added) < n and {r["detail"] for r in added} == {"new"}  # a pending one is not added
