"""Schemas of the stored tables, in the order in which a new store makes them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

_DDL = {
    "filers": "filer_id long, cik string, name string, first_seen timestamp",
    "filings": "filing_id long, accession string, source string, document_type string, filer_id long, issuer_cik string, issuer_name string, period date, filed_at timestamp, accepted_at timestamp, original_filed_on date, amends_filing_id long, owner_ciks array<string>, url string",
    "trades": "trade_id long, filing_id long, line_no int, ticker string, side string, trade_date date, shares decimal(28,8), price decimal(28,8), amount_low decimal(28,8), amount_high decimal(28,8), role string, owner string, owned_after decimal(28,8), is_10b5_1 boolean",
    "ticker_history": "issuer_cik string, ticker string, first_seen date, last_seen date",
    "daily_prices": "ticker string, date date, open double, high double, low double, close double, adj_open double, adj_close double, volume long, source string",
    "price_status": "ticker string, status string, detail string, last_attempt timestamp",
    "api_calls": "at timestamp, ticker string, outcome string",
    "trade_features": "trade_id long, computed_at timestamp, feature_version int, filing_date date, lag_days int, lag_ratio double, drift_pct double, days_since_filing int, filer_lag_zscore double, cluster_count int, role_weight double, size_score double, size_basis string, trade_value double, duplicate_of_trade_id long, flags array<string>",
    "validation_rejects": "trade_id long, rule string",
}


def schemas() -> dict[str, StructType]:
    """Needs a session."""
    return {name: StructType.fromDDL(ddl) for name, ddl in _DDL.items()}


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables under a folder, for those that are not there yet."""
    for name, schema in schemas().items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
