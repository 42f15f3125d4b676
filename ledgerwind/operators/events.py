"""Events: disclosed lines of one filer, ticker, side and filing date; and what keeps lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.functions.calendars import add_business_days, with_ordinal

KEYS = ["filer_id", "ticker", "side", "filing_date"]
EASTERN = "America/New_York"


def line_reason() -> Column:
    """Why a line is in no event; null for those that are. The first reason that holds counts."""
    return (
        F.when(F.col("filing_date").isNull(), "no_features")
        .when(F.col("duplicate_of_trade_id").isNotNull(), "duplicate")
        .when(F.col("document_type").endswith("/A"), "amendment")
        .when(F.col("lag_days").isNull(), "trade_after_filing")
        .when(F.coalesce(F.col("ticker"), F.lit("")) == "", "no_ticker")
    )


def exclusions(features: DataFrame, events: DataFrame) -> DataFrame:
    """(reason, n): lines by reason, all lines, and events."""
    rows = features.groupBy(line_reason().alias("reason")).agg(F.count("*").alias("n"))
    lines = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("lines").alias("reason"), "n")
    made = events.agg(F.count("*").alias("n")).select(F.lit("events").alias("reason"), "n")
    return rows.filter("reason is not null").unionByName(lines).unionByName(made)


def _account() -> Column:
    return F.when(F.coalesce(F.col("owner"), F.lit("")) == "", "self").otherwise(F.col("owner"))


def _held(lines: DataFrame, first: dict[str, Column], then: dict[str, Column]) -> DataFrame:
    """(keys, held_before, then): by account first, where `first` names further figures, then by event; lines move once, to their events."""
    missing = F.col("owned_after").isNull() | F.col("shares").isNull()
    figures = {"_held": F.min(F.col("owned_after") - F.col("shares")), "_missing": F.max(missing), **first}
    per = lines.repartition(*KEYS).groupBy(*KEYS, _account().alias("account")).agg(*(c.alias(name) for name, c in figures.items()))
    return per.groupBy(*KEYS).agg(F.when(~F.max("_missing"), F.sum("_held").cast("double")).alias("held_before"), *(c.alias(name) for name, c in then.items()))


def holdings(lines: DataFrame) -> DataFrame:
    """(keys, held_before): shares held before the first line, the least per account and summed; null if a line lacks them."""
    return _held(lines, {}, {})


def events(features: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row an event. Ties are settled by trade_id; sums are of lines with a value, exact before they become doubles.

    Cluster counts are a column of features, or those of clusters (keys, cluster_count), a row an event.
    """
    valued = F.col("_valued")  # told before lines move, so that the value itself does not
    lines = features.withColumn("reason", line_reason()).filter("reason is null").withColumn("_valued", F.col("trade_value").isNotNull() & (F.col("shares") > 0))
    by_role = F.when(F.col("role_weight").isNotNull(), F.struct("role_weight", -F.col("trade_id"), "role"))
    first = {
        "_issuer": F.min(F.struct("trade_id", "issuer")),
        "_first": F.min("trade_date"),
        "_last": F.max("trade_date"),
        "_lag": F.max(F.struct("lag_days", F.coalesce("lag_ratio", F.lit(0.0)).alias("ratio"))),
        "_value": F.sum(F.when(valued, F.col("shares") * F.col("price"))),
        "_shares": F.sum(F.when(valued, F.col("shares"))),
        "_role": F.max(by_role),
        "_plan": F.max("is_10b5_1"),
        "_n": F.count("*"),
        "_filings": F.collect_set("filing_id"),
    }
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    then = {
        "issuer": F.min("_issuer")["issuer"],
        "first_trade_date": F.min("_first"),
        "last_trade_date": F.max("_last"),
        "lag_days": F.max("_lag")["lag_days"],
        "lag_ratio": F.max("_lag")["ratio"],
        "value": total("_value"),
        "shares": total("_shares"),
        "role_weight": F.max("_role")["role_weight"],
        "role": F.max("_role")["role"],
        "is_10b5_1": F.max("_plan"),
        "n_lines": F.sum("_n"),
        "n_filings": F.size(F.array_distinct(F.flatten(F.collect_list("_filings")))).cast("long"),
    }
    if clusters is None:
        first["_clusters"], then["cluster_count"] = F.max(F.coalesce("cluster_count", F.lit(0))), F.max("_clusters")
    out = _held(lines, first, then)
    if clusters is not None:
        out = out.join(clusters, KEYS, "left").withColumn("cluster_count", F.coalesce("cluster_count", F.lit(0)))
    return out.withColumn("avg_price", F.when((F.col("shares") > 0) & (F.col("value") > 0), F.col("value") / F.col("shares")))


def entry_dates(df: DataFrame, days: DataFrame, filing_date: str, accepted_at: str | None, out: str) -> DataFrame:
    """df with the first session at whose open a filing could be traded.

    With a time of acceptance (UTC): that day if it is a session and the time is before 9:30 Eastern, else the next
    session after that day. Without one: the next session after the filing date.
    """
    if accepted_at is None:
        return add_business_days(df, days, filing_date, 1, "nyse", out)
    local = F.from_utc_timestamp(F.col(accepted_at), EASTERN)
    early = F.date_format(local, "HH:mm:ss") < "09:30:00"
    df = df.withColumn("_day", F.coalesce(local.cast("date"), F.col(filing_date))).withColumn("_early", F.coalesce(early, F.lit(False)))
    session = F.broadcast(days.select(F.col("d").alias("_d"), "is_nyse"))
    df = add_business_days(df.join(session, F.col("_day") == F.col("_d"), "left"), days, "_day", 1, "nyse", "_next")
    return df.withColumn(out, F.when(F.col("_early") & F.col("is_nyse"), F.col("_day")).otherwise(F.col("_next"))).drop("_day", "_early", "_d", "is_nyse", "_next")


def ordinal(df: DataFrame, days: DataFrame, column: str, out: str) -> DataFrame:
    return with_ordinal(df, days, column, "nyse", out)
