"""Coverage, quality and planning reports: small aggregates of large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions.stored import stored
from ledgerwind.functions.calendars import quarter_bounds
from ledgerwind.functions.text import eastern_date
from ledgerwind.operators import ranking
from ledgerwind.operators.temporal import met

#: States of a ticker that need no further load.
DONE = ("ok", "not_found", "empty", "failed")

# Edges of the lag histogram.
LAG_LABELS = ["0", "1", "2", "3-5", "6-10", "11-30", "31-45", "46+"]


def share(condition: Column) -> Column:
    """Percent of rows, to two places."""
    return F.round(100.0 * F.count_if(condition) / F.count("*"), 2)


def coverage(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(source, year, trades, with_ticker, priced): priced trades have a bar within a week from the trade date."""
    rows = trades.select("source", F.year("filed_on").alias("year"), "ticker", "trade_date")
    near = met(rows, bars, "ticker", "trade_date", 7, "priced")
    return near.groupBy("source", "year").agg(F.count("*").alias("trades"), share(F.col("ticker").isNotNull()).alias("with_ticker"), share(F.col("priced")).alias("priced"))


def lag_histogram(lagged: DataFrame, n: Column | None = None) -> DataFrame:
    """(bucket, n) with empty buckets; negative lags count as 0. A row counts once, or n times where rows are counted before."""
    lag = F.greatest("lag", F.lit(0))
    label = F.when(lag <= 2, lag.cast("string")).when(lag <= 5, "3-5").when(lag <= 10, "6-10").when(lag <= 30, "11-30").when(lag <= 45, "31-45").otherwise("46+")
    every = lagged.sparkSession.createDataFrame([(x,) for x in LAG_LABELS], "bucket string")
    return every.join(lagged.groupBy(label.alias("bucket")).agg((F.count("*") if n is None else F.sum(n)).alias("n")), "bucket", "left").na.fill(0, ["n"])


def feature_coverage(features: DataFrame, names: list[str]) -> DataFrame:
    """(side, trades, percent of rows that have each feature)."""
    return features.groupBy("side").agg(F.count("*").alias("trades"), *(share(F.col(n).isNotNull()).alias(n) for n in names))


def ratio_buckets(features: DataFrame) -> DataFrame:
    """(bucket, trades, buy_drift, sell_drift): medians by lag ratio."""
    x = F.col("lag_ratio")
    bucket = F.when(x <= 0.5, "<=0.5").when(x <= 1, "0.5-1").when(x <= 2, "1-2").otherwise(">2")
    median = lambda side: F.expr(f"percentile(drift_pct, 0.5) filter (where side = '{side}')")
    return features.filter("lag_ratio is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("trades"), median("buy").alias("buy_drift"), median("sell").alias("sell_drift"))


def drift_percentiles(features: DataFrame) -> DataFrame:
    """(side, n, p5, p25, p50, p75, p95), interpolated."""
    points = (5, 25, 50, 75, 95)
    rows = features.filter("drift_pct is not null").groupBy("side").agg(F.count("*").alias("n"), F.percentile("drift_pct", [p / 100 for p in points]).alias("q"))
    return rows.select("side", "n", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate(points)))


def mix(features: DataFrame, column: str, name: str) -> DataFrame:
    return features.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("none")).alias(name)).agg(F.count("*").alias("n"))


def flag_counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def zscore_buckets(features: DataFrame) -> DataFrame:
    """(bucket, trades): how unusual lags are for their filers."""
    z = F.col("filer_lag_zscore")
    bucket = F.when(z < -1, "a: faster than usual (<-1)").when(z <= 1, "b: usual (-1..1)").when(z <= 3, "c: later (1..3)").otherwise("d: much later (>3)")
    return features.filter(z.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("trades"))


def size_basis(features: DataFrame, trades: int | None = None) -> DataFrame:
    """(basis, trades, median): what size scores are relative to; where only trades with a score are given, of how many trades.

    Scores are put in order as slices, as distinct ones are nearly as many as trades.
    """
    basis = F.coalesce(F.when(F.col("size_score").isNotNull(), F.col("size_basis")), F.lit("none"))
    rows = stored(features.select(basis.alias("basis"), "size_score"), "size-scores")
    counts = rows.groupBy("basis").agg(F.count("*").alias("trades"))  # three rows at most
    if trades is not None and (rest := trades - rows.count()):
        counts = counts.unionByName(rows.sparkSession.range(1).select(F.lit("none").alias("basis"), F.lit(rest).cast("long").alias("trades")))
    middles = ranking.order_statistics(rows, ["basis"], "size_score", {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    return counts.join(middles, "basis", "left").select("basis", "trades", ((F.col("low") + F.col("high")) / 2).alias("median"))


def amendment_linkage(filings: DataFrame, links: DataFrame) -> DataFrame:
    """(amendments, linked): amendments, and those whose original is known."""
    return filings.filter("document_type like '%/A'").select("filing_id").join(links, "filing_id", "left").agg(F.count("*").alias("amendments"), F.count("original_id").alias("linked"))


def ended_early(legs: DataFrame) -> DataFrame:
    """(h, ended_early, legs): legs whose prices stopped before the horizon."""
    return legs.groupBy("h").agg(F.count_if("ended_early").alias("ended_early"), F.count("*").alias("legs"))


def status_pairs(primary: DataFrame, other: DataFrame, keys: list[str], top: int = 8) -> DataFrame:
    """(primary, other, n): the most frequent pairs of statuses on which two sources disagree, ties by name."""
    both = primary.select(*keys, F.col("status").alias("primary")).join(other.select(*keys, F.col("status").alias("other")), keys).filter("primary <> other")
    return both.groupBy("primary", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary", "other").limit(top)


#: What a price vendor's symbols look like.
PLAUSIBLE = r"^[A-Z][A-Z0-9]{0,5}([.-][A-Z0-9]{1,2})?$"


def universe(trades: DataFrame, filed_at: str | None = None) -> DataFrame:
    """(quarter, ticker, buys, trades) by the quarter of filing, the Eastern one if a UTC time of filing is named; plausible tickers only."""
    day = F.col("filed_on") if filed_at is None else eastern_date(F.col(filed_at))
    quarter = F.concat(F.year(day).cast("string"), F.lit("q"), F.quarter(day).cast("string"))
    return trades.filter(F.col("ticker").rlike(PLAUSIBLE)).groupBy(quarter.alias("quarter"), "ticker").agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count("*").alias("trades"))


def price_queue(wanted: DataFrame, latest: DataFrame, status: DataFrame, budget: int) -> DataFrame:
    """(place, ticker, from_date): tickers to load, never-loaded ones first, then by name; those without data are left out."""
    df = wanted.select("ticker").distinct().join(latest, "ticker", "left").join(status.select("ticker", "state"), "ticker", "left").filter("state is null or state <> 'not_found'")
    first = df.select(F.col("last_date").isNotNull().alias("loaded"), "ticker", F.date_add("last_date", 1).alias("from_date")).orderBy("loaded", "ticker").limit(budget)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("loaded", "ticker"))).drop("loaded")  # at most `budget` rows


def fetch_queue(wanted: DataFrame, status: DataFrame, groups: list[list[str]], first: tuple[str, ...], now: str, retry: str = "6 hours") -> DataFrame:
    """(place, ticker): tickers still to load, each once, from (quarter, ticker, buys, trades) and (ticker, status, last_attempt).

    Benchmarks come first, then group by group tickers with buys in the group, by the order of quarters, most buys, most
    trades and name, then the group's others. Those done are left out, and errors until they may be tried again.
    """
    where = wanted.sparkSession.createDataFrame([(q, g, i) for g, quarters in enumerate(groups) for i, q in enumerate(quarters)], "quarter string, g int, i int")
    rows = wanted.join(F.broadcast(where), "quarter")  # as many rows as quarters are named
    rows = rows.withColumn("no_buys", F.max("buys").over(Window.partitionBy("g", "ticker")) <= 0)
    order = F.struct("g", "no_buys", "i", (-F.col("buys")).alias("b"), (-F.col("trades")).alias("t"))
    best = rows.groupBy("ticker").agg(F.min(order).alias("o"))
    lead = wanted.sparkSession.createDataFrame([(t, i) for i, t in enumerate(first)], "ticker string, lead int")
    every = best.join(F.broadcast(lead), "ticker", "full_outer")
    done = F.col("status").isin(*DONE) | ((F.col("status") == "error") & (F.lit(now).cast("timestamp") - F.col("last_attempt") < F.expr(f"interval {retry}")))
    left = every.join(status, "ticker", "left").filter(~F.coalesce(done, F.lit(False)))
    numbered = ranking.numbered(left.select("ticker", F.coalesce("lead", F.lit(len(first))).alias("lead"), "o.*"), [], [F.col(c) for c in ("lead", "g", "no_buys", "i", "b", "t", "ticker")], "place")
    return numbered.select(F.col("place").cast("int").alias("place"), "ticker")


def cache_coverage(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(quarter, tickers, covered, out_of_range, pending) from (quarter, ticker) and (ticker, first, last)."""
    start, end = quarter_bounds(F.col("quarter"))
    df = wanted.join(held, "ticker", "left").withColumn("start", start).withColumn("end", end)
    overlap = (F.col("first") <= F.col("end")) & (F.col("last") >= F.col("start"))
    return df.groupBy("quarter").agg(F.countDistinct("ticker").alias("tickers"), F.count_if(overlap).alias("covered"), F.count_if(~overlap).alias("out_of_range"), F.count_if(F.col("first").isNull()).alias("pending"))


def coverage_by_status(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """By quarter of (quarter, ticker, buys, trades), how far bars cover it, from (ticker, status, first, last).

    A ticker with bars (ok) is covered if these meet the quarter, else out of range; empty counts as not found, an error as
    failed, and a ticker without status as pending. Statuses of other names count for tickers, buys and trades only.
    """
    start, end = quarter_bounds(F.col("quarter"))
    df = wanted.join(status, "ticker", "left").withColumn("start", start).withColumn("end", end).withColumn("status", F.coalesce("status", F.lit("pending")))
    ok = F.col("status") == "ok"
    covered = ok & (F.col("first") <= F.col("end")) & (F.col("last") >= F.col("start"))
    count = lambda name, condition: F.count_if(condition).alias(name)
    sums = [f(c).alias(n) for c in ("buys", "trades") for n, f in ((c, F.sum), (f"{c}_covered", lambda c: F.coalesce(F.sum(F.when(covered, F.col(c))), F.lit(0))))]
    return df.groupBy("quarter").agg(F.count("*").alias("tickers"), count("covered", covered), *sums, count("out_of_range", ok & ~F.coalesce(covered, F.lit(False))), count("not_found", F.col("status").isin("not_found", "empty")), count("failed", F.col("status").isin("failed", "error")), count("pending", F.col("status") == "pending"))


def quota_usage(calls: DataFrame, key: str, at: str, symbol: str, now: str) -> DataFrame:
    """(key, last_hour, last_day, symbols_this_month) as of a time."""
    now, t = F.lit(now).cast("timestamp_ntz"), F.col(at)
    rows = calls.filter(t <= now)
    return rows.groupBy(key).agg(F.count_if(t > now - F.expr("interval 1 hour")).alias("last_hour"), F.count_if(t > now - F.expr("interval 1 day")).alias("last_day"), F.countDistinct(F.when(F.trunc(t.cast("date"), "month") == F.trunc(now.cast("date"), "month"), F.col(symbol))).alias("symbols_this_month"))


def join_keys(primary: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two sources of the same returns: (both, only_primary, only_other, close, median_difference, mean_difference, mean_primary, mean_other, correlation).

    The median is the upper one of the absolute differences.
    """
    a, b = (df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias(n)) for df, n in ((primary, "a"), (other, "b")))
    both, gap = F.col("a").isNotNull() & F.col("b").isNotNull(), F.abs(F.col("a") - F.col("b"))
    rows = stored(a.join(b, keys, "full_outer").withColumn("gap", F.when(both, gap)), "sources")
    middle = ranking.order_statistics(rows, [], "gap", {"median_difference": F.floor(F.col("n") / 2)})
    of = lambda c: F.when(both, F.col(c))
    out = rows.agg(F.count_if(both).alias("both"), F.count_if(F.col("b").isNull()).alias("only_primary"), F.count_if(F.col("a").isNull()).alias("only_other"), F.count_if(F.col("gap") <= 0.005).alias("close"), F.avg("gap").alias("mean_difference"), F.avg(of("a")).alias("mean_primary"), F.avg(of("b")).alias("mean_other"), F.corr(of("a"), of("b")).alias("correlation"))
    return out.crossJoin(middle)  # one row each
