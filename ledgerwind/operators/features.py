"""Point-in-time features of each disclosed trade; history is what had been filed strictly before, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions.calendars import business_days_between
from ledgerwind.functions.stored import small, stored
from ledgerwind.operators import ranking
from ledgerwind.operators.temporal import asof_all

# Business days to file, and weights by role.
DEADLINES = {"edgar": 2, "house": 31, "senate": 31}
ROLE_WEIGHTS = {"CEO": 1.0, "CFO": 1.0, "officer": 0.75, "director": 0.5, "10% owner": 0.25}
CLUSTER_DAYS, LEAST_FILINGS, LEAST_DEVIATION = 14, 3, 0.5
LEAST_OWN, MARKET_DAYS, LEAST_MARKET, PRICE_DAYS = 5, 365, 100, 5
#: Slices of the market's values at most, whatever the number of tasks, so that counts by slice and day can be broadcast.
MARKET_SLICES = 400


def lookup(column: str, values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col(column)]


def trade_value(shares: str = "shares", price: str = "price", amounts: tuple[str, str] | None = None) -> Column:
    """shares * price where both are positive, exact before it becomes a double; else the middle of an amount range, if one is named."""
    exact = F.when((F.col(shares) > 0) & (F.col(price) > 0), (F.col(shares) * F.col(price)).cast("double"))
    if amounts is None:
        return exact
    low, high = map(F.col, amounts)
    return F.coalesce(exact, F.when(low.isNotNull() & (high > 0), (low + high).cast("double") / 2))


def lags(dated: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """dated with lag_days (null for trades after their filing), lag_ratio, days_since_filing, role_weight and trade_value."""
    df = business_days_between(dated, days, "trade_date", "filing_date", "sec", "lag")
    df = business_days_between(df.withColumn("_as_of", F.lit(as_of).cast("date")), days, "filing_date", "_as_of", "nyse", "since").drop("_as_of")
    lag = F.when(F.col("lag") >= 0, F.col("lag"))
    return (
        df.withColumn("lag_days", lag.cast("int"))
        .withColumn("lag_ratio", F.col("lag_days") / lookup("source", DEADLINES).cast("double"))
        .withColumn("days_since_filing", F.greatest(F.col("since"), F.lit(0)).cast("int"))
        .withColumn("role_weight", lookup("role", ROLE_WEIGHTS))
        .withColumn("trade_value", trade_value())
        .drop("since")
    )


def filer_lag_zscore(lagged: DataFrame) -> DataFrame:
    """(trade_id, zscore) against the filer's earlier filings: one lag each, the largest; no amendments or duplicates."""
    own = F.coalesce(F.col("kind").isNull() & ~F.col("document_type").like("%/A"), F.lit(False))
    day = F.datediff("filing_date", F.lit("1970-01-01").cast("date"))
    rows = lagged.filter("lag_days is not null and filer_id is not null").select("trade_id", "filer_id", day.alias("day"), "filing_id", "lag_days", own.alias("own"))
    # trades move once, to their filer, and are sorted once: each window's order begins the one before
    filing, number = Window.partitionBy("filer_id", "day", "filing_id"), F.row_number()
    rows = rows.repartition("filer_id").withColumn("_k", number.over(filing.orderBy("trade_id")))
    rows = rows.withColumn("lag", F.max(F.when(F.col("own"), F.col("lag_days"))).over(filing).cast("long")).withColumn("lag", F.when(F.col("_k") == 1, F.col("lag")))
    earlier = Window.partitionBy("filer_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    sums = {"hn": F.count("lag"), "hs": F.sum("lag"), "hq": F.sum(F.col("lag") * F.col("lag"))}
    rows = rows.withColumns({name: c.over(earlier) for name, c in sums.items()}).filter(F.col("hn") >= LEAST_FILINGS)
    mean = F.col("hs") / F.col("hn")
    spread = F.sqrt(F.greatest((F.col("hq") * F.col("hn") - F.col("hs") * F.col("hs")).cast("double"), F.lit(0.0))) / F.col("hn")
    return rows.select("trade_id", ((F.col("lag_days") - mean) / F.greatest(spread, F.lit(LEAST_DEVIATION))).alias("filer_lag_zscore"))


def valued(dated: DataFrame) -> DataFrame:
    """(trade_id, filer_id, side, day, value, own) of trades that have a value; own ones are history, others are only asked about."""
    day = F.datediff("filing_date", F.lit("1970-01-01").cast("date"))
    return dated.filter("trade_value is not null").select("trade_id", "filer_id", "side", day.alias("day"), F.col("trade_value").alias("value"), F.col("kind").isNull().alias("own"))


def own_size(lagged: DataFrame) -> DataFrame:
    """(trade_id, n, score): the value's mid-rank among the filer's earlier values of the same side."""
    return own_size_of(valued(lagged))


def own_size_of(rows: DataFrame) -> DataFrame:
    """own_size() of valued() rows, which move once, to their filer; a filer's are one task, sorted and spilled."""
    ranked = _own_ranked(rows.filter("filer_id is not null and side is not null").repartition("filer_id", "side"))
    return ranked.filter(F.col("own_n") >= LEAST_OWN).select("trade_id", F.col("own_n").alias("n"), (F.col("own_halves") / 2 / F.col("own_n")).alias("score"))


def _own_ranked(rows: DataFrame) -> DataFrame:
    """valued() rows, where their filer's are, with own_n and own_halves of the filer's earlier values of the same side."""
    keys = ["filer_id", "side"]
    earlier = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return ranking.halves(rows.withColumn("own_n", F.sum(F.col("own").cast("long")).over(earlier)), keys).withColumnRenamed("halves", "own_halves")


def market_size(lagged: DataFrame, slices: int = MARKET_SLICES) -> DataFrame:
    """(trade_id, n, score): the value's mid-rank among all values of its side filed in the 365 days before."""
    return market_size_of(valued(lagged), slices)


def market_size_of(rows: DataFrame, slices: int = MARKET_SLICES) -> DataFrame:
    """market_size() of valued() rows."""
    return _market_ranked(rows.filter("side is not null").drop("filer_id"), slices).filter("n is not null").select("trade_id", "n", "score")


def _market_ranked(rows: DataFrame, slices: int = MARKET_SLICES) -> DataFrame:
    """valued() rows with n and score of market_size(), null with too few values; they move once, to a slice of their side's values.

    Within its slice a row is ranked in the order of values; what lower slices have in its days follows from counts by slice
    and day, of which there are as many as days in a slice. Equal values of a side are one task, sorted and spilled.
    """
    tasks = min(slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(tasks, "side", "value").withColumn("slice", F.spark_partition_id())
    ranked = stored(ranking.halves(dealt, ["side"], MARKET_DAYS).drop("value"), "market-ranks")
    counts = stored(ranked.groupBy("side", "slice", "day").agg(F.count_if("own").alias("m")), "market-counts")
    year = Window.orderBy("day").rangeBetween(-MARKET_DAYS, -1)
    days = counts.groupBy("side", "day").agg(F.sum("m").alias("_m")).withColumn("n", F.sum("_m").over(year.partitionBy("side"))).drop("_m")  # a row a side and date
    every = counts.select("side", "slice").distinct().join(days, "side").join(counts, ["side", "slice", "day"], "left").na.fill(0, ["m"])
    below = F.sum("m").over(Window.partitionBy("side", "day").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    lower = every.withColumn("_b", F.coalesce(below, F.lit(0))).withColumn("lower", F.sum("_b").over(year.partitionBy("side", "slice"))).filter(F.col("n") >= LEAST_MARKET)
    lower = small(stored(lower.select("side", "slice", "day", "n", "lower"), "market-lower"))
    return ranked.join(lower, ["side", "slice", "day"], "left").withColumn("score", (F.col("lower") + F.col("halves") / 2) / F.col("n"))


def sizes(lagged: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """(trade_id, size_score, size_basis): among the filer's own values if there are enough, else the market's; market has rows of its own, if they are others."""
    if market is None:
        return sizes_of(valued(lagged))
    own, market = own_size(lagged).select("trade_id", F.col("score").alias("own")), market_size(market).select("trade_id", F.col("score").alias("market"))
    both = own.join(market, "trade_id", "full_outer")
    return both.select("trade_id", F.coalesce("own", "market").alias("size_score"), F.when(F.col("own").isNotNull(), "filer").otherwise("market").alias("size_basis"))


def sizes_of(rows: DataFrame) -> DataFrame:
    """sizes() of valued() rows that are the market's as well: they move to their filer, and on to the market with what was found there; none is joined."""
    own = F.when(F.col("own_n") >= LEAST_OWN, F.col("own_halves") / 2 / F.col("own_n"))
    rows = rows.filter("side is not null")
    told = _own_ranked(rows.filter("filer_id is not null").repartition("filer_id", "side")).unionByName(rows.filter("filer_id is null"), allowMissingColumns=True)
    ranked = _market_ranked(told.withColumn("own_score", own).drop("filer_id", "own_n", "own_halves")).withColumn("size_score", F.coalesce("own_score", "score"))
    return ranked.filter("size_score is not null").select("trade_id", "size_score", F.when(F.col("own_score").isNotNull(), "filer").otherwise("market").alias("size_basis"))


#: Days of one piece of a ticker's time line in counts of clusters.
CLUSTER_PIECE = 60


def cluster_counts(dated: DataFrame, *kept: str) -> DataFrame:
    """(trade_id, cluster_count): filers of the same ticker and side with a trade within 14 days either way, filed by then.

    A filer counts from the earliest filing of each trade date, so history is one row a (ticker, side, date, filer) and
    questions one a (ticker, side, date, filing date). Both are dealt out once, by pieces of time, so a hot ticker is many
    groups; they are made distinct, met and counted where they are, as a question's piece follows from its date.
    Duplicates are no history; a duplicate's count is that of the first original. kept names columns to return as well,
    with ticker, side and filing_date.
    """
    keys, at, question = ["ticker", "side"], ["ticker", "side", "p"], ["trade_date", "filing_date"]
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    piece = lambda by: F.floor((day + by) / CLUSTER_PIECE)
    own = dated.filter("ticker is not null and kind is null")
    asked = own.select(*keys, piece(0).alias("p"), *question).repartition(*at).distinct()
    history = own.select(*keys, F.explode(F.sequence(piece(-CLUSTER_DAYS), piece(CLUSTER_DAYS))).alias("p"), F.col("trade_date").alias("d"), "filer_id", "filing_date").repartition(*at)
    history = history.groupBy(*at, "d", "filer_id").agg(F.min("filing_date").alias("known"))
    near = asked.join(history, at).filter(F.abs(F.datediff("d", "trade_date")) <= CLUSTER_DAYS).filter("known <= filing_date")
    counts = near.groupBy(*at, *question).agg(F.countDistinct("filer_id").cast("int").alias("cluster_count")).drop("p")
    rows = own.select(*dict.fromkeys(("trade_id", *keys, *question, *kept))).join(counts, [*keys, *question])
    return rows.select("trade_id", "cluster_count", *((*keys, "filing_date", *kept) if kept else ()))


def inherited(dated: DataFrame, counts: DataFrame) -> DataFrame:
    """counts with those of duplicates: through their originals, over two steps (an amendment of a repeated line)."""
    dup = dated.filter("kind is not null").select("trade_id", "original_id")
    step = dup.join(dup.select(F.col("trade_id").alias("original_id"), F.col("original_id").alias("root")), "original_id", "left")
    root = step.select("trade_id", F.coalesce("root", "original_id").alias("root"))
    return counts.unionByName(root.join(counts.withColumnRenamed("trade_id", "root"), "root").select("trade_id", "cluster_count"))


def drift(dated: DataFrame, bars: DataFrame) -> DataFrame:
    """dated with trade and filing closes, at most five days old, and drift_pct, positive if the move went the trade's way."""
    closes = bars.filter("adj_close > 0").select("ticker", "date", "adj_close")
    df = asof_all(dated, closes, "ticker", [("trade_date", ["adj_close"], "at_trade", PRICE_DAYS, False), ("filing_date", ["adj_close"], "at_filing", PRICE_DAYS, False)])
    move = (F.col("at_filing_adj_close") / F.col("at_trade_adj_close") - 1) * 100
    return df.withColumn("drift_pct", F.when(F.col("lag") >= 0, F.when(F.col("side") == "sell", -move).otherwise(move)))


def features(lagged: DataFrame, bars: DataFrame) -> DataFrame:
    """One row a trade with all features and its flags in their order."""
    return assembled(lagged, bars, filer_lag_zscore(lagged), sizes(lagged), inherited(lagged, cluster_counts(lagged)))


def assembled(lagged: DataFrame, bars: DataFrame, *sides: DataFrame) -> DataFrame:
    """lagged with drift, the features of sides by trade_id, and flags."""
    df = drift(lagged, bars)
    known = bars.filter("adj_close > 0").select(F.col("ticker").alias("_t")).distinct().withColumn("priced", F.lit(True))
    for side in sides:
        df = df.join(side, "trade_id", "left")
    df = df.join(known, df["ticker"] == known["_t"], "left").drop("_t")
    seen = (F.col("lag") >= 0) & F.col("ticker").isNotNull()
    flags = F.array_compact(F.array(
        F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("amends_filing_id").isNotNull() | F.col("document_type").endswith("/A"), "amendment"),
        F.when(F.col("is_10b5_1"), "10b5_1"), F.when(F.col("lag") < 0, "trade_after_filing"), F.when(F.col("trade_value").isNull(), "no_value"),
        F.when(F.col("ticker").isNull(), "no_ticker"), F.when(seen & F.col("priced").isNull(), "no_prices"),
        F.when(seen & F.col("priced") & F.col("at_trade_date").isNull(), "no_trade_price"), F.when(seen & F.col("priced") & F.col("at_filing_date").isNull(), "no_filing_price"),
    ))
    return df.withColumn("flags", flags).withColumnRenamed("original_id", "duplicate_of_trade_id").drop("priced", "lag", "kind")
