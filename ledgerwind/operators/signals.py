"""Signals of each event that were known at its entry, and their buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.operators.evaluate import Study
from ledgerwind.operators.events import KEYS
from ledgerwind.operators.temporal import running

REPEAT_DAYS, LEAST_TRACK, NEW_STAKE = 730, 2, 10.0
MOST_DRIFT = 0.20


def stake_change(shares: str, held: str) -> Column:
    """Shares bought over shares held before, NEW_STAKE at most and for a first stake."""
    bought = F.when(F.col(held) <= 0, NEW_STAKE).otherwise(F.least(F.try_divide(F.col(shares), F.col(held)), F.lit(NEW_STAKE)))
    return F.when(F.col(held).isNotNull() & (F.col(shares) > 0), bought)


def repeat_buys(events: DataFrame) -> DataFrame:
    """(keys, repeat_buys): the filer's buy events of the ticker filed in the 730 days before, that day left out."""
    buys = events.filter("side = 'buy'").groupBy("filer_id", "ticker", "filing_date").agg(F.count("*").alias("n"))
    counts = running(buys, ["filer_id", "ticker"], "filing_date", {"repeat_buys": "n"}, REPEAT_DAYS)
    out = events.select(*KEYS).join(counts, ["filer_id", "ticker", "filing_date"], "left")
    return out.select(*KEYS, F.when(F.col("side") == "buy", F.coalesce("repeat_buys", F.lit(0))).otherwise(0).cast("int").alias("repeat_buys"))


def track_record(results: DataFrame, returns: DataFrame) -> DataFrame:
    """(keys, track_n, track_record): mean 20-session excess of the filer's earlier buys that had ended before entry."""
    known = returns.filter("h = 20 and side = 'buy' and not is_10b5_1 and r is not null").groupBy("filer_id", F.col("exit").alias("d")).agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    asked = results.select(*KEYS, F.coalesce("entry", "planned").alias("d"))
    days = asked.select("filer_id", "d").distinct().join(known, ["filer_id", "d"], "full_outer").na.fill(0).na.fill(0.0)
    history = running(days, ["filer_id"], "d", {"track_n": "n", "total": "s"})
    out = asked.join(history, ["filer_id", "d"])
    return out.select(*KEYS, F.col("track_n").cast("int").alias("track_n"), F.when(F.col("track_n") >= LEAST_TRACK, F.col("total") / F.col("track_n")).alias("track_record"))


def with_history(rows: DataFrame, columns: list[str], kept: Column | None = None) -> DataFrame:
    """columns of the kept rows (all, if none are named) with what repeat_buys() and track_record() find, from Study.at(20).

    Rows move once, to their filer: those that are kept with their columns, other buys with their days alone, and beside them
    the excess of each buy on the day it ended. Both counts are windows there, sorted and spilled, not held.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    kept, buy = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False)), F.col("side") == "buy"
    known = buy & ~F.col("is_10b5_1") & F.col("r").isNotNull()
    schema = rows.select(*columns).schema
    none = F.lit(None)
    event = F.struct(F.col("ticker").alias("t"), number(F.col("filing_date")).alias("f"), buy.cast("long").alias("b"), number(F.coalesce("entry", "planned")).alias("d"), none.cast("double").alias("s"), F.when(kept, F.struct(*columns)).alias("l"))
    ended = F.struct(none.cast("string").alias("t"), none.cast("int").alias("f"), F.lit(0).cast("long").alias("b"), number(F.col("exit")).alias("d"), F.col("r").alias("s"), none.cast(schema).alias("l"))
    both = rows.select("filer_id", F.explode(F.array_compact(F.array(F.when(kept | buy, event), F.when(known, ended)))).alias("q")).select(F.col("filer_id").alias("_filer"), "q.*").repartition("_filer")
    earlier = Window.partitionBy("_filer", "t").orderBy("f").rangeBetween(-REPEAT_DAYS, -1)
    both = both.withColumn("b", F.coalesce(F.sum("b").over(earlier), F.lit(0))).filter("l is not null or s is not null").drop("t", "f")
    upto = Window.partitionBy("_filer").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumns({"n": F.count("s").over(upto), "total": F.sum("s").over(upto)}).filter("l is not null and d is not null")
    out = found.select("l.*", F.col("b").alias("_b"), F.col("n").cast("int").alias("track_n"), F.when(F.col("n") >= LEAST_TRACK, F.col("total") / F.col("n")).alias("track_record"))
    return out.withColumn("repeat_buys", F.when(F.col("side") == "buy", F.col("_b")).otherwise(0).cast("int")).drop("_b")


def _measured(rows: DataFrame) -> DataFrame:
    """Study.at(20) with the signals that an event's own row tells; drift is a fraction in the trade's direction."""
    return rows.withColumn("stake_change", stake_change("shares", "held_before")).withColumn("drift", F.col("drift_pct") / 100)


def build(study: Study) -> DataFrame:
    """results with all signals."""
    return with_history(_measured(study.at(20)), [*study.results.columns, "stake_change", "drift"])


#: What listed events are known by, scored and traded with.
LISTED = [*KEYS, "entry", "entry_bar_no", "exit", "y", "r", "cost", "role", "value", "stake_change", "cluster_count", "drawdown", "dollar_volume", "drift"]


def listed(study: Study) -> DataFrame:
    """Listed events with their signals, y, their net 20-session return (null if it has not matured), r and exit.

    They are told apart before any row moves, by what build() has of an event without its filer's others. Sales add nothing to them.
    """
    return with_history(_measured(study.bought).withColumnRenamed("net", "y"), LISTED, shown())


def shown() -> Column:
    """Whether an event would be listed."""
    return (F.col("status") == "ok") & (F.col("side") == "buy") & ~F.col("is_10b5_1") & F.col("liquid") & (F.col("drift").isNull() | (F.col("drift") <= MOST_DRIFT))


# Each component's column, lower ends of its buckets but the first, the buckets' labels, and that of a missing value.
BUCKETS = {
    "value": ("value", [10e3, 50e3, 250e3, 1e6], ["<$10k", "$10k-50k", "$50k-250k", "$250k-1M", ">=$1M"], "<$10k"),
    "stake": ("stake_change", [0.05, 0.20, 1.0, NEW_STAKE], ["<5%", "5-20%", "20-100%", ">=100%", "new stake"], "unknown"),
    "cluster": ("cluster_count", [2, 3], ["1", "2", "3+"], "3+"),
    "repeat": ("repeat_buys", [1, 2, 4], ["0", "1", "2-3", "4+"], "0"),
    "drawdown": ("drawdown", [-0.45, -0.25, -0.10], ["<=-45%", "-45 to -25%", "-25 to -10%", "within 10%"], "unknown"),
    "track": ("track_record", [-0.05, 0.0, 0.05], ["< -5%", "-5 to 0%", "0 to 5%", ">= 5%"], "none yet"),
    "liquidity": ("dollar_volume", [1e6, 5e6, 50e6], ["<$1M/day", "$1-5M/day", "$5-50M/day", ">=$50M/day"], "<$1M/day"),
}


def components() -> dict[str, Column]:
    """Each component's bucket as a column expression over build()'s columns: the label at the number of ends that are reached."""
    found = {"role": F.coalesce("role", F.lit("none"))}
    for name, (column, ends, labels, missing) in BUCKETS.items():
        reached = sum(((F.col(column) >= end).cast("int") for end in ends), F.lit(0))
        found[name] = F.when(F.col(column).isNull(), missing).otherwise(F.get(F.array(*map(F.lit, labels)), reached))
    return found


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumns({f"b_{name}": column for name, column in components().items()})
