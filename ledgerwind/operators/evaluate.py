"""What became of each event: entry, checks, costs and legs of several horizons against benchmarks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions.calendars import add_business_days, with_ordinal
from ledgerwind.functions.stored import small, stored
from ledgerwind.operators.events import KEYS, entry_dates
from ledgerwind.operators.temporal import asof, asof_all

HORIZONS = (5, 20, 60)
COMMISSION_BPS, ENTRY_SESSIONS, EXIT_DAYS, CLOSE_DAYS, LIQUIDITY = 10.0, 5, 10, 5, 20
# Daily dollar volume from which a half-spread in basis points holds, and that below all of them.
SPREADS, WIDEST = ((50e6, 2.0), (5e6, 10.0), (5e5, 30.0), (5e4, 75.0)), 150.0
TICKER_CHECK = (0.5, 2.0)
LEAST_PRICE, LEAST_VOLUME = 2.0, 100_000.0


def half_spread_bps(volume: Column) -> Column:
    out = F.lit(WIDEST)
    for floor, bps in reversed(SPREADS):
        out = F.when(volume >= floor, F.lit(bps)).otherwise(out)
    return out


def round_trip_cost(volume: Column) -> Column:
    """As a fraction: both sides' commission and half-spread."""
    return 2 * (COMMISSION_BPS + half_spread_bps(volume)) / 10_000


def liquid() -> Column:
    """Whether an event's stock is dear and traded enough at its entry."""
    return F.coalesce((F.col("entry_open") >= LEAST_PRICE) & (F.col("dollar_volume") >= LEAST_VOLUME), F.lit(False))


def numbered(bars: DataFrame) -> DataFrame:
    """Usable bars with bar_no and last_date per ticker, and dollar volumes and drawdowns of windows of bars.

    A ticker has at most one bar a session, so its window is bounded by the calendar.
    """
    at = Window.partitionBy("ticker").orderBy("date")
    usable = bars.filter("adj_close > 0")
    dollars = F.when(F.col("close") != 0, F.col("close") * F.col("volume"))
    peak = F.max("adj_close").over(at.rowsBetween(-249, 0))
    df = usable.withColumn("bar_no", F.row_number().over(at)).withColumn("last_date", F.max("date").over(Window.partitionBy("ticker"))).withColumn("dollars", dollars)
    df = df.withColumn("volume_before", F.expr(f"percentile(dollars, 0.5) over (partition by ticker order by date rows between {LIQUIDITY} preceding and 1 preceding)"))
    df = df.withColumn("volume_upto", F.expr(f"percentile(dollars, 0.5) over (partition by ticker order by date rows between {LIQUIDITY - 1} preceding and current row)"))
    return df.withColumn("drawdown", F.when(F.col("bar_no") >= 60, F.col("adj_close") / peak - 1)).withColumn("previous_close", F.lag("adj_close").over(at)).withColumn("previous_date", F.lag("date").over(at)).withColumn("drawdown_before", F.lag("drawdown").over(at)).drop("dollars")


def with_exits(numbered: DataFrame, days: DataFrame) -> DataFrame:
    """numbered bars with exit<h>_date and exit<h>_close of each horizon: what a position that is entered at a bar exits at.

    That is the ticker's last bar up to the session h - 1 after the entry's, at most EXIT_DAYS old. In numbers of sessions,
    doubled so that a bar of another day stands between two, it is a fixed way ahead: a window of the ticker's own bars.
    """
    df = with_ordinal(numbered, days, "date", "nyse", "_day_number").join(F.broadcast(days.select(F.col("d").alias("_d"), "is_nyse")), F.col("date") == F.col("_d"), "left").drop("_d")
    df = df.withColumn("_place", 2 * F.col("_day_number") + F.when(F.col("is_nyse"), 0).otherwise(1))
    by, bar = Window.partitionBy("ticker").orderBy("_place"), F.struct("date", "adj_close")
    for h in HORIZONS:
        ahead = [F.last(bar).over(by.rangeBetween(0, 2 * (h - 1) - more)) for more in (0, 1)]
        df = add_business_days(df, days, "date", h - 1, "nyse", "_target").withColumn("_x", F.when(F.col("is_nyse"), ahead[0]).otherwise(ahead[1]))
        held = F.datediff("_target", "_x.date").between(0, EXIT_DAYS)
        df = df.withColumns({f"exit{h}_date": F.when(held, F.col("_x.date")), f"exit{h}_close": F.when(held, F.col("_x.adj_close"))}).drop("_target", "_x")
    return df.drop("_day_number", "is_nyse", "_place")


@dataclass
class Study:
    """Events and bars, and the tables that follow from them, each made once."""

    events: DataFrame
    bars: DataFrame
    sectors: DataFrame
    days: DataFrame
    market: str = "SPY"
    small: str = "IWM"

    @cached_property
    def numbered(self) -> DataFrame:
        return stored(with_exits(numbered(self.bars), self.days), "numbered-bars")

    @cached_property
    def last_market_day(self):
        return self.bars.filter((F.col("ticker") == self.market) & (F.col("adj_close") > 0)).agg(F.max("date")).first()[0]

    @cached_property
    def last_bars(self) -> DataFrame:
        """(_t, last_date, _last_close): each ticker's last usable bar."""
        last = self.bars.filter("adj_close > 0").groupBy(F.col("ticker").alias("_t")).agg(F.max(F.struct("date", "adj_close")).alias("_x"))
        return stored(last.select("_t", F.col("_x.date").alias("last_date"), F.col("_x.adj_close").alias("_last_close")), "last-bars")

    @cached_property
    def benchmarks(self) -> DataFrame:
        """(bench, d, adj_open, adj_close, as_of_close): the benchmarks' own bars and last closes, at most 10 days old.

        A row a benchmark and calendar day: bounded, so it is broadcast.
        """
        names = self.sectors.select("sector").distinct().unionByName(self.events.sparkSession.createDataFrame([(self.market,), (self.small,)], "sector string")).distinct().select(F.col("sector").alias("ticker"))
        usable = self.bars.filter("adj_close > 0")
        own = usable.join(F.broadcast(names), "ticker", "left_semi").select("ticker", "date", "adj_open", "adj_close")
        span = usable.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
        dates = self.days.filter(F.col("d").between(span["lo"], span["hi"])) if span["lo"] else self.days.limit(0)
        grid = own.select("ticker").distinct().join(dates.select("d").withColumn("_", F.lit(1)), F.col("_") == 1)
        df = asof(grid, own, "ticker", "d", ["adj_close"], "x", EXIT_DAYS)
        at = own.select(F.col("ticker").alias("t"), "date", "adj_open", "adj_close")
        df = df.join(at, (F.col("ticker") == F.col("t")) & (F.col("d") == F.col("date")), "left")
        return stored(df.select(F.col("ticker").alias("bench"), "d", "adj_open", "adj_close", F.col("x_adj_close").alias("as_of_close")), "benchmarks")

    @property
    def outcomes(self) -> DataFrame:
        """One row an event: status, entry, drift, price check, volume, cost and the benchmark in use."""
        return self._outcomes(self.events)

    def _outcomes(self, events: DataFrame) -> DataFrame:
        """outcomes of some events.

        Unless numbered bars are stored already, bars move to their ticker as they are and are numbered there, and events move
        there beside them: no bar moves with what is found at it.
        """
        placed = "numbered" not in vars(self)
        stock = with_exits(numbered(self.bars), self.days) if placed else self.numbered
        first = small(self.last_bars.select("_t", "last_date"))
        df = entry_dates(events, self.days, "filing_date", None, "planned")
        values = ["bar_no", "open", "adj_open", "volume_before", "previous_close", "previous_date", "drawdown_before", *(f"exit{h}_{c}" for h in HORIZONS for c in ("date", "close"))]
        lookups = [("planned", values, "entry", 21, True), ("first_trade_date", ["adj_close"], "t0", CLOSE_DAYS, False), ("last_trade_date", ["close"], "t1", CLOSE_DAYS, False)]
        df = asof_all(df, stock, "ticker", lookups, placed)
        df = add_business_days(df, self.days, "planned", ENTRY_SESSIONS, "nyse", "latest")
        df = df.join(first, df["ticker"] == first["_t"], "left").drop("_t")
        df = df.join(small(self.sectors), "issuer", "left")
        at = F.broadcast(self.benchmarks.filter("adj_close is not null").select(F.col("bench").alias("_b"), F.col("d").alias("_d")))
        df = df.join(at, (F.col("sector") == F.col("_b")) & (F.col("entry_date") == F.col("_d")), "left")
        last = F.lit(self.last_market_day)
        usable = (F.col("entry_date") <= F.col("latest")) & (F.coalesce(F.col("entry_open"), F.lit(0.0)) != 0) & (F.coalesce(F.col("entry_adj_open"), F.lit(0.0)) != 0)
        early = F.when(F.col("last_date").isNull(), "no_prices").when(F.col("planned") > last, "not_matured").when(F.col("last_date") < F.col("planned"), "ended_before_entry").when(~F.coalesce(usable, F.lit(False)), "no_entry_bar")
        drifted = F.col("t0_date").isNotNull() & (F.col("entry_previous_date") >= F.col("t0_date"))
        move = F.col("entry_previous_close") / F.col("t0_adj_close") - 1
        ratio = F.when((F.col("avg_price") > 0) & (F.coalesce(F.col("t1_close"), F.lit(0.0)) != 0), F.col("avg_price") / F.col("t1_close"))
        df = df.withColumn("early", early).withColumn("price_ratio", F.when(F.col("early").isNull(), ratio))
        df = df.withColumn("mismatch", F.col("early").isNull() & F.coalesce(~F.col("price_ratio").between(*TICKER_CHECK), F.lit(False)))
        entered, priced = F.col("early").isNull(), F.col("early").isNull() & ~F.col("mismatch")
        flags = F.array_compact(F.array(F.when(entered & (F.col("entry_date") != F.col("planned")), "late_entry"), F.when(entered & ~F.coalesce(drifted, F.lit(False)), "no_drift"), F.when(priced & F.col("price_ratio").isNull(), "no_price_check")))
        return (
            df.withColumn("entry", F.when(entered, F.col("entry_date")))
            .withColumn("entry_open", F.when(entered, F.col("entry_open")))
            .withColumn("drift_pct", F.when(entered & drifted, 100 * F.when(F.col("side") == "sell", 0 - move).otherwise(move)))
            .withColumn("dollar_volume", F.when(priced, F.col("entry_volume_before")))
            .withColumn("cost", F.when(priced, round_trip_cost(F.col("entry_volume_before"))))
            .withColumn("benchmark", F.when(priced, F.when(F.col("_b").isNotNull(), F.col("sector")).otherwise(self.market)))
            .withColumn("drawdown", F.when(entered, F.col("entry_drawdown_before")))
            .withColumn("flags", flags)
            .drop("_b", "_d", "entry_date", "t0_date", "t0_adj_close", "t1_date", "t1_close")
        )

    @cached_property
    def ended(self) -> DataFrame:
        """outcomes with _legs, an array of (h, exit, exit_close, ended_early) of the horizons that have matured."""
        return stored(self._ended(self.events), "ended")

    def _ended(self, events: DataFrame) -> DataFrame:
        rows, priced = self._outcomes(events), F.col("early").isNull() & ~F.col("mismatch")
        rows = rows.withColumn("_entered", F.when(priced, F.col("entry")))
        for h in HORIZONS:
            rows = add_business_days(rows, self.days, "_entered", h - 1, "nyse", f"_target{h}").withColumn(f"_target{h}", F.when(F.col(f"_target{h}") <= F.lit(self.last_market_day), F.col(f"_target{h}")))
        ends = small(self.last_bars.select("_t", "_last_close"))
        rows = rows.join(ends, rows["ticker"] == ends["_t"], "left").drop("_t")
        legs = []
        for h in HORIZONS:
            found = F.col(f"entry_exit{h}_date").isNotNull()
            early = ~found & (F.col("last_date") < F.col(f"_target{h}"))
            leg = F.struct(F.lit(h).alias("h"), F.coalesce(f"entry_exit{h}_date", "last_date").alias("exit"), F.coalesce(f"entry_exit{h}_close", "_last_close").alias("exit_close"), early.alias("ended_early"))
            legs.append(F.when(F.col(f"_target{h}").isNotNull() & (found | early), leg))
        rows = rows.withColumn("_legs", F.array_compact(F.array(*legs)))
        return rows.drop("_entered", "_last_close", *(c for h in HORIZONS for c in (f"_target{h}", f"entry_exit{h}_date", f"entry_exit{h}_close")))

    @cached_property
    def legs(self) -> DataFrame:
        """(keys, h, exit, ended_early, stock, spy, sector_leg, iwm) of each horizon that has matured."""
        return self._legs("entry").select(*KEYS, "h", "exit", "ended_early", "stock", "spy", "sector_leg", "iwm")

    def _legs(self, *kept: str) -> DataFrame:
        rows = self.ended.select(*dict.fromkeys([*KEYS, "entry", "entry_adj_open", "benchmark", *kept]), F.explode("_legs").alias("_leg")).select("*", "_leg.*").drop("_leg")
        rows = rows.withColumn("stock", F.col("exit_close") / F.col("entry_adj_open") - 1)
        for name, bench in (("spy", F.lit(self.market)), ("sector_leg", F.col("benchmark")), ("iwm", F.lit(self.small))):
            rows = self._against(rows, name, bench)
        return rows

    def _against(self, rows: DataFrame, name: str, bench: Column) -> DataFrame:
        """rows (entry, exit) with what a benchmark returned from one to the other."""
        start = F.broadcast(self.benchmarks.filter("adj_open <> 0").select(F.col("bench").alias("_b1"), F.col("d").alias("_d1"), F.col("adj_open").alias("_o")))
        end = F.broadcast(self.benchmarks.select(F.col("bench").alias("_b2"), F.col("d").alias("_d2"), F.col("as_of_close").alias("_c")))
        rows = rows.withColumn("_bench", bench).join(start, (F.col("_bench") == F.col("_b1")) & (F.col("entry") == F.col("_d1")), "left").join(end, (F.col("_bench") == F.col("_b2")) & (F.col("exit") == F.col("_d2")), "left")
        return rows.withColumn(name, F.col("_c") / F.col("_o") - 1).drop("_bench", "_b1", "_d1", "_o", "_b2", "_d2", "_c")

    def _settled(self, ended: DataFrame) -> DataFrame:
        status = F.coalesce(F.col("early"), F.when(F.col("mismatch"), "ticker_mismatch"), F.when(F.size("_legs") > 0, "ok"), F.lit("not_matured"))
        return ended.withColumn("status", status).withColumn("liquid", liquid())

    @cached_property
    def results(self) -> DataFrame:
        """outcomes with their final status: events without any matured leg have not matured."""
        return self._settled(self.ended).drop("early", "mismatch", "_legs")

    def at(self, h: int) -> DataFrame:
        """results with exit, r and net of one horizon, as returns has them (null if it has not matured): an event's leg stands in its own row, so none moves."""
        return self._at(self.ended, h)

    @cached_property
    def bought(self) -> DataFrame:
        """at(20) of buys alone, of which no figure follows from sales; where ended is not stored, they move without what at() does not need."""
        if "ended" in vars(self):
            return self._at(self.ended.filter("side = 'buy'"), 20)
        asked = ["issuer", "first_trade_date", "last_trade_date", "avg_price"]
        told = ["value", "shares", "held_before", "role", "is_10b5_1", "cluster_count"]
        rows = self._at(self._ended(self.events.filter("side = 'buy'").select(*KEYS, *asked, *told)), 20)
        return stored(rows.select(*KEYS, *told, "planned", "entry", "entry_bar_no", "drift_pct", "drawdown", "dollar_volume", "cost", "status", "liquid", "exit", "r", "net"), "bought")

    def _at(self, ended: DataFrame, h: int) -> DataFrame:
        leg = F.get(F.filter("_legs", lambda x: x["h"] == h), F.lit(0))
        rows = self._settled(ended).withColumns({"exit": leg["exit"], "_close": leg["exit_close"]})
        rows = self._against(rows, "_spy", F.lit(self.market))
        r = F.when(F.col("side") == "sell", -1.0).otherwise(1.0) * (F.col("_close") / F.col("entry_adj_open") - 1 - F.col("_spy"))
        return rows.withColumn("r", r).withColumn("net", F.col("r") - F.coalesce("cost", F.lit(0.0))).drop("early", "mismatch", "_legs", "_close", "_spy")

    @cached_property
    def returns(self) -> DataFrame:
        """legs of ok events with r (gross excess over the market in the trade's direction), net, r_sector and r_iwm.

        Only ok events have legs, so an event's own row has all that its legs need.
        """
        rows = self._legs("entry_open", "dollar_volume", "lag_days", "role", "cluster_count", "is_10b5_1", "drift_pct", "cost", "value")
        df = rows.withColumn("liquid", liquid()).select(*KEYS, "h", "exit", "ended_early", "stock", "spy", "sector_leg", "iwm", "entry", "lag_days", "role", "cluster_count", "is_10b5_1", "liquid", "drift_pct", "cost", "benchmark", "value")
        sign = F.when(F.col("side") == "sell", -1.0).otherwise(1.0)
        df = df.withColumn("r", sign * (F.col("stock") - F.col("spy"))).withColumn("r_sector", sign * (F.col("stock") - F.col("sector_leg"))).withColumn("r_iwm", sign * (F.col("stock") - F.col("iwm")))
        cluster = F.when(F.col("h") <= 20, F.year("entry") * 100 + F.month("entry")).otherwise(F.year("entry") * 100 + F.quarter("entry"))
        return stored(df.withColumn("net", F.col("r") - F.coalesce("cost", F.lit(0.0))).withColumn("cluster", cluster), "returns")
