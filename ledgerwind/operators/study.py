"""Statistics of returns by group: means with naive and cluster-robust errors, contrasts, and purged walk-forward folds."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.functions.stored import stored
from ledgerwind.operators import ranking

LATE, TRAIN_YEARS, LEAST_TRAIN, LEAST_TEST = 2, 2, 100, 20


def lag_bucket(lag: Column) -> Column:
    """0 to 1 day, 2, 3 to 4, 5 and more."""
    return F.when(lag <= 1, 0).when(lag == 2, 1).when(lag <= 4, 2).otherwise(3)


def bucket_of(value: Column, cuts: list[Column]) -> Column:
    """0-based group; values equal to a cut-off go to the upper one."""
    return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def summarize(df: DataFrame, groups: list[str], value: str, cluster: str) -> DataFrame:
    """(groups, n, mean, t, hit, clusters, t_cluster) of non-null values.

    One pass makes a row a group and cluster; the squared cluster sums of deviations from the mean follow from the sums of
    s * s, s * n and n * n.
    """
    v = F.col(value)
    per = df.filter(v.isNotNull()).groupBy(*groups, cluster).agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum((v > 0).cast("double")).alias("hits"))
    out = per.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("hits").alias("hits"), F.count("*").alias("clusters"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean, n, g = F.col("s") / F.col("n"), F.col("n"), F.col("clusters")
    deviation = F.sqrt(F.greatest((F.col("q") - n * mean * mean) / (n - 1), F.lit(0.0)))
    spread = F.greatest(F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"), F.lit(0.0))
    error = F.sqrt(spread * g / (g - 1)) / n
    return out.select(*groups, n.cast("long").alias("n"), mean.alias("mean"), F.when((n > 1) & (deviation > 0), F.try_divide(mean, deviation / F.sqrt(n))).alias("t"), (F.col("hits") / n).alias("hit"), g.alias("clusters"), F.when((g > 1) & (spread > 0), F.try_divide(mean, error)).alias("t_cluster"))


def described(df: DataFrame, groups: list[str], value: str, within: list[str]) -> DataFrame:
    """(groups, n, median, wmean): the interpolated median, and the mean of values cut to the 1st and 99th percentile of `within`."""
    rows = stored(df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*groups, *within]), value), "described")
    bounds = ranking.order_statistics(rows, within, value, ranking.winsor_places())
    middles = ranking.order_statistics(rows, groups, value, {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    cut = F.least(F.greatest(value, "lo"), F.col("hi"))
    means = (rows.join(F.broadcast(bounds), within) if within else rows.crossJoin(F.broadcast(bounds))).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(cut).alias("wmean"))  # without `within`, one row
    return means.join(middles, groups).select(*groups, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "wmean")


def welch(df: DataFrame, groups: list[str], side: Column, value: str) -> DataFrame:
    """(groups, n_a, n_b, diff, t): mean where side is true less mean where it is false, with unequal variances and no clusters."""
    a, b = (F.when(side == flag, F.col(value)) for flag in (True, False))
    out = df.groupBy(*groups).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), (F.avg(a) - F.avg(b)).alias("diff"), (F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)).alias("_v"))
    return out.filter("n_a >= 2 and n_b >= 2").select(*groups, "n_a", "n_b", "diff", F.when(F.col("_v") > 0, F.col("diff") / F.sqrt("_v")).alias("t"))


def cohorts() -> Column:
    """The overlapping cohorts of an event, by role and by cluster size."""
    role, size = F.col("role"), F.col("cluster_count")
    of = {
        "role: CEO or CFO": role.isin("CEO", "CFO"), "role: other officer": role == "officer", "role: director": role == "director", "role: 10% owner": role == "10% owner", "role: none given": role.isNull(),
        "cluster: 1 insider": size <= 1, "cluster: 2 insiders": size == 2, "cluster: 3+ insiders": size >= 3,
    }
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in of.items())))


def selections() -> Column:
    """Buys, sells and sells under a plan, of any and of liquid stocks; plan buys are in none."""
    kind = F.when((F.col("side") == "buy") & ~F.col("is_10b5_1"), "buys").when((F.col("side") == "sell") & ~F.col("is_10b5_1"), "sells").when(F.col("side") == "sell", "plan sells")
    return F.array_compact(F.array(kind, F.when(F.col("liquid"), F.concat(kind, F.lit(", liquid")))))


def periods(spans: dict[str, tuple[int, int]], year: Column) -> Column:
    """The named spans of years that hold a year, and the year itself."""
    return F.array_compact(F.array(*(F.when(year.between(*span), name) for name, span in spans.items()), year.cast("string")))


def verdict(folds: DataFrame) -> DataFrame:
    """(effect, held, years, mean, t): in how many test years an effect had the direction of its training years; t is across years."""
    signed = lambda name: F.when(F.col(f"{name}_is") > 0, F.col(f"{name}_oos")).otherwise(-F.col(f"{name}_oos"))
    known = lambda name: F.col(f"{name}_is").isNotNull() & F.col(f"{name}_oos").isNotNull()
    effects = [F.struct(F.lit(name).alias("effect"), F.when(known(name), signed(name)).alias("v")) for name in ("lag", "drift")]
    effects += [F.struct(F.lit("top less bottom fifth").alias("effect"), F.col("top_minus_bottom").alias("v")), F.struct(F.lit("rank IC").alias("effect"), F.col("ic").alias("v"))]
    rows = folds.select(F.explode(F.array(*effects)).alias("e")).select("e.*").filter("v is not null")
    out = rows.groupBy("effect").agg(F.count_if(F.col("v") > 0).alias("held"), F.count("*").alias("years"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("_s"))
    return out.select("effect", "held", "years", "mean", F.when(F.col("_s") > 0, F.col("mean") / (F.col("_s") / F.sqrt("years"))).alias("t"))


def by_benchmark(returns: DataFrame) -> DataFrame:
    """returns as a row for each benchmark: bench, gross and net in the trade's direction."""
    rows = F.array(*(F.struct(F.lit(name).alias("bench"), F.col(c).alias("gross")) for name, c in (("SPY", "r"), ("sector", "r_sector"), ("IWM", "r_iwm"))))
    return returns.withColumn("_b", F.explode(rows)).select("*", "_b.bench", "_b.gross").withColumn("net", F.col("gross") - F.coalesce("cost", F.lit(0.0))).drop("_b")


def contrast(df: DataFrame, groups: list[str], side: Column, value: str, cluster: str) -> DataFrame:
    """(groups, n_a, n_b, diff, t): mean where side is true less mean where it is false, with cluster-robust error."""
    df = df.filter(F.col(value).isNotNull()).withColumn("_a", side).filter("_a is not null")
    sums = df.groupBy(*groups, cluster).agg(*(f(c).alias(n) for n, f, c in _sided(value)))
    total = sums.groupBy(*groups).agg(*(F.sum(n).alias(f"t_{n}") for n in ("na", "sa", "nb", "sb"))).filter("t_na >= 2 and t_nb >= 2")
    both = sums.join(F.broadcast(total), groups)  # a row a group
    moved = (F.col("sa") - F.col("na") * F.col("t_sa") / F.col("t_na")) / F.col("t_na") - (F.col("sb") - F.col("nb") * F.col("t_sb") / F.col("t_nb")) / F.col("t_nb")
    out = both.groupBy(*groups).agg(F.first("t_na").alias("n_a"), F.first("t_nb").alias("n_b"), F.first(F.col("t_sa") / F.col("t_na") - F.col("t_sb") / F.col("t_nb")).alias("diff"), F.sum(moved * moved).alias("_x"), F.count("*").alias("_g"))
    return out.select(*groups, F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), "diff", F.when((F.col("_g") >= 2) & (F.col("_x") > 0), F.try_divide(F.col("diff"), F.sqrt(F.col("_x") * F.col("_g") / (F.col("_g") - 1)))).alias("t"))


def _sided(value: str) -> list:
    a, v = F.col("_a"), F.col(value)
    return [("na", F.sum, a.cast("double")), ("sa", F.sum, F.when(a, v).otherwise(0.0)), ("nb", F.sum, (~a).cast("double")), ("sb", F.sum, F.when(~a, v).otherwise(0.0))]


def with_drift_quintile(returns: DataFrame, groups: list[str]) -> DataFrame:
    """returns with `quintile` (0 to 4) of drift_pct, by cut-offs of all rows of a group that have a drift; null without."""
    cuts = ranking.order_statistics(returns.select(*groups, "drift_pct"), groups, "drift_pct", ranking.quantile_places(5))
    joined = returns.join(F.broadcast(cuts), groups, "left")  # a row a group, so returns stay where they are
    return joined.withColumn("quintile", F.when(F.col("drift_pct").isNotNull(), bucket_of(F.col("drift_pct"), [F.col(f"cut{k}") for k in range(1, 5)]))).drop(*(f"cut{k}" for k in range(1, 5)))


def first_of_day(returns: DataFrame) -> DataFrame:
    """One event a ticker, side and entry day: the first in the order of events."""
    first = returns.groupBy("ticker", "side", "entry", "h").agg(F.min(F.struct("filing_date", "filer_id")).alias("k"))
    return returns.join(first.select("ticker", "side", "entry", "h", "k.filing_date", "k.filer_id"), ["ticker", "side", "entry", "h", "filing_date", "filer_id"], "left_semi")


def _trained(cells: list, bounds: dict[str, float], cuts: dict[str, float], edges: tuple[list[float], list[float]]) -> dict:
    """A test year's training means from the cells (lag bucket, stretches of drift and return) of its training rows."""
    of_drift, of_return = edges
    ends = [bisect_left(of_drift, cuts[f"cut{k}"]) for k in range(1, 5)]
    under, over = bisect_left(of_return, bounds["lo"]), bisect_left(of_return, bounds["hi"])
    lag: dict[int, list[float]] = {}
    drift: dict[int, list[float]] = {}
    for r in cells:
        s = r["n"] * bounds["lo"] if r["r_at"] <= under else r["n"] * bounds["hi"] if r["r_at"] > over else r["s"]
        for table, key in ((lag, r["lag_b"]), (drift, sum(r["d_at"] > e for e in ends))):
            n, total = table.get(key, (0, 0.0))
            table[key] = [n + r["n"], total + s]

    def mean(table: dict[int, list[float]], keys) -> float | None:
        own = [table[k] for k in keys if k in table]
        return sum(s for _, s in own) / sum(n for n, _ in own) if own else None

    less = lambda a, b: a - b if a is not None and b is not None else None
    return {
        "overall": mean(lag, range(4)), "lag_means": [mean(lag, [k]) for k in range(4)], "drift_means": [mean(drift, [k]) for k in range(5)],
        "lag_is": less(mean(lag, (2, 3)), mean(lag, (0, 1))), "drift_is": less(mean(drift, [4]), mean(drift, [0])),
    }


def walk_forward(returns: DataFrame) -> DataFrame:
    """A row a test year: sizes, contrasts in and out of sample, rank correlation and top less bottom fifth.

    Rows of one horizon. Training rows left before the test year began, so the years' training rows are nested: cut-offs and
    winsor bounds of all years come from one sort each, and all training means from one sum over rows by lag bucket and the
    stretches between those values. No row is copied into another year, and the number of jobs doesn't grow with years.
    """
    spark = returns.sparkSession
    rows = returns.filter("r is not null and drift_pct is not null").select("filer_id", "ticker", "side", "filing_date", "entry", "exit", "lag_days", "drift_pct", "r", F.year("entry").alias("year"), lag_bucket(F.col("lag_days")).alias("lag_b"))
    sizes = {r["year"]: r["count"] for r in rows.groupBy("year").count().collect()}  # a row a year
    years = sorted(sizes)[TRAIN_YEARS:]
    since = sum(((F.col("exit") >= F.make_date(F.lit(y), F.lit(1), F.lit(1))).cast("int") for y in years), F.lit(0))
    rows = stored(rows.withColumn("since", since), "walk-rows")
    places = {f"cut{k}": (lambda n, k=k: min(n - 1, n * k // 5)) for k in range(1, 5)}
    cuts = ranking.nested_order_statistics(rows, "drift_pct", "since", len(years), places)
    bounds = ranking.nested_order_statistics(rows, "r", "since", len(years), {"lo": lambda n: int(0.01 * (n - 1)), "hi": lambda n: int(0.99 * (n - 1))})
    steps = [i for i, y in enumerate(years) if i in cuts and cuts[i]["n"] >= LEAST_TRAIN and sizes[y] >= LEAST_TEST]
    edges = sorted({cuts[i][c] for i in steps for c in places}), sorted({bounds[i][c] for i in steps for c in ("lo", "hi")})
    at = [sum(((F.col(c) >= e).cast("int") for e in own), F.lit(0)) for c, own in zip(("drift_pct", "r"), edges, strict=True)]
    cells = rows.filter(F.col("since") < len(years)).groupBy("since", "lag_b", at[0].alias("d_at"), at[1].alias("r_at")).agg(F.count("*").alias("n"), F.sum("r").alias("s")).collect() if steps else []  # by years, not rows
    cells.sort(key=lambda r: tuple(r)[:4])
    names = {"cut1": "double", "cut2": "double", "cut3": "double", "cut4": "double", "lo": "double", "hi": "double", "overall": "double", "lag_means": "array<double>", "drift_means": "array<double>", "lag_is": "double", "drift_is": "double"}
    fitted = []
    for i in steps:
        found = cuts[i] | bounds[i] | _trained([r for r in cells if r["since"] <= i], bounds[i], cuts[i], edges)
        fitted.append((years[i], cuts[i]["n"], sizes[years[i]], *(found[c] for c in names)))
    fits = F.broadcast(spark.createDataFrame(fitted, "year int, n_train long, n_test long, " + ", ".join(f"{c} {kind}" for c, kind in names.items())))  # a row a year
    test = rows.join(fits, "year").withColumn("v", F.least(F.greatest("r", "lo"), "hi")).withColumn("late", F.col("lag_days") > LATE)
    test = test.withColumn("drift_b", bucket_of(F.col("drift_pct"), [F.col(f"cut{k}") for k in range(1, 5)]))
    known = lambda table, key: F.coalesce(F.get(table, F.col(key)), F.col("overall"))
    # rounded so that the same mean added up in another order is still a tie
    scored = stored(test.withColumn("pred", F.round(known("lag_means", "lag_b") + known("drift_means", "drift_b") - F.col("overall"), 9)), "walk-test")
    mean = lambda cond: F.avg(F.when(cond, F.col("v")))
    apart = scored.groupBy("year").agg((mean(F.col("late")) - mean(~F.col("late"))).alias("lag_oos"), (mean(F.col("drift_b") == 4) - mean(F.col("drift_b") == 0)).alias("drift_oos"))
    order = ranking.numbered(scored, ["year"], [F.col(c) for c in ("pred", "entry", "filing_date", "ticker", "side", "filer_id")])
    fifth = F.floor(F.col("n_test") / 5)
    ends = order.groupBy("year").agg((mean(F.col("rank") > F.col("n_test") - fifth) - mean(F.col("rank") <= fifth)).alias("top_minus_bottom"))
    parts = [apart, ranking.rank_correlation(scored, ["year"], "pred", "v", "ic"), ends]
    return reduce(lambda a, b: a.join(b, "year", "left"), parts, fits.select("year", "n_train", "n_test", "lag_is", "drift_is"))
