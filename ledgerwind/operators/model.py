"""The score: shrunk bucket tables, bounded least-squares weights, a drift penalty and decay.

Every fit is made of sums that add up over rows: counts and cut returns by component and bucket, and counts by pairs of
buckets. A walk-forward groups them by the first test year whose training rows a row is among; sums up to a year are that
year's fit, so all years, and all subsets of components, come from one pass and a few thousand sums on the driver.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import asdict, dataclass, field
from itertools import chain, combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwind.functions.stored import stored
from ledgerwind.operators import ranking
from ledgerwind.operators.signals import bucketed, components

VERSION, SHRINK, FLOOR, HALF_LIFE, TOP = 1, 500, -0.20, 10.0, 0.10
BETAS = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0)
NAMES = ("role", "value", "stake", "cluster", "repeat", "drawdown", "track", "liquidity")
LEAST_TRAIN = 500
#: Equal scores are ordered as events are.
SEQUENCE = ["filing_date", "ticker", "side", "filer_id"]


@dataclass
class Model:
    """Bucket values by component, weights, and what the score needs besides."""

    tables: dict[str, dict[str, float]]
    weights: dict[str, float]
    beta: float = 0.0
    half_life: float = HALF_LIFE
    overall: float = 0.0
    threshold: float | None = None
    n_train: int = 0
    trained_on: str = ""
    version: int = VERSION
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Model:
        values = json.loads(text)
        if values.get("version") != VERSION:
            raise ValueError(f"model version {values.get('version')}, not {VERSION}")
        return cls(**values)

    def value(self, name: str) -> Column:
        """The component's bucket value; 0 for a bucket not seen in training."""
        table = self.tables[name]
        if not table:
            return F.lit(0.0)
        return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col(f"b_{name}")], F.lit(0.0))

    def quality(self) -> Column:
        """Between 0 for the worst buckets and 1 for the best."""
        low, high = (sum(self.weights[c] * f(self.tables[c].values(), default=0.0) for c in sorted(self.weights)) for f in (min, max))
        raw = sum((self.weights[c] * self.value(c) for c in sorted(self.weights)), F.lit(0.0))
        return (raw - low) / (high - low) if high > low else F.lit(0.5)

    def contributions(self) -> dict[str, Column]:
        """Each component's weighted bucket value, on the scale of the raw score."""
        return {c: self.weights[c] * self.value(c) for c in sorted(self.weights)}

    def score(self, days_since_filing: Column | None = None, beta: Column | None = None) -> Column:
        beta = F.lit(self.beta) if beta is None else beta
        out = self.quality() * penalty(beta)
        return out if days_since_filing is None else out * F.exp(-F.log(F.lit(2.0)) / self.half_life * days_since_filing)


def bounded_least_squares(gram: list[list[float]], right: list[float], upper: float) -> list[float]:
    """Weights in [0, upper] that minimise the squares, exactly: each weight is at a bound or free.

    For each set of free weights the stationary points of all ways to put the others at a bound are solved together; the
    best one within the bounds is the minimum. A free set whose equations are singular needs no look, as a smaller one
    then holds a minimum too. There are 3^n cases, so n is the number of components, not of rows.
    """
    g, target = np.array(gram, float), np.array(right, float)
    axes = np.flatnonzero(g.diagonal() > 0)
    best, least = np.zeros(len(target)), 0.0
    for free in chain.from_iterable(combinations(axes.tolist(), k) for k in range(len(axes) + 1)):
        held = [a for a in axes.tolist() if a not in free]
        w = np.zeros((2 ** len(held), len(target)))
        w[:, held] = upper * np.array(list(product((0, 1), repeat=len(held))), float).reshape(len(w), len(held))
        if free:
            own = np.ix_(free, free)
            if np.linalg.cond(g[own]) > 1e13:
                continue
            w[:, free] = np.linalg.solve(g[own], (target[list(free), None] - g[np.ix_(free, held)] @ w[:, held].T)).T
            w = w[((w[:, free] >= 0) & (w[:, free] <= upper)).all(axis=1)]
        loss = ((w @ g) * w).sum(axis=1) - 2 * w @ target
        if len(w) and loss.min() < least:
            best, least = w[loss.argmin()], loss.min()
    return best.tolist()


def winsorized(pool: DataFrame, y: str = "y") -> DataFrame:
    """pool with y cut to its own 1st and 99th percentiles."""
    bounds = ranking.order_statistics(pool.select(y), [], y, ranking.winsor_places())
    return pool.join(F.broadcast(bounds.withColumn("_", F.lit(1))), F.col("_") == 1).withColumn(y, F.least(F.greatest(y, "lo"), "hi")).drop("lo", "hi", "_")


def bucket_tables(pool: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(component, bucket, n, value) from rows with y and buckets: the bucket's mean over the overall mean, shrunk."""
    long = pool.select("y", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"b_{c}").alias("bucket")) for c in names))).alias("b"))
    per = long.groupBy("b.component", "b.bucket").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    overall = F.sum(F.when(F.col("component") == names[0], F.col("s"))), F.sum(F.when(F.col("component") == names[0], F.col("n")))
    mean = per.agg((overall[0] / overall[1]).alias("overall")).withColumn("_", F.lit(1))
    n = F.col("n")
    return per.join(F.broadcast(mean), F.col("_") == 1).select("component", "bucket", "n", (n / (n + SHRINK) * (F.col("s") / n - F.col("overall"))).alias("value"), "overall")


@dataclass(frozen=True)
class Variant:
    """Which components a model may use, and which drift penalties it chooses from."""

    label: str
    names: tuple[str, ...] = NAMES
    betas: tuple[float, ...] = BETAS


@dataclass
class Sums:
    """What all fits to one set of rows follow from."""

    n: int
    low: float
    high: float
    counts: dict[str, dict[str, int]]
    totals: dict[str, dict[str, float]]
    pairs: dict[tuple[str, str], dict[tuple[str, str], int]]

    @property
    def overall(self) -> float:
        return sum(self.totals[NAMES[0]].values()) / self.n

    def tables(self) -> dict[str, dict[str, float]]:
        """By component and bucket: the bucket's mean over the overall mean, shrunk."""
        return {c: {b: n / (n + SHRINK) * (self.totals[c][b] / n - self.overall) for b, n in sorted(own.items())} for c, own in self.counts.items()}

    def normal_equations(self) -> tuple[list[list[float]], list[float]]:
        """Gram matrix of the rows' bucket values, and their products with returns over the mean, for all of NAMES."""
        values, overall = self.tables(), self.overall
        gram = [[0.0] * len(NAMES) for _ in NAMES]
        for i, a in enumerate(NAMES):
            gram[i][i] = sum(n * values[a][b] ** 2 for b, n in sorted(self.counts[a].items()))
            for j, c in enumerate(NAMES[:i]):
                gram[i][j] = gram[j][i] = sum(n * values[c][x] * values[a][y] for (x, y), n in sorted(self.pairs[c, a].items()))
        return gram, [sum(values[c][b] * (self.totals[c][b] - overall * n) for b, n in sorted(self.counts[c].items())) for c in NAMES]

    def model(self, names: tuple[str, ...], label: str) -> Model:
        """Tables and weights of some components; the drift penalty and the threshold are chosen later."""
        gram, right = self.normal_equations()
        some = [NAMES.index(c) for c in names]
        weights = bounded_least_squares([[gram[i][j] for j in some] for i in some], [right[i] for i in some], 1.0)
        values = self.tables()
        return Model({c: values[c] for c in names}, dict(zip(names, weights, strict=True)), overall=self.overall, n_train=self.n, trained_on=label, counts={c: self.counts[c] for c in names})


def sums(rows: DataFrame, steps: int, least: int = 1) -> dict[int, Sums]:
    """By step, of the rows (y, since, buckets) that belong to it; steps with fewer than `least` rows are left out.

    y is cut to the step's own 1st and 99th percentile. Rows are summed by the stretch between all steps' percentiles that
    y falls in, which tells for every step whether it is cut.
    """
    bounds = ranking.nested_order_statistics(rows, "y", "since", steps, {"lo": lambda n: int(0.01 * (n - 1)), "hi": lambda n: int(0.99 * (n - 1))})
    bounds = {i: b for i, b in bounds.items() if b["n"] >= least}
    if not bounds:
        return {}
    edges = sorted({b[name] for b in bounds.values() for name in ("lo", "hi")})
    stretch = sum(((F.col("y") >= e).cast("int") for e in edges), F.lit(0))
    bucket = {c: F.col(f"b_{c}") for c in NAMES}
    none = F.lit(None).cast("string")
    kinds = [F.struct(F.lit(c).alias("a"), bucket[c].alias("x"), none.alias("c"), none.alias("z"), stretch.alias("at")) for c in NAMES]
    kinds += [F.struct(F.lit(a).alias("a"), bucket[a].alias("x"), F.lit(c).alias("c"), bucket[c].alias("z"), F.lit(0).alias("at")) for a, c in combinations(NAMES, 2)]
    per = rows.filter(F.col("y").isNotNull() & (F.col("since") < steps)).select("y", "since", F.explode(F.array(*kinds)).alias("k"))
    found = per.groupBy("since", "k").agg(F.count("*").alias("n"), F.sum("y").alias("s")).select("since", "k.*", "n", "s").collect()  # by buckets, not rows
    out = {}
    for i, b in bounds.items():
        made = Sums(b["n"], b["lo"], b["hi"], {c: {} for c in NAMES}, {c: {} for c in NAMES}, {k: {} for k in combinations(NAMES, 2)})
        under, over = bisect_left(edges, b["lo"]), bisect_left(edges, b["hi"])
        for r in sorted(found, key=lambda r: (r["since"], r["at"])):
            if r["since"] > i:
                continue
            if r["c"] is not None:
                own = made.pairs[r["a"], r["c"]]
                own[r["x"], r["z"]] = own.get((r["x"], r["z"]), 0) + r["n"]
            else:
                s = r["n"] * b["lo"] if r["at"] <= under else r["n"] * b["hi"] if r["at"] > over else r["s"]
                made.counts[r["a"]][r["x"]] = made.counts[r["a"]].get(r["x"], 0) + r["n"]
                made.totals[r["a"]][r["x"]] = made.totals[r["a"]].get(r["x"], 0.0) + s
        out[i] = made
    return out


#: Scores are between 0 and 2.6; a bin's share of them is small next to a tenth of the rows.
BINS = 2048
_FITTED = "step int, variant string, low double, high double, lo double, hi double, k long, betas array<double>, beta double, threshold double, n_train long, " + ", ".join(f"w_{c} map<string,double>" for c in NAMES)


def _fitted(spark: SparkSession, fits: dict[tuple[int, str], Model], variants: dict[str, Variant], found: dict[int, Sums]) -> DataFrame:
    """The models as rows, a few a year; buckets come with their weighted values."""
    rows = []
    for (i, label), m in sorted(fits.items()):
        low, high = (sum((m.weights[c] * f(m.tables[c].values(), default=0.0) for c in sorted(m.weights)), 0.0) for f in (min, max))
        maps = [{b: m.weights[c] * v for b, v in m.tables[c].items()} if c in m.tables else None for c in NAMES]
        rows.append((i, label, low, high, found[i].low, found[i].high, max(1, int(m.n_train * TOP)), list(variants[label].betas), m.beta, m.threshold, m.n_train, *maps))
    return F.broadcast(spark.createDataFrame(rows, _FITTED))


def _quality() -> Column:
    raw = sum((F.coalesce(F.try_element_at(f"w_{c}", F.col(f"b_{c}")), F.lit(0.0)) for c in sorted(NAMES)), F.lit(0.0))
    return F.when(F.col("high") > F.col("low"), (raw - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)


def penalty(beta: Column) -> Column:
    return F.when(F.col("drift").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - beta * F.greatest(F.col("drift"), F.lit(FLOOR))))


def _choose(rows: DataFrame, fits: dict[tuple[int, str], Model], variants: dict[str, Variant], found: dict[int, Sums]) -> None:
    """Gives each model the first penalty whose best tenth of the training rows has the highest mean, and that tenth's last score.

    Scores are counted in bins; only rows of the bin in which a tenth ends are put in order.
    """
    steps = max(found) + 1
    own = rows.filter(F.col("y").isNotNull() & (F.col("since") < steps)).withColumn("step", F.explode(F.sequence("since", F.lit(steps - 1))))
    own = own.join(_fitted(rows.sparkSession, fits, variants, found), "step").withColumn("quality", _quality()).withColumn("beta", F.explode("betas"))
    own = own.select(*SEQUENCE, "step", "variant", "beta", "k", F.least(F.greatest("y", "lo"), "hi").alias("y"), (F.col("quality") * penalty(F.col("beta"))).alias("score")).withColumn("bin", F.floor(F.col("score") * BINS))
    key = ["step", "variant", "beta"]
    bins = own.groupBy(*key, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.first("k").alias("k"))
    above = Window.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # some 5,000 bins at most
    ends = bins.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("sum", F.coalesce(F.sum("s").over(above), F.lit(0.0)))
    ends = stored(ends.filter((F.col("before") < F.col("k")) & (F.col("before") + F.col("n") >= F.col("k"))).select(*key, "bin", "before", "sum"), "tenths")
    ending = stored(own.join(F.broadcast(ends), [*key, "bin"]).select(*SEQUENCE, *key, "k", "y", "score", "before", "sum"), "ending")  # to be put in order, rows are read twice
    last = ranking.numbered(ending, key, [-F.col("score"), *map(F.col, SEQUENCE)]).filter(F.col("before") + F.col("rank") <= F.col("k"))
    chosen = last.groupBy(*key).agg(((F.first("sum") + F.sum("y")) / F.first("k")).alias("mean"), F.min("score").alias("cut")).orderBy(*key).collect()  # a row a penalty
    best: dict[tuple[int, str], float] = {}
    for r in chosen:
        at = r["step"], r["variant"]
        if at not in best or r["mean"] > best[at] + 1e-12:
            best[at], fits[at].beta, fits[at].threshold = r["mean"], r["beta"], r["cut"]


def fits(rows: DataFrame, labels: list[str], variants: list[Variant], least: int = 1) -> tuple[dict[tuple[int, str], Model], dict[int, Sums]]:
    """A model for each step that has rows enough, and variant; rows have SEQUENCE, y, drift, buckets and `since`, their first step."""
    found = sums(rows, len(labels), least)
    out = {(i, v.label): own.model(v.names, labels[i]) for i, own in found.items() for v in variants}
    if out:
        _choose(rows, out, {v.label: v for v in variants}, found)
    return out, found


def fit(pool: DataFrame, names: tuple[str, ...] = NAMES, beta: float | None = None, label: str = "") -> Model | None:
    """Fits on rows with the signals' columns and y, a net return; None without rows."""
    rows = stored(bucketed(pool.filter("y is not null")).select(*SEQUENCE, "y", "drift", *bucket_columns(), F.lit(0).alias("since")), "training")
    found, _ = fits(rows, [label], [Variant("", names, BETAS if beta is None else (beta,))])
    return found.get((0, ""))


def best_per_day(scored: DataFrame) -> DataFrame:
    """The best-scored event of each ticker and entry day; of equals the first in the order of events."""
    best = scored.groupBy("ticker", "entry").agg(F.min(F.struct((-F.col("score")).alias("s"), *SEQUENCE)).alias("k"))
    return scored.join(best.select(*(F.col(f"k.{c}").alias(c) for c in SEQUENCE), "entry"), [*SEQUENCE, "entry"], "left_semi")


@dataclass
class WalkForward:
    """Models by test year and variant, and scored: each test year's events, the best one a ticker and day, a variant apart."""

    models: dict[tuple[int, str], Model]
    scored: DataFrame


def walk_forward(pool: DataFrame, variants: tuple[Variant, ...] = (Variant("all components"),), least: int = LEAST_TRAIN) -> WalkForward | None:
    """Fits and scores for each test year from the third on; training rows left before the year began.

    The number of jobs depends neither on years nor on variants. Years with fewer than `least` training rows are left out;
    None if there is no year.
    """
    spark = pool.sparkSession
    years = sorted(r["y"] for r in pool.select(F.year("entry").alias("y")).distinct().collect() if r["y"] is not None)[2:]  # a row a year
    if not years:
        return None
    since = sum(((F.col("exit") >= F.make_date(F.lit(y), F.lit(1), F.lit(1))).cast("int") for y in years), F.lit(0))
    kept = dict.fromkeys([*SEQUENCE, "entry", "exit", "cost", "y", "r", "drift"])
    rows = stored(bucketed(pool).select(*kept, *bucket_columns(), since.alias("since"), F.year("entry").alias("year")), "walk")
    found, own = fits(rows, [f"before {y}" for y in years], list(variants), least)
    if not found:
        return None
    step = F.array_position(F.array(*map(F.lit, years)), F.col("year")) - 1
    test = rows.withColumn("step", step.cast("int")).join(_fitted(spark, found, {v.label: v for v in variants}, own), "step")
    test = test.withColumn("quality", _quality()).withColumn("score", F.col("quality") * penalty(F.col("beta"))).withColumn("above", F.col("score") >= F.col("threshold"))
    row = ["year", "variant", *kept, "quality", "score", "above", "beta", "n_train"]
    best = test.groupBy("variant", "ticker", "entry").agg(F.min_by(F.struct(*row), F.struct(-F.col("score"), *SEQUENCE)).alias("best")).select("best.*")
    return WalkForward({(years[i], label): m for (i, label), m in found.items()}, stored(best.withColumn("cluster", F.year("entry") * 100 + F.month("entry")), "scored"))


def bucket_columns() -> list[str]:
    return [f"b_{c}" for c in components()]
