"""As-of joins and counts over earlier rows, with every time bound stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions.stored import small, stored

#: Days of one piece of a key's time line in as-of joins, so that a hot key is many groups.
PIECE = 128


def asof(left: DataFrame, right: DataFrame, key: str, left_date: str, values: list[str], prefix: str, max_gap: int, forward: bool = False, strict: bool = False) -> DataFrame:
    """left with prefix_date and prefix_<value> of the nearest row of right (key, date, values) at most max_gap days off.

    Backward takes the last row on or before left_date, forward the first one on or after; strict leaves left_date itself
    out. Only the distinct keys and dates of left go through the search, and what it finds is joined to left's rows. Both
    time lines are cut into pieces of PIECE days, and right rows are copied into the next piece as far as max_gap reaches, so
    groups stay small; one window over both finds the match. Rows with a null key or date match nothing.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    low = number("date") - (max_gap if forward else 0)
    high = number("date") + (0 if forward else max_gap)
    pieces = F.explode(F.sequence(F.floor(low / PIECE), F.floor(high / PIECE)))
    found = F.struct(F.col("date"), *(F.col(v) for v in values))
    theirs = right.filter(F.col("date").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), pieces.alias("_p"), F.col("date").alias("_d"), found.alias("_r"))
    asked = left.select(F.col(key).alias("_k"), F.col(left_date).alias("_d")).filter("_k is not null and _d is not null").distinct().withColumn("_p", F.floor(number("_d") / PIECE))
    # at one date: right rows come first, unless strict
    both = theirs.withColumn("_o", F.lit(1 if strict else 0)).unionByName(asked.withColumn("_o", F.lit(0 if strict else 1)), allowMissingColumns=True)
    order = [F.desc("_d") if forward else F.col("_d"), F.col("_o")]
    near = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    gap = F.abs(F.datediff("_r.date", "_d"))
    hits = both.withColumn("_r", near).filter((F.col("_o") == (0 if strict else 1)) & (gap <= max_gap)).select("_k", "_d", "_r")
    rows = left.join(hits, (F.col(key) == F.col("_k")) & (F.col(left_date) == F.col("_d")), "left")
    return rows.select(*left.columns, F.col("_r.date").alias(f"{prefix}_date"), *(F.col(f"_r.{v}").alias(f"{prefix}_{v}") for v in values))


def met(left: DataFrame, right: DataFrame, key: str, left_date: str, max_gap: int, out: str) -> DataFrame:
    """left with `out`, whether right (key, date) has a row on left_date or at most max_gap days later.

    Rows of both move once, to their key and piece of PIECE days, right rows to the next piece as well where they reach into it;
    rows without a key or date meet nothing and stay where they are.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    theirs = right.select(F.col(key).alias("_k"), number("date").alias("_d")).filter("_k is not null and _d is not null")
    theirs = theirs.select("_k", F.explode(F.sequence(F.floor((F.col("_d") - max_gap) / PIECE).cast("int"), F.floor(F.col("_d") / PIECE).cast("int"))).alias("_p"), "_d", F.lit(0).alias("_o"))
    asks = F.col(key).isNotNull() & F.col(left_date).isNotNull()
    asked = left.filter(asks).select("*", F.col(key).alias("_k"), F.floor(number(left_date) / PIECE).cast("int").alias("_p"), number(left_date).alias("_d"), F.lit(1).alias("_o"))
    both = theirs.unionByName(asked, allowMissingColumns=True)
    near = F.last(F.when(F.col("_o") == 0, F.col("_d")), ignorenulls=True).over(Window.partitionBy("_k", "_p").orderBy(F.desc("_d"), "_o").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_n", near).filter("_o = 1").select(*left.columns, F.coalesce(F.col("_n") - F.col("_d") <= max_gap, F.lit(False)).alias(out))
    return rows.unionByName(left.filter(~asks).withColumn(out, F.lit(False)))


def asof_all(left: DataFrame, right: DataFrame, key: str, lookups: list[tuple[str, list[str], str, int, bool]], placed: bool = False) -> DataFrame:
    """left with the nearest rows of right (key, date, values) for several dates of its own: what asof() finds for each lookup
    (left_date, values, prefix, max_gap, forward), one after the other.

    Rows of both move once, to their key: a row of left asks once a date and carries its columns with the first question;
    all dates are searched in one window each way, and a row's answers are put together where they are found. Rows without
    a key match nothing and stay where they are. placed says that right's rows are with their key already: only left's move then.
    """
    named = {way: list(dict.fromkeys(v for _, values, *_, forward in lookups if forward is way for v in values)) for way in sorted({forward for *_, forward in lookups})}
    whole = F.struct(*(F.col(c) for c in left.columns))
    questions = F.array(*(F.struct(F.lit(i).alias("w"), F.col(date).alias("d"), whole.alias("l") if i == 0 else F.lit(None).cast(left.schema).alias("l")) for i, (date, *_) in enumerate(lookups)))
    numbered = left.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.monotonically_increasing_id().alias("_id"), questions.alias("q"))  # before rows are copied
    asked = numbered.select("_k", "_id", F.explode("q").alias("q"))
    asked = asked.select("_k", "_id", F.col("q.w").alias("_w"), F.col("q.d").alias("_d"), F.col("q.l").alias("_l"))
    asked = asked.repartition("_k") if placed else asked
    rows = right.filter(F.col("date").isNotNull() & F.col(key).isNotNull())
    theirs = rows.select(F.col(key).alias("_k"), F.lit(-1).alias("_w"), F.col("date").alias("_d"), *(F.struct("date", *values).alias(f"_r{int(way)}") for way, values in named.items()))
    both = theirs.unionByName(asked, allowMissingColumns=True)
    by = Window.partitionBy("_k")  # at one date, right rows (-1) come first
    near = lambda way: F.last(f"_r{int(way)}", ignorenulls=True).over(by.orderBy(F.desc("_d") if way else F.col("_d"), "_w").rowsBetween(Window.unboundedPreceding, 0))
    for way in named:  # a way's own values alone, and none of them once it is searched
        both = both.withColumn(f"_{int(way)}", near(way)).drop(f"_r{int(way)}")
    both = both.filter("_w >= 0")
    answers = [F.when((F.col("_w") == i) & (F.abs(F.datediff(F.col(f"_{int(forward)}.date"), F.col("_d"))) <= gap), F.struct(*(F.col(f"_{int(forward)}.{c}") for c in ("date", *values)))) for i, (_, values, _, gap, forward) in enumerate(lookups)]
    found = both.groupBy("_k", "_id").agg(F.first("_l", ignorenulls=True).alias("_l"), *(F.first(x, ignorenulls=True).alias(f"_a{i}") for i, x in enumerate(answers)))
    out = found.select("_l.*", *(F.col(f"_a{i}.{c}").alias(f"{prefix}_{c}") for i, (_, values, prefix, *_) in enumerate(lookups) for c in ("date", *values)))
    return out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)


def last_known(left: DataFrame, right: DataFrame, key: str, left_date: Column, values: list[str], prefix: str) -> DataFrame:
    """left with prefix_date and prefix_<value> of the last row of right (key, date, values) on or before a date, however old.

    One window over right's rows and the distinct dates asked; right has at most a row a key and date, so a group is bounded
    by the calendar. Null keys match nothing.
    """
    asked = left.select(F.col(key).alias("_k"), left_date.alias("_d")).filter("_k is not null and _d is not null").distinct()
    found = F.struct(F.col("date"), *(F.col(v) for v in values)).alias("_r")
    theirs = right.select(F.col(key).alias("_k"), F.col("date").alias("_d"), F.lit(0).alias("_o"), found)
    near = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_d", "_o").rowsBetween(Window.unboundedPreceding, 0))
    rows = theirs.unionByName(asked.withColumn("_o", F.lit(1)), allowMissingColumns=True).withColumn("_r", near).filter("_o = 1").drop("_o")
    joined = left.withColumn("_on", left_date).join(rows, (F.col(key) == F.col("_k")) & (F.col("_on") == F.col("_d")), "left")
    return joined.select(*left.columns, F.col("_r.date").alias(f"{prefix}_date"), *(F.col(f"_r.{v}").alias(f"{prefix}_{v}") for v in values))


def running(df: DataFrame, keys: list[str], date: str, sums: dict[str, str], days: int | None = None) -> DataFrame:
    """(keys, date, sums) of rows strictly before each date, at most `days` days before, from one row a (keys, date)."""
    number = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(*keys).orderBy(number).rangeBetween(Window.unboundedPreceding if days is None else -days, -1)
    return df.select(*keys, date, *(F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(n) for n, c in sums.items()))


def known_spans(rows: DataFrame, key: str, known: str, replaces: str) -> DataFrame:
    """rows with known_to: the first day on which a row was known that replaces their key; null as long as there is none.

    Together with the day on which a row itself became known this tells what was current at any time, apart from the date
    that the row is about.
    """
    later = rows.filter(F.col(replaces).isNotNull()).groupBy(F.col(replaces).alias("_replaced")).agg(F.min(known).alias("known_to"))
    return rows.join(small(stored(later, "replaced")), F.col(key) == F.col("_replaced"), "left").drop("_replaced")


def replay(spans: DataFrame, cuts: list[str], dated: str, known: str, groups: list[str], figures: list[Column]) -> DataFrame:
    """(cut, state, groups, figures) of rows with known_to, as someone would have seen them at the end of each cut day.

    A row that had happened by a cut is "current", "replaced" by a row known by then, or "unknown" as it became known later.
    All cuts are looked at in one pass: a row is told apart in memory and only sums by cut and state are shuffled.
    """
    day = lambda c: F.lit(c).cast("date")
    state = lambda c: F.when(F.col(known) > c, "unknown").when(F.col("known_to") <= c, "replaced").otherwise("current")
    seen = F.array_compact(F.array(*(F.when(F.col(dated) <= day(c), F.struct(day(c).alias("cut"), state(day(c)).alias("state"))) for c in cuts)))
    rows = spans.withColumn("_seen", F.explode(seen)).withColumns({"cut": F.col("_seen.cut"), "state": F.col("_seen.state")})
    return rows.groupBy("cut", "state", *groups).agg(*figures)
