"""Business-day calendars as a dimension table: SEC (federal offices) and NYSE sessions, 1990 to 2030.

Holidays follow rules; unscheduled closures are listed. The table has one row a date, about 15,000, so it is broadcast.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST, LAST = date(1990, 1, 1), date(2030, 12, 31)

# Federal offices closed by proclamation or executive order.
FEDERAL_EXTRA = ["2018-12-05", "2018-12-24", "2019-12-24", "2020-12-24", "2024-12-24", "2025-01-09", "2025-12-24", "2025-12-26"]
# Unscheduled full-day closures of the exchange.
NYSE_EXTRA = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]


def nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday 0) of a month, the last for n = -1."""
    days = [d for d in (date(year, month, 1) + timedelta(i) for i in range(31)) if d.month == month and d.weekday() == weekday]
    return days[n - 1 if n > 0 else n]


def observed(d: date) -> date:
    """A Saturday's holiday is kept on Friday, a Sunday's on Monday."""
    return d + timedelta({5: -1, 6: 1}.get(d.weekday(), 0))


def good_friday(year: int) -> date:
    """Two days before Gregorian Easter: the Sunday after the first full moon of the church from 21 March on."""
    century, golden = year // 100 + 1, year % 19 + 1
    epact = (11 * golden + 20 + ((8 * century + 5) // 25 - 5) - (3 * century // 4 - 12)) % 30
    if epact == 24 or (epact == 25 and golden > 11):
        epact += 1
    moon = 44 - epact if 44 - epact >= 21 else 74 - epact  # day of March
    full = date(year, 3, 1) + timedelta(moon - 1)
    return full + timedelta(6 - full.weekday() or 7) - timedelta(2)


@cache
def holidays(calendar: str) -> list[date]:
    """Holidays of the calendar "sec" or "nyse" in ascending order, weekends left out."""
    out: set[date] = set()
    for y in range(FIRST.year, LAST.year + 1):
        both = [nth(y, 2, 0, 3), nth(y, 5, 0, -1), observed(date(y, 7, 4)), nth(y, 9, 0, 1), nth(y, 11, 3, 4), observed(date(y, 12, 25))]
        king, juneteenth, new_year = nth(y, 1, 0, 3), observed(date(y, 6, 19)), date(y, 1, 1)
        if calendar == "sec":
            both += [king, nth(y, 10, 0, 2), observed(date(y, 11, 11)), observed(new_year), observed(date(y + 1, 1, 1))]
            both += [juneteenth] * (y >= 2021)
        else:  # a Saturday's New Year is not made up for on the exchange
            both += [good_friday(y)] + [king] * (y >= 1998) + [juneteenth] * (y >= 2022) + [observed(new_year)] * (new_year.weekday() != 5)
        out |= {d for d in both if d.year == y}
    out |= {date.fromisoformat(d) for d in (FEDERAL_EXTRA if calendar == "sec" else NYSE_EXTRA)}
    return sorted(d for d in out if d.weekday() < 5)


def calendar(spark: SparkSession) -> DataFrame:
    """(d, is_sec, is_nyse, cum_sec, cum_nyse); cum counts business days up to and with d."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(FIRST), F.lit(LAST))).alias("d"))
    week = F.weekday("d") < 5
    for name in ("sec", "nyse"):
        days = days.withColumn(f"is_{name}", week & ~F.col("d").isin(holidays(name)))
    upto = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # a fixed number of rows
    for name in ("sec", "nyse"):
        days = days.withColumn(f"cum_{name}", F.sum(F.col(f"is_{name}").cast("int")).over(upto).cast("int"))
    return days


def with_ordinal(df: DataFrame, days: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """df with `out`, the number of business days up to the date in `column` (null for null or a date out of range)."""
    side = F.broadcast(days.select(F.col("d").alias("_d"), F.col(f"cum_{name}").alias(out)))
    return df.join(side, df[column] == side["_d"], "left").drop("_d")


def business_days_between(df: DataFrame, days: DataFrame, start: str, end: str, name: str, out: str) -> DataFrame:
    """df with `out`, business days in (start, end], negative if end is before start."""
    df = with_ordinal(with_ordinal(df, days, start, name, "_from"), days, end, name, "_to")
    return df.withColumn(out, F.col("_to") - F.col("_from")).drop("_from", "_to")


def add_business_days(df: DataFrame, days: DataFrame, column: str, n: int | Column, name: str, out: str) -> DataFrame:
    """df with `out`, the date n business days after `column`, for n >= 1; `column` itself for n = 0."""
    side = F.broadcast(days.filter(f"is_{name}").select(F.col("d").alias(out), F.col(f"cum_{name}").alias("_cum")))
    n = F.lit(n) if isinstance(n, int) else n
    df = with_ordinal(df, days, column, name, "_at").withColumn("_n", n).withColumn("_want", F.col("_at") + F.col("_n"))
    df = df.join(side, F.col("_want") == F.col("_cum"), "left")
    return df.withColumn(out, F.when(F.col("_n") == 0, F.col(column)).otherwise(F.col(out))).drop("_at", "_n", "_want", "_cum")


def on_or_before(df: DataFrame, days: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """df with `out`, the last business day not after `column`."""
    side = F.broadcast(days.filter(f"is_{name}").select(F.col("d").alias(out), F.col(f"cum_{name}").alias("_cum")))
    df = with_ordinal(df, days, column, name, "_at")
    return df.join(side, F.col("_at") == F.col("_cum"), "left").drop("_at", "_cum")


def quarters(spec: Column) -> Column:
    """The quarters of a range such as 2015q3-2016q2, or of one quarter, as an array; null for anything else."""
    ends = F.split(F.trim(spec), "-")
    number = lambda q: F.when(q.rlike(r"^[0-9]{4}q[1-4]$"), F.substring(q, 1, 4).cast("int") * 4 + F.substring(q, 6, 1).cast("int") - 1)
    first, last = number(F.get(ends, F.lit(0))), number(F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))))
    name = lambda n: F.concat(F.floor(n / 4).cast("string"), F.lit("q"), (n % 4 + 1).cast("string"))
    none = F.array().cast("array<string>")
    return F.when(first.isNotNull() & last.isNotNull() & (F.size(ends) <= 2), F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), name)).otherwise(none))


def quarter_bounds(quarter: Column) -> tuple[Column, Column]:
    """The first and the last day of a quarter such as 2015q3."""
    start = F.make_date(F.substring(quarter, 1, 4).cast("int"), F.substring(quarter, 6, 1).cast("int") * 3 - 2, F.lit(1))
    return start, F.last_day(F.add_months(start, 2))
