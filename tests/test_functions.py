from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerwind.functions import calendars as cal
from ledgerwind.functions import sectors, text


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()]


@pytest.fixture(scope="module")
def days(spark):
    return cal.calendar(spark).cache()


def test_rules_of_holidays():
    sec, nyse = set(cal.holidays("sec")), set(cal.holidays("nyse"))
    assert date(2024, 3, 29) in nyse - sec and date(2024, 10, 14) in sec - nyse  # Good Friday, Columbus Day
    assert date(2021, 12, 31) in sec - nyse  # New Year on a Saturday
    assert date(2021, 6, 18) in sec - nyse and date(2022, 6, 20) in sec & nyse  # Juneteenth
    assert date(1997, 1, 20) in sec - nyse and date(1998, 1, 19) in nyse
    assert date(2012, 10, 29) in nyse - sec
    assert [str(cal.good_friday(y)) for y in (1990, 2000, 2008, 2011, 2024, 2025)] == ["1990-04-13", "2000-04-21", "2008-03-21", "2011-04-22", "2024-03-29", "2025-04-18"]


def test_calendar_counts_every_pair_like_a_loop(spark, days):
    sessions = {name: {r.d for r in days.filter(f"is_{name}").select("d").collect()} for name in ("sec", "nyse")}
    assert len([d for d in sessions["nyse"] if d.year == 2024]) == 252
    pairs = [(date(2020, 1, 1 + i), date(2020, 3, 1 + (7 * i) % 28)) for i in range(25)] + [(date(2024, 4, 1), date(2024, 3, 27)), (date(2024, 1, 1), date(2024, 1, 1))]
    df = spark.createDataFrame(pairs, "a date, b date")
    for name, open_ in sessions.items():
        for r in cal.business_days_between(df, days, "a", "b", name, "n").collect():
            lo, hi = min(r.a, r.b), max(r.a, r.b)
            n = sum(lo < d <= hi for d in open_)
            assert r.n == (n if r.b >= r.a else -n)
    got = cal.on_or_before(cal.add_business_days(df, days, "a", 3, "nyse", "third"), days, "a", "nyse", "last").collect()
    ordered = sorted(sessions["nyse"])
    for r in got:
        assert r.third == [d for d in ordered if d > r.a][2] and r.last == [d for d in ordered if d <= r.a][-1]
    assert cal.add_business_days(df, days, "a", 0, "nyse", "same").filter("same <> a").count() == 0


def test_clean_ticker(spark):
    cases = {"aapl": "AAPL", "NONE": None, "N/A": None, "(SIRI)": "SIRI", "NYSE: SCS": "SCS", "Z AND ZG": "Z", "GEF,GEF.B": "GEF", "B R K": "BRK", "[BRK.B]": "BRK.B", "": None, None: None, "NASDAQ/ABC": "ABC", "TOOLONGNAME": None, "BF-B": "BF-B", "nil": None, "OTCQB: XYZ": "XYZ", "--": None}
    got = values(spark, [(k,) for k in cases], "s string", s=F.col("s"), t=text.clean_ticker(F.col("s")))
    assert dict(got) == cases


def test_roles_owners_and_flags(spark):
    rows = [("Chief Executive Officer", False, True, False), ("CFO & VP", True, False, False), ("Clerk", False, False, True), (None, True, True, False), (None, False, True, True), (None, False, False, True), ("", False, False, False), ("ceox", False, True, False)]
    got = values(spark, rows, "t string, o boolean, d boolean, p boolean", r=text.classify_role(F.col("t"), F.col("o"), F.col("d"), F.col("p")))
    assert [r[0] for r in got] == ["CEO", "CFO", "officer", "officer", "director", "10% owner", None, "officer"]
    got = values(spark, [("D", "wife"), ("I", "By Wife"), ("I", "person"), ("I", "Family Trust"), ("I", None), (None, "x"), ("", "x")], "d string, n string", o=text.owner_from_nature(F.col("d"), F.col("n")))
    assert [r[0] for r in got] == ["self", "spouse", "child", "trust", "indirect", "self", "self"]
    got = values(spark, [(" Yes",), ("1",), ("0",), (None,)], "v string", t=text.truthy(F.col("v")))
    assert [r[0] for r in got] == [True, True, False, False]


def test_identifiers_dates_and_numbers(spark):
    got = values(spark, [("0001234",), ("000",), (None,)], "c string", c=text.clean_cik(F.col("c")))
    assert [r[0] for r in got] == ["1234", None, None]
    assert values(spark, [(["007", "12", "7", "0", None],)], "c array<string>", c=text.owner_ciks(F.col("c"))) == [(["12", "7"],)]
    got = values(spark, [("02-JAN-2024",), ("2024-01-02",), ("2024-13-02",), ("junk",), (None,)], "d string", d=text.sec_date(F.col("d")))
    assert [r[0] for r in got] == [date(2024, 1, 2), date(2024, 1, 2), None, None, None]
    got = values(spark, [("1,234.5",), ("nan",), ("",), ("x",), (None,)], "n string", n=text.number(F.col("n"), "double"))
    assert [r[0] for r in got] == [1234.5, None, None, None, None]
    got = values(spark, [(datetime(2024, 3, 7, 3, 30),)], "t timestamp", d=text.eastern_date(F.col("t")), m=text.eastern_midnight(F.lit("2024-07-01").cast("date")))
    assert got[0][0] == date(2024, 3, 6) and str(got[0][1]).endswith("04:00:00")
    assert [r[0] for r in values(spark, [(1_234_567.0,), (35_400.0,), (900.0,)], "v double", m=text.money(F.col("v")))] == ["$1.2M", "$35k", "$900"]


def test_primary_owner(spark):
    rows = [("a", "12", "director"), ("a", "7", "director"), ("a", "0", "officer"), ("b", "", None), ("b", "5", None), ("c", "9", "10% owner"), ("c", "99", "CEO")]
    got = text.primary_owners(spark.createDataFrame(rows, "f string, cik string, role string"), ["f"]).collect()
    assert {r.f: r.cik for r in got} == {"a": "0", "b": "5", "c": "99"}


def test_sector_ranges(spark):
    cases = {"1311": "XLE", "1400": "XLB", "2834": "XLV", "2821": "XLB", "6770": "SPY", "6798": "XLRE", "6022": "XLF", "7372": "XLK", "7310": "XLC", "7350": "XLI", "9999": "SPY", "x": "SPY", "": "SPY", None: "SPY", "5912": "XLP", "5411": "XLP", "5311": "XLY"}
    got = values(spark, [(k,) for k in cases], "s string", s=F.col("s"), e=sectors.sector_etf(F.col("s")))
    assert dict(got) == cases and len(sectors.ranges()) == 56
