"""Lines that restate an earlier disclosure: amendment matching by three rules, and repeated filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions.stored import small, stored

#: kind and the equality key of each rule, in order of precedence; nulls equal nulls.
RULES = [
    ("amendment_duplicate", ["side", "trade_date", "shares", "price"]),
    ("amendment_correction", ["side", "trade_date"]),
    ("amendment_correction", ["side", "shares", "price"]),
]
LINE_ORDER = ["line_no", "trade_id"]


def _amended(trades: DataFrame) -> DataFrame:
    """amendment_matches() with original_date, the day on which the original line was filed.

    An amendment's lines and those of its original move once, to the amendment; all rules are windows within it.
    """
    keys, amendment = ["side", "trade_date", "shares", "price"], F.col("filing_id").alias("amendment")
    lines = trades.filter("amends_filing_id is not null")
    pairs = small(stored(lines.select(amendment, F.col("amends_filing_id").alias("original")).distinct(), "amendments"))
    columns = list(dict.fromkeys([*LINE_ORDER, *keys, "filed_on"]))
    mine = lines.select(amendment, *columns, F.lit(False).alias("_theirs"))
    theirs = trades.select("filing_id", *columns).join(pairs, F.col("filing_id") == F.col("original")).select("amendment", *columns, F.lit(True).alias("_theirs"))
    both = mine.unionByName(theirs).repartition("amendment").withColumns({"_hit": F.lit(False), "original_id": F.lit(None).cast("long"), "original_date": F.lit(None).cast("date"), "kind": F.lit(None).cast("string")})
    for kind, rule in RULES:
        of = ["amendment", "_hit", *rule]
        numbered = both.withColumn("_k", F.row_number().over(Window.partitionBy(*of, "_theirs").orderBy(*LINE_ORDER)))
        pair = Window.partitionBy(*of, "_k")
        found = numbered.withColumn("_other", F.max(F.when(F.col("_theirs"), F.struct("trade_id", "filed_on"))).over(pair)).withColumn("_asks", F.max(~F.col("_theirs")).over(pair))
        new = ~F.col("_hit") & F.col("_other").isNotNull() & F.col("_asks")
        told = {"original_id": F.col("_other.trade_id"), "original_date": F.col("_other.filed_on"), "kind": F.lit(kind)}
        both = found.withColumns({**{c: F.when(new, v).otherwise(F.col(c)) for c, v in told.items()}, "_hit": F.col("_hit") | new}).drop("_k", "_other", "_asks")
    return both.filter("_hit and not _theirs").select("trade_id", "original_id", "kind", "original_date")


def amendment_matches(trades: DataFrame) -> DataFrame:
    """(trade_id, original_id, kind): each amendment line with at most one line of the filing that it amends.

    Under each rule the k-th open line of a key takes the k-th unused original line of that key. Rules being equality
    keys, this is what taking the first unused original line by line gives, without a loop over lines.
    """
    return _amended(trades).drop("original_date")


#: Lines that repeated filings are looked for among.
ORDINARY = "coalesce(document_type not like '%/A', false) and shares is not null and price is not null"


def _told(trades: DataFrame) -> DataFrame:
    """Ordinary lines with `first`, the (trade_id, filed_on) of the line that each one repeats, or null."""
    keys = ["filer_id", "ticker", "side", "trade_date", "shares", "price"]
    lines = trades.filter(ORDINARY)
    ranked = lines.withColumn("f", F.dense_rank().over(Window.partitionBy(*keys).orderBy("filed_on", "filing_id"))).withColumn("k", F.row_number().over(Window.partitionBy(*keys, "filing_id").orderBy(*LINE_ORDER)))
    at = Window.partitionBy(*keys, "k").orderBy("f")
    first = F.first(F.struct("trade_id", "filed_on", "f")).over(at)
    found = ranked.withColumn("first", first)
    return found.withColumn("first", F.when((F.col("f") > 1) & (F.col("first.f") == 1), F.col("first"))).drop("f", "k")


def _as_repeat() -> dict[str, Column]:
    """What a line is told by, from `first`."""
    return {"original_id": F.col("first.trade_id"), "kind": F.when(F.col("first").isNotNull(), "duplicate_filing"), "original_date": F.col("first.filed_on")}


def _repeated(trades: DataFrame) -> DataFrame:
    """repeat_matches() with original_date, the day on which the original line was filed."""
    return _told(trades).filter("first is not null").select("trade_id", *(c.alias(name) for name, c in _as_repeat().items()))


def repeat_matches(trades: DataFrame) -> DataFrame:
    """(trade_id, original_id, kind): the k-th line of a later ordinary filing with the k-th equal line of the first one."""
    return _repeated(trades).drop("original_date")


def duplicates(trades: DataFrame) -> DataFrame:
    """(trade_id, original_id, kind, original_date): a line that both matchings find counts as a repeat."""
    repeats = _repeated(trades)
    return repeats.unionByName(_amended(trades).join(repeats.select("trade_id"), "trade_id", "left_anti"))


def effective_dates(trades: DataFrame, dups: DataFrame) -> DataFrame:
    """trades with original_id, kind and filing_date: a matched line's is the date its original line was filed."""
    return trades.join(dups, "trade_id", "left").withColumn("filing_date", F.coalesce("original_date", "filed_on")).drop("original_date")


def dated(trades: DataFrame, *kept: str) -> DataFrame:
    """(trade_id, kept, kind, filing_date) as effective_dates() with duplicates() finds them.

    Ordinary lines are told where their repeats are found, with no join; other lines, and those that also amend a filing and
    repeat none, are joined with what amendments match.
    """
    columns, amends = ["trade_id", *kept, "filed_on"], F.col("amends_filing_id").isNotNull()
    told = _told(trades).select(*columns, "amends_filing_id", *(_as_repeat()[c].alias(c) for c in ("kind", "original_date")))
    rest = trades.filter(f"not ({ORDINARY})").select(*columns)
    if not trades.filter(ORDINARY).filter(amends).isEmpty():
        rest, told = rest.unionByName(told.filter(amends & F.col("kind").isNull()).select(*columns)), told.filter(~amends | F.col("kind").isNotNull())
    rest = rest.join(_amended(trades).select("trade_id", "kind", "original_date"), "trade_id", "left")
    return told.drop("amends_filing_id").unionByName(rest).withColumn("filing_date", F.coalesce("original_date", "filed_on")).drop("original_date", "filed_on")
