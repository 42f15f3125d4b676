"""Host-level quality rules: rule failures by host, shrunk by an empirical beta prior, joined back to documents.

Everything runs as DataFrame expressions. Each document gets its counts and the rules it fails. A host's failure rate is
the share of its documents that fail any rule; a beta prior fitted to all hosts by moments shrinks it, so hosts with few
documents stay near the mean. The verdict is how many soft rules a document of the host may fail: with rate r, and a bad
document taken to be LIKELIER times as likely as a good one to fail a soft rule, a document that fails k is kept if

    r / (1 - r) * LIKELIER ** k <= 1.

So a host of bad documents (r > 1/2) loses all of its documents, a usual host those that fail a rule, and a good host
is forgiven one or more. Documents that fail a base rule go in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.shared import written

LEAST_WORDS, MOST_REPEATED = 50, 50
LIKELIER = 20.0
#: Hosts up to which the verdict table (about 40 bytes a host) is broadcast; beyond, it is joined by shuffle.
BROADCAST_HOSTS = 100_000
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _long(column: Column) -> Column:
    return column.cast("long")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    If the windows' hashes are all distinct there are none. Otherwise the windows themselves are sorted, those equal to
    a neighbour are repeated, and their places, in order, each add the words up to the next one, three at most.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p")))

    def covered(rows: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(rows, i)["g"] == x["g"], F.lit(False))
        found = F.sort_array(F.transform(F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))
        return _let(found, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    none = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < 4, 0).when(none, 0).otherwise(_let(F.sort_array(windows), covered))


def rules(text: Column) -> Column:
    """Struct of a text's counts, the soft rules it fails, and whether it fails a base rule. Null counts as no word."""

    def counted(text: Column, words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(
            lines,
            lambda lines: F.struct(
                _long(F.size(words)).alias("n_words"),
                _long(F.length(F.array_join(words, ""))).alias("word_chars"),
                _long(F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).alias("n_symbols"),
                _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
                _long(_repeated_words(words)).alias("n_repeat_words"),
                _long(F.size(lines)).alias("n_lines"),
            ),
        )

    def failed(c: Column) -> Column:
        base = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
        soft = [10 * c["n_symbols"] > c["n_words"], 10 * c["n_dup_lines"] > 3 * c["n_lines"], ~c["word_chars"].between(2 * c["n_words"], 15 * c["n_words"])]
        return F.struct(*(c[n].alias(n) for n in COUNTS), base.alias("base_failed"), sum((s.cast("int") for s in soft), F.lit(0)).alias("n_soft"))

    text = F.coalesce(text, F.lit(""))
    return _let(text, lambda t: _let(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda w: _let(counted(t, w), failed)))


def verdicts(checked: DataFrame) -> DataFrame:
    """(source, allowed): how many soft rules a document of a host may fail, -1 for none kept, from (source, rules)."""
    bad = (F.col("rules.base_failed") | (F.col("rules.n_soft") > 0)).cast("long")
    hosts = written(checked.groupBy("source").agg(F.count("*").alias("n"), F.sum(bad).alias("bad")), "hosts")
    moments = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n"), 2)).alias("squares"), F.count("*").alias("hosts"))
    mean = F.col("total_bad") / F.col("total_n")
    # between hosts: the rates' variance less what chance alone gives
    variance = F.col("squares") / F.col("total_n") - mean * mean - mean * (1 - mean) * F.col("hosts") / F.col("total_n")
    strength = F.when(variance > 0, F.least(F.greatest(mean * (1 - mean) / variance - 1, F.lit(1.0)), F.lit(1e4))).otherwise(F.lit(1e4))
    prior = moments.withColumnsRenamed({"n": "total_n", "bad": "total_bad"}).select(mean.alias("mean"), strength.alias("strength")).first()  # one row
    mean, strength = (prior["mean"] or 0.0, prior["strength"] or 1.0)
    rate = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    allowed = F.when(rate <= 0, 99).when(rate >= 1, -1).otherwise(F.greatest(F.lit(-1), F.least(F.lit(99), F.floor(F.log((1 - rate) / rate) / F.log(F.lit(LIKELIER))))))
    return hosts.select("source", allowed.cast("int").alias("allowed"))


def _judged(checked: DataFrame, hosts: DataFrame) -> DataFrame:
    """checked with `kept`; its columns stay."""
    hosts = written(hosts.select(F.col("source").alias("_host"), F.col("allowed").alias("_allowed")), "verdicts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    kept = ~F.col("rules.base_failed") & (F.col("rules.n_soft") <= F.col("_allowed"))
    return checked.join(hosts, checked["source"].eqNullSafe(hosts["_host"])).withColumn("kept", kept).drop("_host", "_allowed")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for each row of docs (doc_id, text, source).

    A null or empty text has no words, so it fails; a null source is a host of its own. Repeated rows count and return
    as often as they stand; a null doc_id stays null; other columns are ignored; an empty table gives none.
    """
    checked = written(docs.select("doc_id", F.col("source").cast("string"), rules(F.col("text")).alias("rules")), "rules")
    return _judged(checked, verdicts(checked)).select("doc_id", *(f"rules.{n}" for n in COUNTS), "rules.base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns.

    Rules are evaluated once, beside a written copy of the rows that pass the base rules; texts are never shuffled.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ruled = docs.select(whole.alias("doc"), F.col("source").cast("string"), rules(F.col("text")).alias("rules"))
    checked = written(ruled.withColumn("doc", F.when(~F.col("rules.base_failed"), F.col("doc"))), "ruled")
    return _judged(checked, verdicts(checked.select("source", "rules"))).filter("kept").select("doc.*")
