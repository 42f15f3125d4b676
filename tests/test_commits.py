"""Commits over several tables."""

import pytest
from pyspark.sql import functions as F

from ledgerwind.operators import commits, store

FILINGS, LINES, FILERS = "source string, accession string, accepted_at int, form string", "source string, accession string, line_no int, ticker string, issuer_cik string", "source string, cik string, name string"


def load(spark, filings, lines, filers=()):
    return spark.createDataFrame(filings, FILINGS), spark.createDataFrame(lines, LINES), spark.createDataFrame(list(filers), FILERS)


def rows(db, name, version=None):
    return sorted(map(tuple, db.read(name, version=version).collect()), key=str)


def test_filings_lines_and_filers_in_one_commit(spark, tmp_path):
    db = commits.Store(spark, f"file://{tmp_path}/db")
    one = load(spark, [("e", "a", None, "4"), ("e", "b", 1, "4"), ("e", "b", 1, "4")], [("e", "a", 0, None, "7"), ("e", "b", 0, "X", "8")], [("e", "1", "Doe")])
    assert commits.save_filings(db, *one) == {"filings": 2, "lines": 2, "filers": 1, "filled": 0}
    two = load(spark, [("e", "a", 5, "4/A"), ("e", "b", 6, "4"), ("f", "a", None, "3")], [("e", "a", 0, "Z", "7"), ("e", "a", 1, None, "9"), ("f", "a", 0, None, "7")], [("e", "1", "Other"), ("e", "2", "Roe")])
    assert commits.save_filings(db, *two) == {"filings": 1, "lines": 2, "filers": 1, "filled": 1}
    assert rows(db, "filings") == [("e", "a", 5, "4"), ("e", "b", 1, "4"), ("f", "a", None, "3")]
    assert rows(db, "filings", 1) == [("e", "a", None, "4"), ("e", "b", 1, "4")]
    assert rows(db, "filers") == [("e", "1", "Doe"), ("e", "2", "Roe")] and len(rows(db, "lines")) == 4
    assert db.manifest()["tables"]["filings"]["rows"] == 3 and db.manifest()["tables"]["lines"]["rows"] == 4
    assert commits.save_filings(db, *two) == {"filings": 0, "lines": 0, "filers": 0, "filled": 0}
    assert commits.fill_tickers(db, spark.createDataFrame([("7", "S7"), ("8", "S8"), ("5", None)], "issuer_cik string, ticker string")) == 2
    assert sorted((r.accession, r.line_no, r.ticker or "") for r in db.read("lines").collect()) == [("a", 0, "S7"), ("a", 0, "S7"), ("a", 1, ""), ("b", 0, "X")]


def test_a_write_that_is_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    db = commits.Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    db.commit({"a": a, "b": a})

    def broken(self, manifest):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(commits.Store, "_publish", broken)
        with pytest.raises(OSError, match="killed"):
            db.commit({"a": a}, {"b": a.limit(0)})
    assert db.versions() == [1] and rows(db, "a") == rows(db, "b") == [(1, "x")]
    with pytest.raises(Exception, match="k|wrong|DIVIDE"):  # data of one table written, that of the other not
        db.commit({"a": a}, {"b": a.withColumn("v", F.expr("string(1 / (k - 1))"))})
    assert db.versions() == [1] and rows(db, "a") == [(1, "x")]
    assert db.vacuum() >= 2 and rows(db, "a") == rows(db, "b") == [(1, "x")]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    db = commits.Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1,)], "k int")
    db.commit({"a": a})
    db.commit({"a": a}, base=1)
    with pytest.raises(commits.Conflict):
        db.commit({"a": a}, base=1)
    assert db.versions() == [1, 2] and rows(db, "a") == [(1,), (1,)]


def test_many_appends_are_joined_and_old_versions_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_FOLDERS", 3)
    db = commits.Store(spark, str(tmp_path))
    for i in range(6):
        db.commit({"a": spark.createDataFrame([(i,)], "k int").coalesce(1)})
    assert rows(db, "a") == [(i,) for i in range(6)] and len(db.manifest()["tables"]["a"]["folders"]) <= 3
    assert rows(db, "a", 2) == [(0,), (1,)]
    db.vacuum(keep=2)
    assert db.versions() == [5, 6] and rows(db, "a") == [(i,) for i in range(6)]


def test_deleting_parents_takes_children_along(spark, tmp_path):
    db = commits.Store(spark, str(tmp_path))
    frame = spark.createDataFrame
    db.commit({"filings": frame([(1,), (2,)], "filing_id int"), "trades": frame([(1, 10, None), (2, 20, 10), (2, 21, 20)], "filing_id int, trade_id int, duplicate_of int")})
    mend = lambda trades, gone: store.set_null(trades, gone.select("filing_id").join(db.read("trades", version=1), "filing_id").select("trade_id"), "trade_id", "duplicate_of")
    left = commits.delete(db, frame([(1,)], "filing_id int"), "filings", "filing_id", {"trades": ["filing_id"]}, {"trades": mend})
    assert left == {"filings": 1, "trades": 2} and rows(db, "trades") == [(2, 20, None), (2, 21, 20)]
