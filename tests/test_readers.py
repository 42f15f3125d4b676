"""Zipped tables, ownership documents and feed pages as Spark data sources."""

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerwind.sources import feeds, filings, zipped
from ledgerwind.streaming import poll


def archive(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, lines in members.items():
            z.writestr(f"q/{name}.TSV", "\n".join(lines) + "\n")


def test_zipped_tables_read_one_member_and_filter_lines(spark, tmp_path, monkeypatch):
    rows = [f"{i}\t{'4' if i % 3 else '3'}\t{'x' * (i % 4)}" for i in range(25_000)]
    archive(tmp_path / "a.zip", Submission=["ACCESSION_NUMBER\tDOCUMENT_TYPE\tREMARKS", *rows], footnotes=["FOOTNOTE_ID", "F1"])
    archive(tmp_path / "b.zip", submission=["DOCUMENT_TYPE\tACCESSION_NUMBER", "4/A\tb1", "4", ""])
    archive(tmp_path / "c.zip", other=["A"])
    (tmp_path / "empty").mkdir()
    df = zipped.table(spark, f"{tmp_path}/*.zip", "SUBMISSION", ["ACCESSION_NUMBER", "DOCUMENT_TYPE", "REMARKS"])
    assert df.count() == 25_003 and df.rdd.getNumPartitions() == 3
    some = df.filter(F.col("DOCUMENT_TYPE").isin("4", "4/A") & (F.col("DOCUMENT_TYPE") != "x") & (F.length("REMARKS") > 2))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "IN (4,4/A)" not in plan and "length" in plan  # the form is looked at where lines are read, the rest by Spark
    assert some.count() == sum(i % 3 > 0 and i % 4 == 3 for i in range(25_000))
    assert sorted((r[0], r[1]) for r in df.filter("DOCUMENT_TYPE = '4/A'").collect()) == [("b1", "4/A")]
    assert df.filter("DOCUMENT_TYPE = '4' and ACCESSION_NUMBER is null").count() == 1  # a line that ends early


def test_footnotes_that_a_line_cites_in_any_column(spark, tmp_path):
    archive(tmp_path / "a.zip",
        SUBMISSION=["ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERTRADINGSYMBOL", "a\t2024-01-05\t4\tabc"], REPORTINGOWNER=["ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME", "a\t9\tDoe"],
        NONDERIV_TRANS=["ACCESSION_NUMBER\tNONDERIV_TRANS_SK\tTRANS_DATE\tTRANS_CODE\tEQUITY_SWAP_TRANS_CD_FN\tNATURE_OF_OWNERSHIP_FN", "a\t1\t2024-01-02\tP\t\tF1, F7", "a\t2\t2024-01-02\tP\tF2\t"],
        FOOTNOTES=["ACCESSION_NUMBER\tFOOTNOTE_ID\tFOOTNOTE_TXT", "a\tF7\tRule 10b5-1", "a\tF2\tother"])
    _, lines = filings.quarter(spark, f"{tmp_path}/a.zip")
    assert sorted((r.line_no, r.is_10b5_1) for r in lines.collect()) == [(0, True), (1, False)]


OWNER = "<reportingOwner><reportingOwnerId><rptOwnerCik>007</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId></reportingOwner>"


def document(date="2024-01-02", owner=OWNER, period="2024-01-03", code="P", tail=""):
    line = f"<nonDerivativeTransaction><transactionDate><value>{date}</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding></nonDerivativeTransaction>"
    return f'<?xml version="1.0"?><e><ownershipDocument><periodOfReport>{period}</periodOfReport>{owner}<nonDerivativeTable>{line}</nonDerivativeTable>{tail}</ownershipDocument></e>'


CASES = {
    "good": (document(), None), "bare": (document().replace("<e>", "").replace("</e>", ""), None), "blank line date": (document(date=""), None), "other code": (document(date="soon", code="F"), None), "time zone": (document(date="2024-01-02-05:00"), None),
    "none": ("<e/>", "no ownershipDocument"), "empty": ("", "no ownershipDocument"), "null": (None, "no document"), "cut": (document()[:-40], "malformed"), "broken": (document(tail="<a></b>"), "malformed"), "no owner": (document(owner=""), "no reportingOwner"),
    "line date": (document(date="soon"), "bad date"), "period": (document(period="13/2024"), "bad date"), "original": (document(tail="<dateOfOriginalSubmission>x</dateOfOriginalSubmission>"), "bad date"),
}


def test_documents_are_parsed_apart_from_each_other(spark):
    raw = spark.createDataFrame([(name, xml) for name, (xml, _) in CASES.items()], "accession string, xml string")
    lines, faults = filings.ownership_tables(raw)
    assert {r.accession: r.fault for r in faults.collect()} == {name: fault for name, (_, fault) in CASES.items() if fault}
    assert sorted((r.accession, str(r.trade_date), r.filer_cik) for r in lines.collect()) == [(name, "2024-01-02", "7") for name in ("bare", "good", "time zone")]
    assert [x.count() for x in filings.ownership_tables(raw.limit(0))] == [0, 0]


def entry(n, form="4", cik="00123", updated="2024-01-02T10:00:00-05:00", by="id"):
    accession = f"0000000001-24-{n:06d}"
    return f'<entry><category term="{form}"/><id>{accession if by == "id" else "x"}</id><link href="https://x/data/{cik}/{accession if by == "link" else ""}-index.htm"/><updated>{updated}</updated></entry>'


def page(*entries):
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{"".join(entries)}</feed>'


def test_feed_entries_take_the_first_by_page_and_position(spark, tmp_path):
    (tmp_path / "p2.xml").write_text(page(entry(1, cik="5"), entry(2, by="link")))
    (tmp_path / "p1.xml").write_text(page(entry(3, "8-K"), entry(1, updated="2024-01-09T10:00:00Z"), entry(1, cik="6"), entry(4, updated="soon"), entry(5, by="")))
    got = sorted((r.accession[-1], r.cik, str(r.accepted_at)) for r in filings.feed_entries(spark, str(tmp_path)).collect())
    assert got == [("1", "123", "2024-01-09 10:00:00"), ("2", "123", "2024-01-02 15:00:00")]
    assert [r.fault for r in spark.createDataFrame(feeds.entries("p", b"<feed><entry>"), feeds.SCHEMA).collect()] == ["malformed page"] and feeds.entries("p", b"<feed/>") == []


def test_polls_go_on_where_the_last_one_ended(spark, tmp_path):
    feed, tables, state = tmp_path / "feed", str(tmp_path / "tables"), str(tmp_path / "state")
    feed.mkdir()
    xml = {1: document(), 2: document(owner=""), 3: document(), 4: document()[:-30]}
    docs = lambda *ns: spark.createDataFrame([(f"0000000001-24-{n:06d}", xml[n]) for n in ns], "accession string, xml string")
    rows = lambda name: sorted((r.accession and r.accession[-1], r.batch) for r in spark.read.parquet(f"{tables}/{name}").collect())
    faults = lambda: sorted((r.accession and r.accession[-1] or "", r.fault) for r in spark.read.parquet(f"{tables}/rejects").collect())
    (feed / "p1.xml").write_text(page(entry(1), entry(1, cik="9"), entry(2), entry(3), entry(4), entry(8, "10-K")))
    (feed / "p2.xml").write_text("<feed><entry>")
    poll.poll(spark, str(feed), docs(1, 2, 4), tables, state)
    assert rows("filings") == rows("lines") == [("1", 0)]  # one bad page and three bad documents cost nothing else
    assert faults() == [("", "malformed page"), ("2", "no reportingOwner"), ("3", "no document"), ("4", "malformed")]
    poll.poll(spark, str(feed), docs(1, 3), tables, state)
    assert rows("filings") == [("1", 0)]  # no new page, nothing read again
    (feed / "p3.xml").write_text(page(entry(1), entry(3, "4/A")))
    poll.poll(spark, str(feed), docs(1, 3), tables, state)
    assert rows("filings") == rows("lines") == [("1", 0), ("3", 1)] and len(faults()) == 4
    first = spark.read.parquet(f"{tables}/filings").filter("batch = 0").first()
    assert (first.cik, first.page, first.position, first.accepted_at) == ("123", "p1.xml", 0, datetime(2024, 1, 2, 15))


@pytest.mark.parametrize("path", ["file:/tmp/x", "file:///tmp/x", "/tmp/x"])
def test_paths_in_all_forms(path):
    assert zipped.opened(path)[1] == "/tmp/x"
