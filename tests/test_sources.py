import gzip
from datetime import date

from pyspark.sql import functions as F

from ledgerwind.functions.stored import shared_path
from ledgerwind.sources import feeds, filings, prices
from ledgerwind.streaming import ingest

QUARTER = {
    "SUBMISSION": ["ACCESSION_NUMBER\tFILING_DATE\tPERIOD_OF_REPORT\tDOCUMENT_TYPE\tISSUERCIK\tISSUERNAME\tISSUERTRADINGSYMBOL\tREMARKS\tAFF10B5ONE",
        'a-1\t03-JAN-2024\t02-JAN-2024\t4\t0000123\tA "Big" Co\tNYSE: abc\t\t0', "a-2\t2024-01-05\t02-JAN-2024\t4/A\t123\tA Co\tNONE\tunder a Rule 10b5-1 plan\t", "a-3\t04-JAN-2024\t\t3\t123\tA\tABC\t\t", "a-4\t\t\t4\t1\tA\tABC\t\t"],
    "REPORTINGOWNER": ["ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\tRPTOWNER_TITLE", "a-1\t0009\tDoe\tDirector,Officer\tCEO", "a-1\t0008\tFund\t10% Owner\t", "a-2\t9\tDoe\tTen Percent Owner\t", "a-3\t9\tDoe\t\t"],
    "NONDERIV_TRANS": ["ACCESSION_NUMBER\tNONDERIV_TRANS_SK\tTRANS_DATE\tTRANS_DATE_FN\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\tDIRECT_INDIRECT_OWNERSHIP\tNATURE_OF_OWNERSHIP",
        "a-1\t11\t02-JAN-2024\tF1\tS\t5\t2.5\tI\tBy trust", "a-1\t9\t02-JAN-2024\t\tP\t1,000\t1.25\tD\t", "a-1\t10\t02-JAN-2024\t\tF\t1\t1\tD\t", "a-2\t1\t02-JAN-2024\t\tP\tx\t1\tD\t", "a-2\t2\t\t\tP\t1\t1\tD\t"],
    "FOOTNOTES": ["ACCESSION_NUMBER\tFOOTNOTE_ID\tFOOTNOTE_TXT", "a-1\tF1\tSold under a 10b5-1 plan.", "a-2\tF1\tnothing"],
}
XML = """<?xml version="1.0"?><edgarSubmission><ownershipDocument><documentType>4</documentType><periodOfReport>2024-01-02</periodOfReport><aff10b5One>0</aff10b5One>
<issuer><issuerCik>0000123</issuerCik><issuerName>A</issuerName><issuerTradingSymbol>abc</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>0009</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer><officerTitle>Clerk</officerTitle></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value><footnoteId id="F1"/></transactionPricePerShare></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>30</value></sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><directOrIndirectOwnership><value>I</value></directOrIndirectOwnership><natureOfOwnership><value>By Spouse</value></natureOfOwnership></ownershipNature></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>A</transactionCode></transactionCoding></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2024-01-03-05:00</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares>7</transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>
<footnotes><footnote id="F1">A 10b5-1 plan.</footnote><footnote id="F2">other</footnote></footnotes></ownershipDocument></edgarSubmission>"""
FEED = """<?xml version="1.0"?><feed><entry><category term="4"/><id>urn:tag:x,2008:accession-number=0000000001-24-000001</id><link href="https://x/Archives/edgar/data/00123/000/0000000001-24-000001-index.htm"/><updated>2024-01-02T10:00:00-05:00</updated></entry>
<entry><category term="4"/><id>urn:accession-number=0000000001-24-000001</id><link href="https://x/Archives/edgar/data/77/y/0000000001-24-000001-index.htm"/><updated>2024-01-02T10:01:00-05:00</updated></entry>
<entry><category term="8-K"/><id>urn:accession-number=0000000001-24-000002</id><link href="https://x/edgar/data/5/z"/><updated>2024-01-02T10:00:00-05:00</updated></entry><entry><category term="4/A"/><id>none</id><link href="https://x"/><updated>2024-01-02T10:00:00-05:00</updated></entry></feed>"""


def test_quarter_of_tables(spark, tmp_path):
    for name, lines in QUARTER.items():
        (tmp_path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    forms, lines = filings.quarter(spark, str(tmp_path))
    got = {r.accession: r for r in forms.collect()}
    assert set(got) == {"a-1", "a-2"}
    assert (got["a-1"].role, got["a-1"].filer_cik, got["a-1"].owner_ciks, got["a-1"].ticker, got["a-1"].issuer_name) == ("CEO", "9", ["8", "9"], "ABC", 'A "Big" Co')
    assert (got["a-2"].role, got["a-2"].ticker, got["a-2"].filed_on) == ("10% owner", None, date(2024, 1, 5))
    rows = sorted((r.accession, r.line_no, r.side, r.shares and float(r.shares), r.owner, r.is_10b5_1) for r in lines.collect())
    assert rows == [("a-1", 0, "buy", 1000.0, "self", False), ("a-1", 2, "sell", 5.0, "trust", True), ("a-2", 0, "buy", None, "self", True)]


def test_ownership_document(spark, tmp_path):
    (tmp_path / "a-9.xml").write_text(XML)
    rows = sorted((r.line_no, r.side, r.trade_date, float(r.shares), r.owner, r.is_10b5_1, r.role, r.filer_cik, r.ticker, r.accession) for r in filings.ownership_documents(spark, str(tmp_path)).collect())
    assert rows == [(0, "buy", date(2024, 1, 2), 10.0, "spouse", True, "officer", "9", "ABC", "a-9"), (2, "sell", date(2024, 1, 3), 7.0, "self", False, "officer", "9", "ABC", "a-9")]


def test_feed_and_tickers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = filings.feed_entries(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r.accession, r.form, r.cik, str(r.accepted_at)) for r in rows] == [("0000000001-24-000001", "4", "123", "2024-01-02 15:00:00")]
    (tmp_path / "t.json").write_text('{"0": {"cik_str": 320193, "ticker": "aapl"}, "1": {"cik_str": 5, "ticker": "x"}, "2": {"cik_str": 5, "ticker": "y"}}')
    assert {r.cik: r.ticker for r in filings.company_tickers(spark, str(tmp_path / "t.json")).collect()} == {"320193": "AAPL", "5": "X"}


def test_bars_of_files_and_charts(spark, tmp_path):
    with gzip.open(tmp_path / "BRK_B.csv.gz", "wt") as f:
        f.write("date,open,high,low,close,volume,adjClose\n2024-01-02,10,1,1,20,5,18\n2024-01-03,nan,1,1,,,\nbad,1,1,1,1,1,1\n")
    rows = sorted(tuple(r) for r in prices.open_bars(spark, f"dir:{tmp_path}").collect())
    assert rows == [("BRK_B", date(2024, 1, 2), 10.0, 20.0, 9.0, 18.0, 5.0), ("BRK_B", date(2024, 1, 3), None, None, None, None, None)]
    day = 86_400
    chart = [("T", [1704205800, 1704205800 + day, 1704205801 + day], [10.0, 6.0, 7.0], [10.0, 6.0, 7.0], [100.0, 200.0, 300.0], [5.0, 6.0, 7.0], [(1704205800 + day, 2.0)])]
    got = sorted(tuple(r) for r in prices.chart_bars(spark.createDataFrame(chart, prices.CHART)).collect())
    assert got == [("T", date(2024, 1, 2), 20.0, 20.0, 5.0, 5.0, 50.0), ("T", date(2024, 1, 3), 7.0, 7.0, 7.0, 7.0, 300.0)]
    prices.write_csv(spark.createDataFrame(got, "ticker string, date date, open double, close double, adj_open double, adj_close double, volume double"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_stream_ingest_replays_change_nothing(spark, tmp_path):
    source, schema = str(tmp_path / "in"), spark.createDataFrame([], "k long, v string").schema
    table, state, linked = shared_path(spark, "t"), shared_path(spark, "s"), []
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.ingest(ingest.file_stream(spark, source, schema, "*.parquet"), table, ["k"], state, lambda t: linked.append(t.count()))
    write([(1, "a"), (2, "b"), (2, "b")])
    run()
    write([(2, "late"), (3, "c")])
    run()
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(table).select("k", "v").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert linked == [2, 3]


def test_streams_of_first_rows_and_rates(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k long, ts timestamp"
    spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 00:50:00")], "k long, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(source)
    stream = lambda: ingest.file_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet")
    ingest.run_to_table(ingest.first_per_key(stream(), "k", "ts", "2 hours"), str(tmp_path / "a"), str(tmp_path / "sa"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [1, 2]
    ingest.run_to_table(ingest.rate_windows(stream(), "ts", "k", "1 hour", "30 minutes", "1 hour"), str(tmp_path / "b"), str(tmp_path / "sb"), "complete")
    assert sum(r.n for r in spark.read.parquet(str(tmp_path / "b")).collect()) == 6


def test_many_pages_are_few_tasks_and_keep_their_order():
    paths = [f"p{i:06d}" for i in range(20_000)]
    few, many = feeds.dealt(paths[:5]), feeds.dealt(paths)
    assert [p.paths for p in few] == [[p] for p in paths[:5]] and feeds.dealt([]) == []
    assert len(many) == 313 and [x for p in many for x in p.paths] == paths
