"""Files in the readers' formats, written from the given tables: quarters as ZIP files, ownership documents, feed pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwind.functions.stored import shared_path, stored
from ledgerwind.operators import ranking
from ledgerwind.plans.adapter import LINE, table
from ledgerwind.sources.zipped import opened

#: Filings of an archive, about.
ARCHIVE = 50_000
_DAY = "CASE o_orderstatus WHEN 'F' THEN upper(date_format({0}, 'dd-MMM-yyyy')) WHEN 'O' THEN date_format({0}, 'yyyy-MM-dd') ELSE lower(date_format({0}, 'dd-MMM-yyyy')) END"
#: Each member's fields as expressions over orders, customers and lines.
MEMBERS = {
    "SUBMISSION": {
        "ACCESSION_NUMBER": "accession", "FILING_DATE": f"CASE WHEN o_totalprice >= 5000 THEN {_DAY.format('filed')} ELSE '' END", "PERIOD_OF_REPORT": _DAY.format("date_sub(filed, 2)"), "DATE_OF_ORIG_SUB": f"CASE WHEN form = '4/A' THEN {_DAY.format('date_sub(filed, 10)')} ELSE '' END",
        "DOCUMENT_TYPE": "form", "ISSUERCIK": "lpad(issuer, 10, '0')", "ISSUERNAME": "concat('Issuer \"', issuer, '\"')", "ISSUERTRADINGSYMBOL": "element_at(array(concat('NYSE: s', issuer), concat('[S', issuer, ']'), concat('S', issuer, ', S9'), 'N/A', concat('s', issuer, ' ')), CAST(issuer % 5 + 1 AS INT))",
        "REMARKS": "CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'Under a Rule 10B5-1 plan' ELSE 'none' END", "AFF10B5ONE": "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN ' True ' ELSE '0' END",
    },
    "NONDERIV_TRANS": {
        "ACCESSION_NUMBER": "accession", "NONDERIV_TRANS_SK": "place + 7", "TRANS_DATE": _DAY.format("CAST(l_shipdate AS DATE)"), "TRANS_DATE_FN": "CASE WHEN l_discount >= 0.09 THEN 'F1' ELSE '' END", "TRANS_CODE": "CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'P' ELSE CASE WHEN l_discount < 0.05 THEN 'P' ELSE 'F' END END",
        "TRANS_SHARES": "CAST(l_quantity AS DECIMAL(12,2))", "TRANS_SHARES_FN": "CASE WHEN l_discount <= 0.01 THEN 'F2, F3' ELSE '' END", "TRANS_PRICEPERSHARE": "CASE WHEN l_tax > 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) ELSE '' END", "SHRS_OWND_FOLWNG_TRANS": "CAST(3 * l_quantity AS DECIMAL(12,2))",
        "DIRECT_INDIRECT_OWNERSHIP": "CASE l_linestatus WHEN 'F' THEN 'D' ELSE 'I' END", "NATURE_OF_OWNERSHIP": "CASE WHEN l_tax < 0.02 THEN 'By Wife' WHEN l_tax < 0.04 THEN 'by daughter' WHEN l_tax < 0.06 THEN 'By Family Trust' ELSE 'LLC' END",
    },
    "REPORTINGOWNER": {"ACCESSION_NUMBER": "accession", "RPTOWNERCIK": "lpad(o_custkey + second, 10, '0')", "RPTOWNERNAME": "CASE second WHEN 0 THEN c_name ELSE 'Fund' END", "RPTOWNER_RELATIONSHIP": "CASE WHEN second = 1 THEN '10% Owner' ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Director,Officer' WHEN 'BUILDING' THEN 'Officer' WHEN 'FURNITURE' THEN 'Officer,Ten Percent Owner' WHEN 'HOUSEHOLD' THEN 'Director' ELSE '10 % Owner' END END",
        "RPTOWNER_TITLE": "CASE WHEN second = 1 THEN '' ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Chief Executive Officer' WHEN 'BUILDING' THEN 'EVP & CFO' WHEN 'FURNITURE' THEN 'Treasurer' ELSE '' END END"},
    "FOOTNOTES": {"ACCESSION_NUMBER": "accession", "FOOTNOTE_ID": "note", "FOOTNOTE_TXT": "CASE WHEN note = 'F1' AND o_orderstatus = 'F' THEN 'Made under a Rule 10b51 plan.' WHEN note = 'F3' AND o_orderstatus = 'O' THEN 'See the 10b5-1 plan' ELSE '\"Weighted average' END"},
}


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as filings: accession, filed, form, issuer, quarter and the order's own columns."""
    issuers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("issuer"))
    kind = "CASE o_orderpriority WHEN '1-URGENT' THEN '4/A' WHEN '5-LOW' THEN '3' ELSE '4' END"
    rows = table(spark, sf_dir, "orders").join(issuers, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").withColumn("filed", F.col("o_orderdate").cast("date"))
    return rows.selectExpr("*", f"{kind} AS form", "concat(lpad(o_orderkey, 10, '0'), '-', date_format(filed, 'yy'), '-', lpad(o_custkey, 6, '0')) AS accession", "concat(year(filed), 'q', quarter(filed)) AS quarter")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with place, from 1, in the order of the whole line."""
    return table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE[1:])))


def _archives(folder: str):
    """Writes lines (file, member, line), sorted by file and member, into ZIP files; an archive is moved to its name when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        state: dict = {}

        def close(member_only: bool = False) -> None:
            if "member" in state:
                state.pop("member").close()
            if not member_only and "archive" in state:
                state.pop("archive").close()
                state.pop("stream").close()
                system.move(f"{root}/.{state['file']}", f"{root}/{state['file']}")

        for batch in batches:
            for file, member, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state.get("file") != file:
                    close()
                    state |= {"file": file, "stream": system.open_output_stream(f"{root}/.{file}")}
                    state["archive"] = zipfile.ZipFile(io.BufferedWriter(state["stream"]), "w", zipfile.ZIP_DEFLATED)
                    state["name"] = None
                if state["name"] != member:
                    close(member_only=True)
                    state |= {"name": member, "member": state["archive"].open(f"data/{member.lower()}.tsv", "w", force_zip64=True)}
                    state["member"].write(("\t".join(MEMBERS[member]) + "\n").encode())
                state["member"].write((line + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        close()

    return run


def zipped_quarters(spark: SparkSession, sf_dir: str) -> str:
    """A folder of ZIP files, some a quarter, each with the four tables of about ARCHIVE filings."""
    filed = stored(forms(spark, sf_dir), "forms")
    people = table(spark, sf_dir, "customer").filter("c_acctbal >= -900").select("c_custkey", "c_name", "c_mktsegment")
    bucket = F.pmod(F.xxhash64("accession"), F.lit(filed.count() // ARCHIVE // 28 + 1))
    sources = {
        "SUBMISSION": filed,
        "REPORTINGOWNER": filed.join(people, F.col("o_custkey") == F.col("c_custkey")).withColumn("second", F.explode(F.array(F.lit(1), F.lit(0)))),
        "NONDERIV_TRANS": filed.join(lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey")),
        "FOOTNOTES": filed.withColumn("note", F.explode(F.array(*map(F.lit, ("F1", "F2", "F3"))))),
    }
    parts = [df.select(F.concat_ws("-", "quarter", bucket.cast("string")).alias("file"), F.lit(name).alias("member"), F.concat_ws("\t", *(F.expr(e).cast("string") for e in MEMBERS[name].values())).alias("line")) for name, df in sources.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).withColumn("file", F.concat("file", F.lit(".zip")))
    folder = shared_path(spark, "quarters")
    rows.repartition("file").sortWithinPartitions("file", "member").mapInArrow(_archives(folder), "n long").agg(F.sum("n")).collect()
    return folder


_ISO = "date_format({0}, 'yyyy-MM-dd')"
_XML_LINE = f"""concat('<nonDerivativeTransaction><transactionDate><value>', {_ISO.format('CAST(l_shipdate AS DATE)')}, CASE WHEN l_linestatus = 'F' THEN '-05:00' ELSE '' END, '</value></transactionDate><transactionCoding><transactionCode>',
    CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'P' ELSE CASE WHEN l_discount < 0.05 THEN 'P' ELSE 'F' END END, '</transactionCode>', CASE WHEN l_discount <= 0.01 THEN '<footnoteId id="F3"/>' ELSE '' END, '</transactionCoding><transactionAmounts><transactionShares>',
    CASE WHEN l_linestatus = 'F' THEN concat('<value>', CAST(l_quantity AS DECIMAL(12,2)), '</value>') ELSE CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING) END, '</transactionShares>', CASE WHEN l_tax > 0 THEN concat('<transactionPricePerShare><value>', CAST(l_extendedprice AS DECIMAL(14,2)), '</value>', CASE WHEN l_discount >= 0.09 THEN '<footnoteId id="F1"/>' ELSE '' END, '</transactionPricePerShare>') ELSE '' END,
    '</transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>', CAST(3 * l_quantity AS DECIMAL(12,2)), '</value></sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><directOrIndirectOwnership><value>', CASE l_linestatus WHEN 'F' THEN 'D' ELSE 'I' END,
    '</value></directOrIndirectOwnership><natureOfOwnership><value>', {MEMBERS['NONDERIV_TRANS']['NATURE_OF_OWNERSHIP']}, '</value></natureOfOwnership></ownershipNature></nonDerivativeTransaction>')"""
_XML_OWNER = """concat('<reportingOwner><reportingOwnerId><rptOwnerCik>', lpad(o_custkey, 10, '0'), '</rptOwnerCik><rptOwnerName>', c_name, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>',
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '<isOfficer><value>1</value></isOfficer><officerTitle><value>Chief Executive Officer</value></officerTitle>' WHEN 'BUILDING' THEN '<isOfficer>true</isOfficer><officerTitle>EVP &amp; CFO</officerTitle>' WHEN 'FURNITURE' THEN '<isOfficer>1</isOfficer><isTenPercentOwner>1</isTenPercentOwner>' WHEN 'HOUSEHOLD' THEN '<isDirector>Y</isDirector><isOfficer>0</isOfficer>' ELSE '<isTenPercentOwner>true</isTenPercentOwner>' END,
    '</reportingOwnerRelationship></reportingOwner>')"""
_XML = f"""CASE WHEN form = '3' THEN '<?xml version="1.0"?><edgarSubmission><other/></edgarSubmission>' ELSE concat('<?xml version="1.0"?><edgarSubmission><ownershipDocument><documentType>', form, '</documentType><periodOfReport>', CASE WHEN o_totalprice > 490000 THEN 'soon' ELSE {_ISO.format('date_sub(filed, 2)')} END, '</periodOfReport>',
    '<issuer><issuerCik>', lpad(issuer, 10, '0'), '</issuerCik><issuerName>Issuer</issuerName><issuerTradingSymbol>', {MEMBERS['SUBMISSION']['ISSUERTRADINGSYMBOL']}, '</issuerTradingSymbol></issuer>', CASE WHEN c_acctbal >= -900 THEN {_XML_OWNER} ELSE '' END, '<aff10b5One>', {MEMBERS['SUBMISSION']['AFF10B5ONE']}, '</aff10b5One><nonDerivativeTable>', array_join(array_sort(body).xml, ''), '</nonDerivativeTable>',
    '<footnotes><footnote id="F1">', CASE o_orderstatus WHEN 'F' THEN 'Made under a Rule 10b51 plan.' ELSE 'x' END, '</footnote><footnote id="F3">', CASE o_orderstatus WHEN 'O' THEN 'See the 10b5-1 plan' ELSE 'x' END, '</footnote></footnotes><remarks>', {MEMBERS['SUBMISSION']['REMARKS']}, '</remarks>', CASE WHEN o_totalprice < 5000 THEN '<cut' ELSE '' END, '</ownershipDocument></edgarSubmission>') END"""


def ownership_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, xml) for each order, some without a document or owner, cut short, or with a period that is no date."""
    body = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct("place", F.expr(_XML_LINE).alias("xml"))).alias("body"))  # an order's lines
    rows = forms(spark, sf_dir).join(body, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("accession", F.expr(_XML).alias("xml"))


#: Entries of a feed page; each filing has two, for its issuer and its owner.
ENTRIES = 1000
_ENTRY = """concat('<entry><category term="', CASE WHEN form = '3' THEN '8-K' ELSE form END, '"/><id>urn:tag:x,2008:', CASE WHEN party = 0 THEN concat('accession-number=', accession) ELSE 'x' END, '</id><link href="https://x/Archives/edgar/data/', CASE party WHEN 0 THEN lpad(issuer, 10, '0') ELSE o_custkey END, '/', accession, '-index.htm"/><updated>',
    date_format(filed, 'yyyy-MM-dd'), 'T10:00:00-05:00</updated></entry>')"""


def _pages(folder: str):
    """Writes lines (file, line), sorted by file, as feed pages; a page is moved to its name when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        name, held = None, []

        def close() -> None:
            if name is not None:
                with system.open_output_stream(f"{root}/.{name}") as out:
                    out.write(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{"".join(held)}</feed>'.encode())
                system.move(f"{root}/.{name}", f"{root}/{name}")

        for batch in batches:
            for file, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    close()
                    name, held = file, []
                held.append(line)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        close()

    return run


def feed_pages(spark: SparkSession, sf_dir: str, folder: str, late: bool) -> None:
    """Pages of about ENTRIES entries each under a folder: those of filings before 1998, or the later ones."""
    rows = forms(spark, sf_dir).filter(F.col("filed") >= "1998-01-01" if late else F.col("filed") < "1998-01-01").withColumn("party", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = ranking.numbered(rows.select("accession", "party", F.expr(_ENTRY).alias("line")), [], [F.col("accession"), F.col("party")], "n")
    file = F.format_string(f"page-{int(late)}-%08d.xml", F.floor((F.col("n") - 1) / ENTRIES))
    rows.select(file.alias("file"), "line", "n").repartition("file").sortWithinPartitions("file", "n").select("file", "line").mapInArrow(_pages(folder), "n long").agg(F.sum("n")).collect()
