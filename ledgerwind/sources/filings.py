"""Readers of filings: quarterly tab-separated tables, ownership documents in XML, and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerwind.functions import text
from ledgerwind.functions.stored import stored
from ledgerwind.sources import zipped
from ledgerwind.sources.feeds import FeedPages

CODES = {"P": "buy", "S": "sell"}
#: The columns of each quarterly table that are read, all as text.
TABLES = {
    "SUBMISSION": ["ACCESSION_NUMBER", "FILING_DATE", "PERIOD_OF_REPORT", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME", "ISSUERTRADINGSYMBOL", "REMARKS", "AFF10B5ONE", "DATE_OF_ORIG_SUB"],
    "REPORTINGOWNER": ["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP", "RPTOWNER_TITLE"],
    "NONDERIV_TRANS": ["ACCESSION_NUMBER", "NONDERIV_TRANS_SK", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "DIRECT_INDIRECT_OWNERSHIP", "NATURE_OF_OWNERSHIP", "SHRS_OWND_FOLWNG_TRANS"],
    "FOOTNOTES": ["ACCESSION_NUMBER", "FOOTNOTE_ID", "FOOTNOTE_TXT"],
}


def unpack(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of quarters as they are published, ZIP files; the lines' table also has CITED, the footnotes that a line cites."""
    return zipped.table(spark, path, name, [*TABLES[name], *([zipped.CITED] if name == "NONDERIV_TRANS" else [])])


def read_tsv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of an unpacked quarter, or of ZIP files: quotes are text; columns that a file lacks are null."""
    if folder.endswith(".zip"):
        return unpack(spark, folder, name)
    df = spark.read.csv(f"{folder}/{name}.tsv", sep="\t", quote="", header=True, encoding="UTF-8")
    return df.withColumns({c: F.lit(None).cast("string") for c in TABLES[name] if c not in df.columns})


def quarter(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(filings, lines) of a quarter's tables: forms 4 and 4/A with a date and an owner; bought and sold lines with a date.

    folder is an unpacked quarter, or a path or pattern of ZIP files. Line numbers count all lines of a filing in the order of
    their keys, so they keep gaps where lines are left out.
    """
    forms = read_tsv(spark, folder, "SUBMISSION").filter(F.col("DOCUMENT_TYPE").isin("4", "4/A"))
    forms = forms.withColumn("filed_on", text.sec_date(F.col("FILING_DATE"))).filter("filed_on is not null")
    raw = read_tsv(spark, folder, "REPORTINGOWNER")  # those of other forms go as filings are joined, so no table is read twice
    told = F.replace(F.replace(F.lower(F.coalesce("RPTOWNER_RELATIONSHIP", F.lit(""))), F.lit(" "), F.lit("")), F.lit("%"), F.lit("percent"))
    told = F.replace(told, F.lit("10percent"), F.lit("tenpercent"))
    role = text.classify_role(F.nullif(F.trim("RPTOWNER_TITLE"), F.lit("")), told.contains("officer"), told.contains("director"), told.contains("tenpercent"))
    people = raw.select("ACCESSION_NUMBER", F.coalesce(text.clean_cik(F.col("RPTOWNERCIK")), F.lit("")).alias("cik"), F.col("RPTOWNERNAME").alias("name"), role.alias("role"))
    owners = people.groupBy("ACCESSION_NUMBER").agg(F.collect_list(F.struct("cik", "name", "role")).alias("_people"))
    owners = owners.select("ACCESSION_NUMBER", text.primary_owner(F.col("_people")).alias("_owner"), text.owner_ciks(F.array_distinct("_people.cik")).alias("owner_ciks"))
    owners = owners.select("ACCESSION_NUMBER", "_owner.cik", "_owner.name", "_owner.role", "owner_ciks")
    plan = text.truthy(F.col("AFF10B5ONE")) | text.mentions_plan(F.col("REMARKS"))
    filings = forms.join(owners, "ACCESSION_NUMBER").select(
        F.col("ACCESSION_NUMBER").alias("accession"), F.col("DOCUMENT_TYPE").alias("document_type"), "filed_on", text.sec_date(F.col("PERIOD_OF_REPORT")).alias("period"),
        text.sec_date(F.col("DATE_OF_ORIG_SUB")).alias("original_filed_on"), text.clean_cik(F.col("ISSUERCIK")).alias("issuer_cik"), F.col("ISSUERNAME").alias("issuer_name"),
        text.clean_ticker(F.col("ISSUERTRADINGSYMBOL")).alias("ticker"), F.col("cik").alias("filer_cik"), F.col("name").alias("filer_name"), "role", "owner_ciks", plan.alias("plan"),
    )
    lines = read_tsv(spark, folder, "NONDERIV_TRANS")
    order = Window.partitionBy("ACCESSION_NUMBER").orderBy(F.col("NONDERIV_TRANS_SK").try_cast("long"), "NONDERIV_TRANS_SK")
    lines = lines.withColumn("line_no", F.row_number().over(order) - 1).withColumn("trade_date", text.sec_date(F.col("TRANS_DATE")))
    lines = lines.filter(F.col("TRANS_CODE").isin(*CODES) & F.col("trade_date").isNotNull())
    marks = [c for c in lines.columns if c.endswith("_FN") or c == zipped.CITED]
    notes = read_tsv(spark, folder, "FOOTNOTES").filter(text.mentions_plan(F.col("FOOTNOTE_TXT"))).select("ACCESSION_NUMBER", F.trim("FOOTNOTE_ID").alias("note"))
    plans = notes.groupBy("ACCESSION_NUMBER").agg(F.collect_set("note").alias("_notes"))  # a filing's, so that lines meet them where they are
    cited = F.transform(F.split(F.concat_ws(",", *marks) if marks else F.lit(""), ","), lambda note: F.trim(note))
    noted = F.coalesce(F.arrays_overlap(cited, "_notes"), F.lit(False))
    lines = lines.join(plans, "ACCESSION_NUMBER", "left").select(
        F.col("ACCESSION_NUMBER").alias("accession"), "line_no", F.when(F.col("TRANS_CODE") == "P", "buy").otherwise("sell").alias("side"), "trade_date",
        text.number(F.col("TRANS_SHARES")).alias("shares"), text.number(F.col("TRANS_PRICEPERSHARE")).alias("price"), text.number(F.col("SHRS_OWND_FOLWNG_TRANS")).alias("owned_after"),
        text.owner_from_nature(F.col("DIRECT_INDIRECT_OWNERSHIP"), F.col("NATURE_OF_OWNERSHIP")).alias("owner"), noted.alias("noted"),
    )
    lines = lines.join(filings.select("accession", "plan", "ticker", "role"), "accession").withColumn("is_10b5_1", F.col("plan") | F.col("noted")).drop("plan", "noted")
    return filings.drop("plan"), lines


_LEAF = T.StructType([T.StructField("value", T.StringType()), T.StructField("_VALUE", T.StringType()), T.StructField("footnoteId", T.ArrayType(T.StructType([T.StructField("_id", T.StringType()), T.StructField("_VALUE", T.StringType())])))])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_LINE = _struct(
    transactionDate=_LEAF, transactionCoding=_struct(transactionCode=T.StringType(), footnoteId=_LEAF["footnoteId"].dataType),
    transactionAmounts=_struct(transactionShares=_LEAF, transactionPricePerShare=_LEAF), postTransactionAmounts=_struct(sharesOwnedFollowingTransaction=_LEAF),
    ownershipNature=_struct(directOrIndirectOwnership=_LEAF, natureOfOwnership=_LEAF),
)
_OWNER = _struct(
    reportingOwnerId=_struct(rptOwnerCik=T.StringType(), rptOwnerName=T.StringType()),
    reportingOwnerRelationship=_struct(isDirector=_LEAF, isOfficer=_LEAF, isTenPercentOwner=_LEAF, officerTitle=_LEAF),
)
DOCUMENT = _struct(
    documentType=T.StringType(), periodOfReport=T.StringType(), dateOfOriginalSubmission=T.StringType(), aff10b5One=_LEAF, remarks=T.StringType(),
    issuer=_struct(issuerCik=T.StringType(), issuerName=T.StringType(), issuerTradingSymbol=T.StringType()),
    reportingOwner=T.ArrayType(_OWNER), nonDerivativeTable=_struct(nonDerivativeTransaction=T.ArrayType(_LINE)),
    footnotes=_struct(footnote=T.ArrayType(_struct(_id=T.StringType(), _VALUE=T.StringType()))), _unread=T.StringType(),
)


def leaf(column: str) -> F.Column:
    """A leaf that is wrapped in <value> or bare."""
    return F.coalesce(F.col(f"{column}.value"), F.col(f"{column}._VALUE"))


def _leaf(owner: F.Column, name: str) -> F.Column:
    """leaf() of an owner's relationship."""
    return F.coalesce(owner["reportingOwnerRelationship"][name]["value"], owner["reportingOwnerRelationship"][name]["_VALUE"])


def _day(raw: F.Column) -> F.Column:
    """The date in the first ten characters; null if there is none."""
    return F.try_to_date(F.substring(F.trim(raw), 1, 10), "yyyy-MM-dd")


def _bad_day(raw: F.Column) -> F.Column:
    """Whether a date is stated that is none."""
    return F.coalesce((F.trim(raw) != "") & _day(raw).isNull(), F.lit(False))


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """(accession, xml) of files; the file's name stands for the accession number."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.xml)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("accession"), F.col("value").alias("xml"))


def parsed_documents(raw: DataFrame) -> DataFrame:
    """raw's columns without xml, doc, and fault: why no lines can be taken from it, null where they can.

    Each text is read once: what stands between the first and the last ownershipDocument tag, wherever that is. Faults are
    "no document" (a null text), "malformed", "no ownershipDocument", "no reportingOwner" and "bad date", of the period, the original or a bought or
    sold line.
    """
    body = F.regexp_extract("xml", r"(?s)<ownershipDocument\b.*</ownershipDocument\s*>", 0)
    parsed = raw.withColumn("_body", body).withColumn("doc", F.from_xml(F.nullif("_body", F.lit("")), DOCUMENT, {"columnNameOfCorruptRecord": "_unread"}))
    kept = F.filter(F.coalesce("doc.nonDerivativeTable.nonDerivativeTransaction", F.array()), lambda t: t["transactionCoding"]["transactionCode"].isin(*CODES))
    stated = F.exists(kept, lambda t: _bad_day(F.coalesce(t["transactionDate"]["value"], t["transactionDate"]["_VALUE"])))
    fault = (
        F.when((F.col("_body") == "") & F.col("xml").rlike(r"<ownershipDocument\b"), "malformed")
        .when(F.col("xml").isNull(), "no document")
        .when(F.col("_body") == "", "no ownershipDocument")
        .when(F.col("doc._unread").isNotNull() | F.col("doc").isNull(), "malformed")
        .when(F.size(F.coalesce("doc.reportingOwner", F.array())) == 0, "no reportingOwner")
        .when(_bad_day(F.col("doc.periodOfReport")) | _bad_day(F.col("doc.dateOfOriginalSubmission")) | stated, "bad date")
    )
    return parsed.withColumn("fault", fault).drop("xml", "_body")


def document_lines(parsed: DataFrame) -> DataFrame:
    """Lines of parsed documents without a fault, in the form of quarter()'s lines, with filer, issuer and document columns.

    A footnote counts for the lines that cite it.
    """
    docs = parsed.filter("fault is null").select("accession", "doc.*")
    people = F.transform("reportingOwner", lambda o: F.struct(
        F.coalesce(text.clean_cik(o["reportingOwnerId"]["rptOwnerCik"]), F.lit("")).alias("cik"), o["reportingOwnerId"]["rptOwnerName"].alias("name"),
        text.classify_role(F.nullif(F.trim(_leaf(o, "officerTitle")), F.lit("")), *(text.truthy(_leaf(o, c)) for c in ("isOfficer", "isDirector", "isTenPercentOwner"))).alias("role"),
    ))
    docs = docs.withColumn("_owner", text.primary_owner(people))  # an owner a document, found where the document is
    noted = F.transform(F.filter(F.coalesce("footnotes.footnote", F.array()), lambda f: text.mentions_plan(f["_VALUE"])), lambda f: f["_id"])
    lines = docs.select("accession", "_owner", F.coalesce("documentType", F.lit("4")).alias("documentType"), _day(F.col("periodOfReport")).alias("period"), text.clean_cik(F.col("issuer.issuerCik")).alias("issuer_cik"), text.clean_ticker(F.col("issuer.issuerTradingSymbol")).alias("ticker"), (text.truthy(leaf("aff10b5One")) | text.mentions_plan(F.col("remarks"))).alias("plan"), noted.alias("noted"), F.posexplode("nonDerivativeTable.nonDerivativeTransaction").alias("line_no", "t"))
    cites = [f"t.{c}.footnoteId" for c in ("transactionDate", "transactionCoding", "transactionAmounts.transactionShares", "transactionAmounts.transactionPricePerShare", "postTransactionAmounts.sharesOwnedFollowingTransaction", "ownershipNature.directOrIndirectOwnership", "ownershipNature.natureOfOwnership")]
    cited = F.flatten(F.array(*(F.transform(F.coalesce(F.col(c), F.array()), lambda f: f["_id"]) for c in cites)))
    code = F.col("t.transactionCoding.transactionCode")
    rows = lines.withColumn("trade_date", _day(leaf("t.transactionDate"))).filter(code.isin(*CODES) & F.col("trade_date").isNotNull()).select(
        "accession", F.col("documentType").alias("document_type"), "period", "issuer_cik", "ticker", "line_no", F.when(code == "P", "buy").otherwise("sell").alias("side"),
        "trade_date", text.number(leaf("t.transactionAmounts.transactionShares")).alias("shares"),
        text.number(leaf("t.transactionAmounts.transactionPricePerShare")).alias("price"), text.number(leaf("t.postTransactionAmounts.sharesOwnedFollowingTransaction")).alias("owned_after"),
        text.owner_from_nature(leaf("t.ownershipNature.directOrIndirectOwnership"), leaf("t.ownershipNature.natureOfOwnership")).alias("owner"),
        (F.col("plan") | F.arrays_overlap(cited, "noted")).alias("is_10b5_1"), F.col("_owner.cik").alias("filer_cik"), F.col("_owner.name").alias("filer_name"), F.col("_owner.role").alias("role"),
    )
    return rows


def ownership_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, faults) of documents (accession, xml), which are read once for both."""
    parsed = stored(parsed_documents(raw), "documents")
    return document_lines(parsed), parsed.filter("fault is not null").select("accession", "fault")


def document_faults(raw: DataFrame) -> DataFrame:
    """(accession, fault) of the documents (accession, xml) that no lines can be taken from; no document is stored."""
    return stored(parsed_documents(raw).select("accession", "fault"), "faults").filter("fault is not null")  # stored, so that the filter does not read texts again


def ownership_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_lines() of a folder's files."""
    return document_lines(parsed_documents(raw_documents(spark, path)))


def faulty_documents(spark: SparkSession, path: str) -> DataFrame:
    """(accession, fault) of files that no lines can be taken from."""
    return parsed_documents(raw_documents(spark, path)).filter("fault is not null").select("accession", "fault")


FORMS = ("4", "4/A")


def first_entries(rows: DataFrame) -> DataFrame:
    """One entry a filing of FORMS without a fault: the first by page and position."""
    known = rows.filter(F.col("fault").isNull() & F.col("form").isin(*FORMS))
    rest = [c for c in rows.columns if c not in ("accession", "fault")]
    return known.groupBy("accession").agg(F.min_by(F.struct(*rest), F.struct("page", "position")).alias("e")).select("accession", "e.*")


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(accession, form, accepted_at, url, cik) of Atom pages, a folder or one; forms 4 and 4/A with both numbers, the first entry of each by page and position."""
    spark.dataSource.register(FeedPages)
    rows = spark.read.format("feed_pages").option("path", path).load()
    return first_entries(rows).select("accession", "form", "accepted_at", "url", "cik")


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(cik, ticker) of an object of rows {cik_str, ticker}; of several tickers the first row's, in capitals."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<cik_str:string,ticker:string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("at", "row")).select(F.col("at").try_cast("int").alias("at"), text.clean_cik(F.col("row.cik_str")).alias("cik"), F.upper("row.ticker").alias("ticker"))
    return rows.groupBy("cik").agg(F.min_by("ticker", "at").alias("ticker"))
