"""Parsers of public filings held as text columns: quarterly earnings, announcement dates, insider forms, factor files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACT = "array<struct<start:string,end:string,val:double,fy:int,fp:string,form:string,filed:string>>"


def eps_facts(docs: DataFrame) -> DataFrame:
    """``docs(symbol, json)`` of company facts to ``symbol, fy, fp, eps, filed``: diluted earnings by quarter.

    The earliest filing of a period wins; quarters span 80 to 100 days. The fourth is the year (350 days or more) less
    the first three.
    """
    path = "facts struct<`us-gaap`:struct<EarningsPerShareDiluted:struct<units:struct<`USD/shares`:" + FACT + ">>>>"
    rows = docs.select("symbol", F.explode(F.from_json("json", path)["facts"]["us-gaap"]["EarningsPerShareDiluted"]["units"]["USD/shares"]).alias("f")).select("symbol", "f.*")
    rows = rows.withColumns({"start": F.to_date("start"), "end": F.to_date("end"), "filed": F.to_date("filed")}).withColumn("span", F.datediff("end", "start"))
    first = Window.partitionBy("symbol", "start", "end").orderBy("filed", "fy", "fp")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    quarters = rows.where("span between 80 and 100").withColumn("fp", F.when(F.col("fp").isin("Q1", "Q2", "Q3"), F.col("fp"))).where("fp is not null").select("symbol", "fy", "fp", F.col("val").alias("eps"), "filed")
    years = rows.where("span >= 350").select("symbol", "fy", F.col("val").alias("year"), F.col("filed").alias("year_filed"))
    three = quarters.groupBy("symbol", "fy").agg(F.sum("eps").alias("s"), F.countDistinct("fp").alias("k")).where("k = 3")
    fourth = years.join(three, ["symbol", "fy"]).select("symbol", "fy", F.lit("Q4").alias("fp"), (F.col("year") - F.col("s")).alias("eps"), F.col("year_filed").alias("filed"))
    return quarters.unionByName(fourth)


def announcements(docs: DataFrame) -> DataFrame:
    """``docs(symbol, json)`` of submissions to ``symbol, announce_date``: 8-K filings with item 2.02."""
    r = F.from_json("json", "filings struct<recent:struct<form:array<string>,filingDate:array<string>,items:array<string>>>")["filings"]["recent"]
    z = docs.select("symbol", F.explode(F.arrays_zip(r["form"].alias("form"), r["filingDate"].alias("day"), r["items"].alias("items"))).alias("x"))
    return z.where("x.form = '8-K' and array_contains(split(x.items, ','), '2.02')").select("symbol", F.to_date("x.day").alias("announce_date")).distinct()


FORM4 = (
    "issuer struct<issuerTradingSymbol:string>, reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string>>>, "
    "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,"
    "transactionAmounts:struct<transactionShares:struct<value:double>,transactionPricePerShare:struct<value:double>>>>>"
)


def insider_transactions(docs: DataFrame) -> DataFrame:
    """``docs(accession, xml)`` of ownership forms to a row per owner and non-derivative transaction, in file order."""
    x = docs.select("accession", F.from_xml("xml", FORM4).alias("f"))
    x = x.select("accession", F.upper(F.trim("f.issuer.issuerTradingSymbol")).alias("symbol"), F.col("f.nonDerivativeTable.nonDerivativeTransaction").alias("ts"), F.explode("f.reportingOwner").alias("o"))
    x = x.select("accession", "symbol", F.col("o.reportingOwnerId.rptOwnerCik").alias("owner_cik"), F.posexplode("ts").alias("seq", "t"))
    return x.select("accession", "symbol", "owner_cik", "seq", F.to_date("t.transactionDate.value").alias("transaction_date"), F.col("t.transactionCoding.transactionCode").alias("code"), F.col("t.transactionAmounts.transactionShares.value").alias("shares"), F.col("t.transactionAmounts.transactionPricePerShare.value").alias("price"))


def daily_factors(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of a factor file with preamble and trailer to dates and decimal returns.

    Data lines start with eight digits and a comma. Missing values (-99.99 and below) are null.
    """
    p = F.split("value", r"\s*,\s*")
    num = lambda i: F.when(F.get(p, i).try_cast("double") > -99, F.get(p, i).try_cast("double") / 100)
    return lines.where(F.col("value").rlike(r"^\s*\d{8}\s*,")).select(F.to_date(F.trim(p[0]), "yyyyMMdd").alias("date"), num(F.lit(1)).alias("mkt_rf"), num(F.lit(2)).alias("smb"), num(F.lit(3)).alias("hml"), num(F.lit(4)).alias("rf"))


def level_numbers(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``levels``: the set of numbers in a text that are no part of an address, a date, a percentage or a year."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"https?://\S+|\d{4}-\d{2}-\d{2}|\d+(?:\.\d+)?\s*%", " ")
    n = F.transform(F.regexp_extract_all(F.regexp_replace(t, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))
    return rows.withColumn("levels", F.array_sort(F.array_distinct(F.filter(n, lambda x: ~((x >= 1900) & (x <= 2100) & (x == F.floor(x)))))))


def similar_pairs(rows: DataFrame, least: float = 0.5, floor: int = 2) -> DataFrame:
    """Pairs of items (id, source, levels) of one source whose level sets overlap: shared over the smaller set's size.

    Items meet on a shared level, by an inverted index; pairs without one are never made.
    """
    post = rows.select("id", "source", F.size("levels").alias("n"), F.explode("levels").alias("level"))
    a, b = post.toDF("a", "source", "na", "level"), post.toDF("b", "source", "nb", "level")
    both = a.join(b, ["source", "level"]).where("a < b").groupBy("source", "a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    score = F.col("shared") / F.greatest(F.least("na", "nb"), F.lit(floor))
    return both.withColumn("score", score).where(F.col("score") >= least).select("source", "a", "b", "shared", "score")
