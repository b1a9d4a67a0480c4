"""The submissions feed: JSON of parallel arrays, one row a filing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import padded_cik

FIELDS = "accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>,size:array<bigint>"
RECENT = f"struct<filings:struct<recent:struct<{FIELDS}>,files:array<struct<name:string>>>>"
OVERFLOW = f"struct<{FIELDS}>"


def _rows(feed: DataFrame, block: str) -> DataFrame:
    names = [f.split(":")[0] for f in FIELDS.split(",")]
    # A column that the feed lacks is one of nulls, as long as the accessions.
    n = F.size(F.col(f"{block}.accessionNumber"))
    kinds = {"size": "array<bigint>"}
    arrays = [F.coalesce(F.col(f"{block}.{x}"), F.array_repeat(F.lit(None), n).cast(kinds.get(x, "array<string>"))).alias(x) for x in names]
    rows = feed.select("cik", "page", *arrays).select("cik", "page", F.posexplode(F.arrays_zip(*names)).alias("nth", "f"))
    text = lambda x: F.nullif(F.col(f"f.{x}"), F.lit(""))
    rows = rows.select(
        padded_cik(F.col("cik")).alias("cik"), "page", "nth", F.col("f.accessionNumber").alias("accession_no"), F.col("f.form").alias("form_type"),
        F.try_to_date("f.filingDate", "yyyy-MM-dd").alias("filed_date"), F.try_to_date("f.reportDate", "yyyy-MM-dd").alias("period_of_report"),
        text("primaryDocument").alias("primary_doc"), text("primaryDocDescription").alias("primary_doc_description"), F.col("f.size").alias("size_bytes"),
    )
    return rows.filter("accession_no is not null and filed_date is not null and cik is not null")


def filings_of(feed: DataFrame) -> DataFrame:
    """Rows of the recent block; feed has (cik, json). A malformed filing falls out, others stay."""
    return _rows(feed.select("cik", F.lit(0).alias("page"), F.from_json("json", RECENT).alias("j")).withColumn("block", F.col("j.filings.recent")), "block")


def paged_filings(feed: DataFrame, pages: DataFrame) -> DataFrame:
    """The recent block, then the overflow pages (cik, page from 1, json) in order."""
    older = _rows(pages.select("cik", "page", F.from_json("json", OVERFLOW).alias("block")), "block")
    return filings_of(feed).unionByName(older)


def page_names(feed: DataFrame) -> DataFrame:
    """(cik, page, name) of the overflow pages that a feed lists."""
    names = feed.select("cik", F.posexplode(F.from_json("json", RECENT)["filings"]["files"]).alias("k", "f"))
    return names.select("cik", (F.col("k") + 1).alias("page"), "f.name")
