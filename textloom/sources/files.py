"""Scans of filings, texts, lists, indexes and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_MANIFEST = "filename string, cik string, accession string, form string, raw_bytes bigint, clean_bytes bigint, compression_ratio double, status string, encoding string, notes string"
FETCH_MANIFEST = "cik string, accession string, filed string, year int, form string, company string, status string, bytes bigint, url string, note string"


def _name(path) -> F.Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def raw_filings(spark: SparkSession, path: str) -> DataFrame:
    """(filename, stem, content) of a folder's *.htm and *.html; files of one stem stay apart."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{htm,html}").load(path)
    name = _name(F.col("path"))
    return rows.select(name.alias("filename"), F.regexp_replace(name, "\\.html?$", "").alias("stem"), "content")


def clean_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(filename, stem, text) of several folders' *.txt."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(paths, wholetext=True)
    name = _name(F.col("_metadata.file_path"))
    return rows.select(name.alias("filename"), F.regexp_replace(name, "\\.txt$", "").alias("stem"), F.col("value").alias("text"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def master_index(spark: SparkSession, path: str) -> DataFrame:
    """Body lines of index files: what stands after each file's line of dashes."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "(?s)^.*?\n---[^\n]*\n", "").alias("body"))
    return rows.select(F.explode(F.split("body", "\r?\n")).alias("value")).filter("value <> ''")


def manifest(spark: SparkSession, path: str, schema: str = CLEAN_MANIFEST) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
