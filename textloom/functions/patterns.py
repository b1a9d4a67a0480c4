"""Patterns of the filings domain, with Python's Unicode meaning of \\d, \\s, \\w and \\b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns' names and expressions.
DOLLAR = r"\$\s?\d[\d,]*(?:\.\d+)?"
PERCENT = r"\d+(?:\.\d+)?\s?%"
BASIS_POINTS = r"\b\d+\s?bps\b|\bbasis\s+points?\b"
CUSIP_WORD = r"\bCUSIP\b"
CUSIP = r"\b(?=[0-9A-Z]{9}\b)(?=[0-9A-Z]*[A-Z])[0-9A-Z]{8}[0-9]\b"
TICKER = r"\$[A-Z]{1,5}\b"
CITATION = r"\b(?:Rule|Section|Regulation|Item)\s+\d+[\w.()\-]*"
SECTION = r"§\s?\d[\w.()\-]*"
GAAP_LEAK = r"us-gaap:[A-Za-z]+"
IX_LEAK = r"</?ix:"
BIG_NUMBER = r"\b\d{1,3}(?:,\d{3}){2,}\b"
CAMEL_CASE = r"\b(?:[A-Z][a-z]+){4,}\b"
ANY_CASE = {"basis_points", "cusip_keyword", "rule_section_citation", "ix_tag_leak"}
CENSUS = {
    "dollar_amount": DOLLAR, "percentage": PERCENT, "basis_points": BASIS_POINTS, "cusip_keyword": CUSIP_WORD, "cusip_like": CUSIP,
    "ticker_like": TICKER, "rule_section_citation": CITATION, "section_symbol": SECTION, "us_gaap_leak": GAAP_LEAK, "ix_tag_leak": IX_LEAK,
}
COSTS = {
    "dollar_amount": DOLLAR, "percentage": PERCENT, "basis_points": BASIS_POINTS, "cusip_like": CUSIP, "rule_section_citation": CITATION,
    "section_symbol": SECTION, "big_number": BIG_NUMBER, "gaap_camelcase": CAMEL_CASE,
}


def java(name: str, pattern: str) -> str:
    return ("(?Ui)" if name in ANY_CASE else "(?U)") + pattern


def counts(text: Column, patterns: dict[str, str] = CENSUS) -> list[Column]:
    """A column for each pattern: its non-overlapping matches, all in one pass over the rows."""
    return [F.regexp_count(text, F.lit(java(n, p))).cast("long").alias(n) for n, p in patterns.items()]


def matches(text: Column, patterns: dict[str, str] = COSTS) -> Column:
    """array<struct<pattern, found>> of all matches."""
    # A function of its own for each name: transform gives a second parameter the index.
    named = lambda n: lambda m: F.struct(F.lit(n).alias("pattern"), m.alias("found"))
    each = [F.transform(F.regexp_extract_all(text, F.lit(java(n, p)), F.lit(0)), named(n)) for n, p in patterns.items()]
    return F.concat(*each)
