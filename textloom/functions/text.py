"""Column functions on text: decoding, markup, white space, names of filings, measures."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the 32 bytes 80-9F stand for in Windows code page 1252; five are undefined.
CP1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
# Punctuation with an ASCII equivalent, one character to one.
PLAIN_FROM, PLAIN_TO = "‘’‚‛“”„–—―‑′″", "''''\"\"\"----'\""
# Tags that begin a line, cells that begin with a space, elements left out with all they hold.
BLOCK_TAGS = (
    "p div tr table thead tbody tfoot caption li ul ol dl dt dd h1 h2 h3 h4 h5 h6 br hr blockquote pre center section article header footer form fieldset"
).split()
CELL_TAGS, DROPPED_TAGS = ("td", "th"), ("script", "style", "head", "noscript")
#: What Python's str.strip() removes, for Java: Unicode white space and the separators U+001C to U+001F.
STRIP = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
STEM = "^(\\d{10})_(\\d{18})_([A-Za-z0-9-]+)$"


def decode_bytes(content: Column) -> Column:
    """struct(text, encoding): strict UTF-8, else code page 1252 with U+FFFD for undefined bytes."""
    latin = F.decode(content, "ISO-8859-1")
    page = F.translate(latin, "".join(chr(c) for c in range(0x80, 0xA0)), CP1252)
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.struct(F.when(utf8, content.cast("string")).otherwise(page).alias("text"), F.when(utf8, F.lit("utf-8")).otherwise(F.lit("cp1252")).alias("encoding"))


def strip_wrapper(html: Column) -> Column:
    """struct(html, wrapped): what stands between the first <TEXT> and the last </TEXT> of an SGML-wrapped filing."""
    opened = F.regexp_instr(F.substring(html, 1, 4096), F.lit("(?i)<TEXT>"))
    wrapped = F.regexp_like(F.substring(html, 1, 512), F.lit("(?is)<DOCUMENT>\\s*<TYPE>")) & (opened > 0)
    body = F.substr(html, opened + F.lit(6))
    closed = F.regexp_extract(body, "(?is)^(.*)</TEXT>", 1)
    inner = F.when(F.regexp_like(body, F.lit("(?i)</TEXT>")), closed).otherwise(body)
    return F.struct(F.when(wrapped, inner).otherwise(html).alias("html"), F.coalesce(wrapped, F.lit(False)).alias("wrapped"))


def markup_to_text(html: Column) -> Column:
    """Text of well-formed markup by regular expressions: line breaks where block tags open, a space where cells do.

    Hidden elements (display:none) and entities beyond the common ones need operators.html.parse_markup.
    """
    dropped = "|".join(DROPPED_TAGS)
    steps = [
        (f"(?is)<({dropped})\\b.*?</({dropped})>", ""),
        ("(?s)<!--.*?-->", ""),
        (f"(?i)<({'|'.join(BLOCK_TAGS)})\\b[^>]*>", "\n"),
        (f"(?i)<({'|'.join(CELL_TAGS)})\\b[^>]*>", " "),
        ("<[^>]*>", ""),
    ]
    out = html
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    for entity, char in (("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def tidy_line(line: Column) -> Column:
    """No-break spaces to spaces, runs of horizontal space to one, none at the ends."""
    return strip(F.regexp_replace(F.translate(line, "\xa0", " "), "[ \\t\\f\\x0B]+", " "))


def plain_punctuation(text: Column) -> Column:
    return F.replace(F.translate(text, PLAIN_FROM, PLAIN_TO), F.lit("…"), F.lit("..."))


def stem_parts(stem: Column) -> Column:
    """struct(cik, accession, form); empty where the stem is of another form."""
    return F.struct(*(F.regexp_extract(stem, STEM, k).alias(n) for k, n in enumerate(("cik", "accession", "form"), 1)))


def stratum(stem: Column) -> Column:
    """struct(form, year): 2000 plus the two digits of the accession, ('OTHER', 0) for other stems."""
    fits = F.regexp_like(stem, F.lit(STEM))
    year = 2000 + F.substring(F.regexp_extract(stem, STEM, 2), 11, 2).cast("int")
    return F.struct(F.when(fits, F.regexp_extract(stem, STEM, 3)).otherwise("OTHER").alias("form"), F.when(fits, year).otherwise(0).alias("year"))


def era(stem: Column) -> Column:
    late = F.regexp_like(stem, F.lit(STEM)) & (F.substring(F.regexp_extract(stem, STEM, 2), 11, 2) >= "19")
    return F.when(late, "2019+").otherwise("pre-2019")


def form_label(stem: Column) -> Column:
    return F.substring_index(stem, "_", -1)


def padded_cik(raw: Column) -> Column:
    """Ten digits; null where it isn't a number."""
    return F.lpad(F.ltrim(raw, F.lit("CIK")).try_cast("bigint").cast("string"), 10, "0")


def document_url(cik: Column, accession: Column, primary: Column) -> Column:
    """Null without a primary document; the number's leading zeros go."""
    base = F.lit("https://www.sec.gov/Archives/edgar/data/")
    return F.concat(base, cik.try_cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), F.nullif(primary, F.lit("")))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def digit_class() -> str:
    """A character class of all that str.isdigit() accepts."""
    found = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return "\\p{Nd}" + "".join(f"\\x{{{c:x}}}" for c in found)
