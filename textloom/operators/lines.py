"""Line filters of the cleaner, with a row for each line or within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import ratio, tidy_line

# Lines that are layout, not text.
CONTENTS = "(?Ui)^\\s*table\\s+of\\s+contents\\s*[.\\s\\d]*$"
PAGE = "(?Ui)^\\s*[-–—.\\s]*((page|pg\\.?)\\s*)?[FS]?-?\\d{1,4}\\s*[-–—.\\s]*$"
ROMAN = "(?U)^\\s*[ivxIVX]{1,5}\\s*$"


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line): tidied lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select(key, "pos", tidy_line(F.col("raw")).alias("line"))


def reason(line: Column, repeats: Column, header_len: int, header_repeats: int) -> Column:
    """Why a line goes: toc, page or header, the first that fits; null for one that stays."""
    return (
        F.when(line == "", F.lit(None))
        .when(F.regexp_like(line, F.lit(CONTENTS)), "toc")
        .when(F.regexp_like(line, F.lit(PAGE)) | F.regexp_like(line, F.lit(ROMAN)), "page")
        .when((F.length(line) < header_len) & (repeats > header_repeats), "header")
    )


def marked_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", header_len: int = 80, header_repeats: int = 5) -> DataFrame:
    """(key, pos, line, repeats, reason), with a line's repeats counted in its document."""
    lines = explode_lines(docs, key, text)
    repeats = F.count(F.lit(1)).over(Window.partitionBy(key, "line"))
    return lines.withColumn("repeats", repeats).withColumn("reason", reason(F.col("line"), F.col("repeats"), header_len, header_repeats))


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def clean_in_row(text: Column, header_len: int = 80, header_repeats: int = 5) -> Column:
    """struct(text, toc, page, header) without a shuffle: all filters look at one document only.

    Repeats are counted by sorting the document's short lines once; blank runs collapse to one blank line, none
    stands at either end.
    """
    lines = F.transform(F.split(text, "\n"), tidy_line)

    def filtered(v: Column) -> Column:
        short = F.array_sort(F.filter(v, lambda x: (x != "") & (F.length(x) < header_len)))
        # In sorted order a line of more than `header_repeats` repeats equals the one as many places on.
        frequent = lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + header_repeats) == x, F.lit(False))))
        told = lambda often: F.transform(v, lambda x: F.struct(x.alias("line"), reason(x, F.when(F.array_contains(often, x), header_repeats + 1).otherwise(0), header_len, header_repeats).alias("reason")))
        return let(let(let(short, frequent), told), joined)

    def joined(t: Column) -> Column:
        kept = F.transform(F.filter(t, lambda x: x["reason"].isNull()), lambda x: x["line"])
        collapsed = F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")
        n = lambda why: F.size(F.filter(t, lambda x: x["reason"] == why)).cast("long").alias(why)
        return F.struct(F.regexp_replace(collapsed, "^\n+|\n+$", "").alias("text"), n("toc"), n("page"), n("header"))

    return let(lines, filtered)


def collapse_blanks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of kept lines (key, pos, line): a blank stays only after text and before more text."""
    order = Window.partitionBy(key).orderBy("pos")
    whole = Window.partitionBy(key)
    last = F.max(F.when(F.col("line") != "", F.col("pos"))).over(whole)
    marked = lines.withColumns({"before": F.lag("line").over(order), "last": last})
    return marked.filter((F.col("line") != "") | ((F.col("before") != "") & (F.col("pos") < F.col("last")))).drop("before", "last")


def joined_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) from lines; a group is one document."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def clean_manifest(raw: DataFrame, name: str, html: str, text: Column, encoding: Column, wrapped: Column, min_chars: int = 5000, header_len: int = 80, header_repeats: int = 5) -> DataFrame:
    """A manifest row for each document, with its cleaned text."""
    rows = raw.select(F.col(name).alias("filename"), F.octet_length(html).cast("long").alias("raw_bytes"), text.alias("t"), encoding.alias("encoding"), wrapped.alias("wrapped"))
    rows = rows.withColumn("clean", clean_in_row(F.col("t"), header_len, header_repeats)).select("*", F.octet_length("clean.text").cast("long").alias("clean_bytes"))
    short = F.length("clean.text") < min_chars
    notes = F.concat_ws("; ", F.format_string("dropped_lines toc=%d page=%d header=%d", "clean.toc", "clean.page", "clean.header"), F.when(F.col("wrapped"), "sgml_wrapper"), F.when(short, F.format_string("chars<%d", F.lit(min_chars))))
    return rows.select(
        "filename", "raw_bytes", "clean_bytes", ratio(F.col("clean_bytes"), F.col("raw_bytes")).alias("compression_ratio"),
        F.when(short, "skipped_short").otherwise("ok").alias("status"), "encoding", notes.alias("notes"), F.col("clean.text").alias("text"),
    )
