"""Profile of a text corpus: lengths, characters, patterns, junk, repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.patterns import CENSUS, counts
from textloom.functions.text import digit_class

# Characters worth counting by themselves.
NOTABLE = "§$%•—–’"
LETTERS, SPACES, SIGNS = "\\p{L}", "[\\s\\x1c-\\x1f]", "[\\p{P}\\p{S}]"


def length_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, characters, mean, median, the values at ranks floor(n * 0.1) and floor(n * 0.9), extremes.

    Ranks are found on the histogram of lengths, which is bounded by the longest text, not on all rows.
    """
    sizes = docs.select(F.length(text).cast("long").alias("n")).filter("n is not null")
    histogram = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    ranked = histogram.withColumns({"upto": upto, "docs": F.sum("k").over(Window.partitionBy())})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("n")))
    share = lambda f: F.least(F.col("docs") - 1, F.floor(F.col("docs") * F.lit(f)))
    return ranked.agg(
        F.max("docs").alias("docs"),
        F.sum(F.col("n") * F.col("k")).alias("chars"),
        (F.sum(F.col("n") * F.col("k")) / F.max("docs")).alias("mean"),
        ((at(F.floor((F.col("docs") - 1) / 2)) + at(F.floor(F.col("docs") / 2))) / 2.0).alias("median"),
        at(share(0.1)).alias("p10"),
        at(share(0.9)).alias("p90"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
    )


def composition(docs: DataFrame, text: str = "text") -> DataFrame:
    """Characters by class: letters, then digits, then white space, then punctuation and symbols, then the rest."""
    kinds = {"letters": LETTERS, "digits": f"[{digit_class()}]", "whitespace": SPACES, "punctuation": SIGNS}
    # Each class is taken out by runs, so that the next one reads only what is left.
    rest, left = docs.select(F.length(text).alias("chars"), F.col(text).alias("left")), "left"
    for kind, pattern in kinds.items():
        rest = rest.withColumn("after", F.regexp_replace(left, f"(?U){pattern}+", ""))
        rest = rest.withColumn(kind, F.length(left) - F.length("after")).withColumn(left, F.col("after")).drop("after")
    sums = rest.agg(*(F.sum(k).cast("long").alias(k) for k in ("chars", *kinds)))
    return sums.withColumn("other", F.col("chars") - sum(F.col(k) for k in kinds))


def notable(docs: DataFrame, text: str = "text", chars: str = NOTABLE) -> DataFrame:
    """(char, n) of the characters that occur."""
    sums = docs.agg(*(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("long").alias(f"c{k}") for k, c in enumerate(chars)))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("char"), F.col(f"c{k}").alias("n")) for k, c in enumerate(chars)))).alias("x"))
    return rows.select("x.char", "x.n").filter("n > 0")


def census(docs: DataFrame, text: str = "text", patterns: dict[str, str] = CENSUS) -> DataFrame:
    """(pattern, hits, per_million): all patterns in one scan."""
    each = counts(F.col(text), patterns)
    sums = docs.select(F.length(text).alias("chars"), *each).agg(F.sum("chars").cast("long").alias("chars"), *(F.sum(n).cast("long").alias(n) for n in patterns))
    rows = sums.select("chars", F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("hits")) for n in patterns))).alias("x"))
    return rows.select("x.pattern", "x.hits", (F.lit(1e6) * F.col("x.hits") / F.col("chars")).alias("per_million"))


def line_flags(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with `flag`: long beyond 2000 characters, else dense in digits."""
    n = F.length(line)
    # The class of all digits asks a hundred questions of each character, so it sees only those beyond ASCII.
    beyond = F.regexp_replace(line, "[\\x00-\\x7f]+", "")
    digits = F.regexp_count(F.col(line), F.lit("[0-9]")) + F.regexp_count(beyond, F.lit(f"(?U)[{digit_class()}]"))
    return lines.withColumn("flag", F.when(n > 2000, "long").when((n > 20) & (digits / n > 0.5), "digit_dense"))


def top_lines(lines: DataFrame, most: int = 15, line: str = "line") -> DataFrame:
    """The most frequent non-empty lines, ties by text."""
    return lines.filter(F.col(line) != "").groupBy(line).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), line).limit(most)


def outliers(manifest: DataFrame, low: float = 0.03, high: float = 0.45, most: int = 8) -> DataFrame:
    rows = manifest.filter((F.col("status") == "ok") & ~F.col("compression_ratio").between(low, high))
    return rows.orderBy("compression_ratio", "filename").limit(most)


def excerpt(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, most: int = 40) -> DataFrame:
    """Consecutive lines of one document, both picked by hash of the seed; a line shows 160 characters."""
    picked = docs.filter(F.col(text).isNotNull()).select(key, text, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("h")).orderBy("h", key).limit(1)
    rows = picked.select(key, "h", F.split(text, "\n").alias("v"))
    begin = F.conv(F.substring("h", 1, 6), 16, 10).cast("long") % F.greatest(F.lit(1), F.size("v") - most)
    return rows.select(key, begin.alias("begin"), F.posexplode("v").alias("pos", "line")).filter((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + most)).select(key, "pos", F.substring("line", 1, 160).alias("line"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """All sections of the corpus report."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line"))
    return {
        "lengths": length_stats(docs, text), "composition": composition(docs, text), "notable": notable(docs, text), "patterns": census(docs, text),
        "junk": line_flags(lines).filter("flag is not null").groupBy("flag").count(), "lines": top_lines(lines), "excerpt": excerpt(docs, key, text),
    }
