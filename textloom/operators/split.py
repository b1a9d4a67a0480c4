"""Held-out split: exact duplicates stay in training, strata are sampled by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("sha256", F.sha2(F.col(text).cast("binary"), 256))


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """(sha256, files) of contents that occur twice or more."""
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def split(docs: DataFrame, key: str, form: str, year: str, fraction: float = 0.05, seed: int = 42, least: int = 20) -> DataFrame:
    """docs (with sha256) and `split`: 'eval' for a sample of each (form, year), 'train' for all others.

    Within a stratum the order is that of md5(seed:key). Each stratum gives floor(n * fraction); a form of `least`
    unique documents or more that got less than max(1, floor(n * fraction)) is topped up from those left.
    Duplicates of a content are never held out. Strata are ranked on keys alone; texts don't move.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = docs.select(key, form, year, "sha256").withColumn("h", order)
    once = rows.join(duplicate_groups(rows), "sha256", "left_anti")
    stratum, whole = Window.partitionBy(form, year), Window.partitionBy(form)
    ranked = once.withColumns({"nth": F.row_number().over(stratum.orderBy("h", key)), "n": F.count(F.lit(1)).over(stratum)})
    ranked = ranked.withColumn("first", F.col("nth") <= F.floor(F.col("n") * F.lit(fraction)))
    ranked = ranked.withColumns({"docs": F.count(F.lit(1)).over(whole), "have": F.sum(F.col("first").cast("long")).over(whole)})
    want = F.when(F.col("docs") >= least, F.greatest(F.lit(1), F.floor(F.col("docs") * F.lit(fraction)))).otherwise(0) - F.col("have")
    more = ranked.filter(~F.col("first")).withColumn("extra", F.row_number().over(whole.orderBy("h", key)))
    held = ranked.filter("first").select(key).union(more.filter(F.col("extra") <= want).select(key)).withColumn("split", F.lit("eval"))
    return docs.join(held, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_profile(parts: DataFrame, form: str, size: str) -> DataFrame:
    """(split, form, docs, bytes), the form null for a split's total."""
    return parts.rollup("split", form).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).cast("long").alias("bytes")).filter("split is not null")


def subsample(docs: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """All documents if they are no more, else those of the `most` smallest md5(seed:key)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return docs.withColumn("h", order).orderBy("h", key).limit(most).drop("h")


def list_digest(names: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """One row (names, digest) for a whole list of numbers: the SHA-256 of the digests of its blocks, in order.

    A block holds the names of `block` numbers in sequence, sorted, one a line; only digests meet in one place.
    """
    lines = F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), "\n")
    blocks = names.groupBy(F.floor(F.col(key) / block).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(lines, 256).alias("h"))
    of_blocks = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("names"), F.sha2(F.array_join(of_blocks, "\n"), 256).alias("digest"))
