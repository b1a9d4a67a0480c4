"""A corpus pipeline of five stages over `documents`: each returns the documents it keeps, with all columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, jaccard, language, lines
from textloom.llm.common import forget, stored, table

#: Near-duplicate documents: words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80


def aside(docs: DataFrame) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """docs under names that no operator uses, the name of its text, and what brings a result back to the columns of docs."""
    own = [f"_column{k}" for k in range(len(docs.columns))]
    back = lambda rows: rows.select(*own).toDF(*docs.columns)
    return docs.toDF(*own), own[docs.columns.index("text")], back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found: null texts and texts without a letter go."""
    model = language.fit(docs)
    rows, text, back = aside(docs)
    return back(language.identify(rows, model, text).filter("lang_pred <> 'und'"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their duplicate and near-duplicate lines; n_chars, if there is one, follows the text."""
    rows, text, back = aside(docs)
    left = back(lines.dedup_lines(rows, rows.columns[docs.columns.index("doc_id")], text))
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 by Jaccard over 5-word shingles, the one of the smallest id.

    Documents without words stay: line dedup leaves copies so, whose lines all stood earlier. Rows that share an id
    with words are one document; the first by text, then by the other columns in their order stays.
    """
    groups = jaccard.group_similar(docs.select("doc_id", "text"), size=SHINGLE, percent=PERCENT)
    others = groups.filter("component_id <> doc").select(F.col("doc").alias("doc_id")).distinct()
    left = docs.join(others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    twice = groups.filter("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if twice.isEmpty():
        return left
    again = left.join(twice.select("doc").hint("merge"), left["doc_id"] == twice["doc"], "left_semi")
    once = left.join(twice.select("doc").hint("merge"), left["doc_id"] == twice["doc"], "left_anti")
    empty = F.coalesce(F.trim(F.regexp_replace("text", "[ \\t-\\r]", "")), F.lit("")) == ""
    first = again.filter(~empty).groupBy("doc_id").agg(F.min(F.struct("text", F.struct(*docs.columns).alias("row"))).alias("first"))
    return once.unionByName(again.filter(empty)).unionByName(first.select("first.row.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, text, back = aside(docs)
    found = decontaminate.find_benchmark(rows, table(spark, sf_dir, "benchmark"), text)
    return back(found.filter(F.size("hit_spans") == 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its ids, their digest, and that of the decoded bytes."""
    both = bpe.encode(docs.select("doc_id", "text"), decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("similar", keep_one_of_similar),
    ("benchmark", drop_benchmark),
    ("encode", encode),
]
#: Language identification and BPE are beyond SQL. Tests hold the operators against brute force, the stages only against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            kept = stored(kept)
            if docs is not source:
                forget(docs)
        docs = kept
    return docs
