"""Quality rules and a log-likelihood ratio of hashed n-grams, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hash buckets of the two multinomials; a power of two.
BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is fitted on, those of the smallest hashes of their ids.
SAMPLE_DOCS = 20_000
#: A document is kept whose log-likelihood ratio per n-gram is no less.
THRESHOLD = -0.07
SPACES = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def shifted(array: Column, by: int) -> Column:
    """The array without its first `by` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def joined(a: Column, b: Column, by: int) -> Column:
    """Hashes of a's runs each with the run of b that begins `by` places later, as far as b goes."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(b) - by, F.lit(0))), shifted(b, by), lambda x, y: F.xxhash64(x, y))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted(labels: DataFrame, most: int = SAMPLE_DOCS, doc: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids that every row of labels calls good: at most `most`, those of the smallest hashes."""
    ids = labels.select(F.col(f"`{doc}`").cast("long").alias("id"), F.col(f"`{quality}`").alias("q")).filter("id is not null")
    good = ids.groupBy("id").agg(F.min(F.coalesce("q", F.lit(0))).alias("q")).filter("q = 1")
    return good.orderBy(F.xxhash64("id"), "id").limit(most).select("id")


def weights(docs: DataFrame, good: DataFrame, doc: str = "doc_id", text: str = "text") -> Column:
    """A scalar array: for each bucket the log ratio of its smoothed shares in trusted texts and in all texts.

    All n-grams of all texts are counted; counts leave a task as one row a bucket at most. `good` holds
    SAMPLE_DOCS ids at most, which is why it may be broadcast.
    """
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    flagged = rows.join(F.broadcast(good.withColumn("good", F.lit(1))), rows["doc"] == good["id"], "left")
    hashed = flagged.select("good", hashes_of(words_of(F.col("text"))).alias("h"))
    grams = hashed.select("good", F.explode(let(F.col("h"), lambda h: F.concat(h, joined(h, h, 1)))).alias("g"))
    counts = grams.withColumn("b", bucket(F.col("g"))).groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))  # as many rows as buckets
    full = every.join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table_ = full.agg(
        F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("counts")
    )  # one row of BUCKETS entries
    return table_.select(
        F.transform(
            "counts",
            lambda x: F.log((x["target"] + 1) / (F.col("n_target") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("n_raw") + BUCKETS)),
        ).alias("w")
    ).scalar()


def repeated_words(hashes: Column, pairs: Column, size: int = 5) -> Column:
    """Words that lie in 5-word windows which stand twice or more in the text, from hashes of words and of pairs.

    Windows are compared by 64-bit hashes. Where none is repeated, as in most texts, nothing is sorted.
    """
    counted = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda p: F.transform(
            F.filter(
                F.transform(
                    p,
                    lambda x, k: F.struct(
                        x["i"].alias("i"), ((F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))).alias("twin")
                    ),
                ),
                lambda x: x["twin"],
            ),
            lambda x: x["i"],
        )
        starts = F.array_sort(let(placed, again))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            start,
            lambda a, i: F.struct((a["n"] + (i + size - F.greatest(i, a["end"]))).alias("n"), (i + size).alias("end")),
            lambda a: a["n"],
        )

    return let(joined(joined(pairs, pairs, 2), hashes, 4), counted)


def assess(docs: DataFrame, good: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with counts, the base rules' verdict, the length-normalised log-likelihood ratio and `kept`.

    n_words words parted by ASCII white space; word_chars their code points; n_symbols characters of #*$%&|<>;
    n_dup_lines lines with a word that equal an earlier line; n_repeat_words words in repeated 5-word windows.
    base_failed: under 10 words, or over 20 % of them repeated. llr: the sum over the text's single words and
    word pairs, by hash bucket, of log(share in trusted texts / share in all texts), divided by their number;
    0 for a text without words. kept: the base rules hold and llr >= threshold. Null and empty texts have no
    words and fail; repeated rows stay; columns named like the added ones are replaced; without trusted texts
    both shares are smoothed alike and only the base rules' counts matter much; an empty table stays empty.
    """
    weight = weights(docs, good, doc, text)
    rows = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = rows.withColumns({"_words": words_of(body), "_weights": weight})
    rows = rows.withColumn("_hashes", hashes_of(F.col("_words")))
    rows = rows.withColumn("_pairs", joined(F.col("_hashes"), F.col("_hashes"), 1))
    words, hashes, pairs = F.col("_words"), F.col("_hashes"), F.col("_pairs")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    summed = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(F.col("_weights"), bucket(x)))
    rows = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": repeated_words(hashes, pairs),
            "llr": F.when(F.size(words) == 0, F.lit(0.0)).otherwise((summed(hashes) + summed(pairs)) / (2 * F.size(words) - 1)),
        }
    ).drop("_words", "_weights", "_hashes", "_pairs")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' counts and the verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = assess(docs, trusted(table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
