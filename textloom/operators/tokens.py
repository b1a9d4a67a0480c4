"""Tokenizers: splitting text into chunks, training merges, encoding, and what tokens cost."""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.learn import merges_of

# What a chunk is, by mode.
CHUNKS = {
    "gpt2": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "digits": r" ?\$?\d[\d,]*(?:\.\d+)?%?| ?\p{L}+| ?[^\s\p{L}\d]+|\s+",
    "line": r"[^\n]{1,256}|\n+",
}
SPECIAL = "<|endoftext|>"
LINE_TOKEN_MOST = 64
# Strings that show what a tokenizer does with the domain's notation.
DEMOS = (
    "Revenues of $3,232,193 for fiscal 2023, an increase of 4.25%.", "CUSIP No. 88160R101", "approximately 150bps of margin expansion",
    "pursuant to Rule 206(4)-1 and §251(h) of the DGCL", "RevenueFromContractWithCustomerExcludingAssessedTax",
)
CANONICAL = (
    "$1,234.56", "$3,232,193", "4.25%", "150bps", "88160R101", "Rule 206(4)-1", "§251(h)", "Item 1A. Risk Factors",
    "RevenueFromContractWithCustomerExcludingAssessedTax", "basis points", "EBITDA margin", "the Company’s",
)


#: Bytes in the order of their ids: those that stand for themselves in byte-level vocabularies, then all others.
BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTES += [b for b in range(256) if b not in set(BYTES)]
ID = [BYTES.index(b) + 1 for b in range(256)]


def chunks(text: Column, mode: str = "gpt2") -> Column:
    """The text cut into chunks whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + CHUNKS[mode]), F.lit(0))


def chunk_counts(docs: DataFrame, mode: str = "gpt2", text: str = "text") -> DataFrame:
    """(chunk, n) over all documents, counted before the shuffle."""
    return docs.select(F.explode(chunks(F.col(text), mode)).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counted: DataFrame) -> DataFrame:
    """(pair, n): neighbouring bytes (as hex) within chunks, weighted by the chunks' counts."""
    code = F.hex(F.col("chunk").cast("binary"))
    at = F.sequence(F.lit(1), F.length(code) - 3, F.lit(2))
    pairs = counted.filter(F.octet_length("chunk") > 1).select(F.explode(F.transform(at, lambda i: F.substr(code, i, F.lit(4)))).alias("pair"), "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


class Merges:
    """A vocabulary: bytes by id (0 is the special token, then the 256 bytes), and merges in rank order."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.merges = merges
        self.bytes = [SPECIAL.encode(), *(bytes([b]) for b in BYTES)]
        self.rank: dict[tuple[int, int], int] = {}
        for pair in merges:
            self.rank[pair] = len(self.bytes)
            self.bytes.append(self.bytes[pair[0]] + self.bytes[pair[1]])

    def encode(self, chunk: bytes) -> list[int]:
        ids = [ID[b] for b in chunk]
        while len(ids) > 1:
            best = min(((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            k = best[1]
            ids[k : k + 2] = [best[0]]
        return ids


def train(counted: list[tuple[str, int]], vocab_size: int, min_frequency: int = 2, longest: int | None = None) -> Merges:
    """Byte-pair merges of counted chunks: the most frequent pair first, ties by the lower ids.

    An index leads from a pair to the chunks that hold it, so a merge touches those alone; a heap holds
    candidates by count, checked against the present count when they come up.
    """
    words = [[ID[b] for b in c.encode()] for c, _ in counted]
    weight = [n for _, n in counted]
    count: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            count[p] += weight[k]
            where[p].add(k)
    size = [len(SPECIAL), *[1] * 256]
    heap = [(-n, p) for p, n in count.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and 257 + len(merges) < vocab_size:
        n, pair = heapq.heappop(heap)
        if count[pair] != -n:
            if count[pair] > 0:
                heapq.heappush(heap, (-count[pair], pair))
            continue
        if -n < min_frequency or n == 0:
            break
        if longest and size[pair[0]] + size[pair[1]] > longest:
            continue
        new = 257 + len(merges)
        merges.append(pair)
        size.append(size[pair[0]] + size[pair[1]])
        changed: Counter = Counter()
        for k in where.pop(pair):
            old, out, i = words[k], [], 0
            while i < len(old):
                if i + 1 < len(old) and (old[i], old[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(old[i])
                    i += 1
            before, after = Counter(zip(old, old[1:], strict=False)), Counter(zip(out, out[1:], strict=False))
            for p in before.keys() | after.keys():
                d = after[p] - before[p]
                if d:
                    changed[p] += d * weight[k]
                if p in after:
                    where[p].add(k)
                elif p in before and p != pair:
                    where[p].discard(k)
            words[k] = out
        for p, d in changed.items():
            count[p] += d
            if d > 0:
                heapq.heappush(heap, (-count[p], p))
        count[pair] = 0
    return Merges(merges)


def train_each(docs: DataFrame, sizes: dict[str, int], min_frequency: int = 2, text: str = "text") -> dict[str, Merges]:
    """A model for each mode, of the size given for it: one scan counts the chunks, and executors learn all models together.

    The driver holds the merges alone.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), chunks(F.col(text), mode).alias("c")) for k, mode in enumerate(sizes)))).alias("each")
    rows = docs.select(each).select("each.k", F.explode("each.c").alias("chunk")).filter(F.octet_length("chunk") > 1)
    counted = rows.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))
    wanted = [(size, LINE_TOKEN_MOST if mode == "line" else None) for mode, size in sizes.items()]
    found = merges_of(counted, ID, [len(SPECIAL), *[1] * 256], wanted, min_frequency)
    return {mode: Merges(m) for mode, m in zip(sizes, found, strict=True)}


def train_on(docs: DataFrame, vocab_size: int = 65536, min_frequency: int = 2, mode: str = "gpt2", text: str = "text") -> Merges:
    return train_each(docs, {mode: vocab_size}, min_frequency, text)[mode]


def sweep(docs: DataFrame, sizes: list[int], modes: list[str], min_frequency: int = 2) -> dict[str, Merges]:
    """Models for several sizes and modes; a smaller vocabulary is a prefix of a larger one's merges."""
    out = {}
    largest = train_each(docs, dict.fromkeys(modes, max(sizes)), min_frequency)
    for mode in modes:
        for size in sizes:
            suffix = "" if mode == "gpt2" else f"-{mode}"
            out[f"bpe-{size}{suffix}"] = Merges(largest[mode].merges[: max(0, size - 257)])
    return out


def token_counts(docs: DataFrame, model: Merges, key: str = "doc_id", mode: str = "gpt2", text: str = "text") -> DataFrame:
    """(key, tokens): each distinct chunk is encoded once and joined back to the documents' chunk counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model.merges)

    @F.pandas_udf("long")
    def n_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Merges(shared.value)
        for batch in batches:
            yield batch.map(lambda c: len(own.encode(c.encode())))

    by_doc = docs.select(key, F.explode(chunks(F.col(text), mode)).alias("chunk")).groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n"))
    distinct = by_doc.select("chunk").distinct().withColumn("ids", n_ids("chunk"))
    sums = by_doc.join(distinct, "chunk").groupBy(key).agg(F.sum(F.col("n") * F.col("ids")).alias("tokens"))
    return docs.select(key).join(sums, key, "left").select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"))


def tokenized(model: Merges, text: str, mode: str = "gpt2") -> list[str]:
    import regex

    pieces = [model.bytes[i] for c in regex.findall(CHUNKS[mode], text) for i in model.encode(c.encode())]
    return [p.decode("utf-8", "replace").replace(" ", "_") for p in pieces]


def counter_of(model: Merges, mode: str = "gpt2") -> Callable[[str], int]:
    import regex

    find = regex.compile(CHUNKS[mode])
    return lambda s: sum(len(model.encode(c.encode())) for c in find.findall(s))


def model_tables(spark, model: Merges) -> tuple[DataFrame, DataFrame]:
    """merges(rank, left, right, new_id) and vocab(id, bytes)."""
    merges = spark.createDataFrame([(k, a, b, 257 + k) for k, (a, b) in enumerate(model.merges)], "rank int, left int, right int, new_id int")
    return merges, spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(model.bytes)], "id int, bytes binary")


def save(spark, model: Merges, path: str, meta: dict) -> None:
    merges, vocab = model_tables(spark, model)
    merges.coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark, path: str) -> tuple[Merges, dict]:
    """The model and its metadata; metadata without a mode means gpt2."""
    rows = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))
    return Merges([(r.left, r.right) for r in rows]), {"pretokenizer": "gpt2"} | meta


def compression(facts: DataFrame, first: str) -> DataFrame:
    """(tokenizer, tokens, bytes, bytes_per_token, rel_pct) from facts (tokenizer, doc, form, era, tokens, bytes)."""
    sums = facts.groupBy("tokenizer").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("bytes").cast("long").alias("bytes"))
    sums = sums.withColumn("bytes_per_token", F.col("bytes") / F.col("tokens"))
    base = sums.filter(F.col("tokenizer") == first).select(F.col("bytes_per_token").alias("base"))
    return sums.crossJoin(F.broadcast(base)).withColumn("rel_pct", (F.col("base") / F.col("bytes_per_token") - 1) * -100).drop("base")  # one row


def slices(facts: DataFrame) -> DataFrame:
    """(tokenizer, label, bytes_per_token) for every form and both eras, in one pass."""
    sums = facts.groupingSets([["tokenizer", "form"], ["tokenizer", "era"]], "tokenizer", "form", "era").agg(F.sum("tokens").alias("t"), F.sum("bytes").alias("b"))
    return sums.select("tokenizer", F.coalesce("form", "era").alias("label"), (F.col("b") / F.greatest(F.lit(1), F.col("t"))).alias("bytes_per_token"))


def median_tokens(facts: DataFrame, form: str = "10K") -> DataFrame:
    """(tokenizer, median) of the form's documents, 0 without any."""
    return facts.groupBy("tokenizer").agg(F.coalesce(F.percentile(F.when(F.col("form") == form, F.col("tokens")), 0.5), F.lit(0.0)).alias("median"))


def pattern_sample(found: DataFrame, most: int = 2000, seed: int = 42) -> DataFrame:
    """Up to `most` matches (pattern, found, key) of each pattern by hash, with the number of all.

    Matches are counted by pattern and the hash's first 3 digits; only those up to the digits at which `most` is reached are
    ranked: about one in 4096 beside them.
    """
    order, digits = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 3
    bins = found.groupBy("pattern", F.substring(order, 1, digits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("pattern")
    before = F.sum("n").over(whole.orderBy("bin")) - F.col("n")
    bins = bins.withColumns({"before": before, "instances": F.sum("n").over(whole)})
    bounds = bins.filter(F.col("before") < most).groupBy("pattern").agg(F.max("bin").alias("last"), F.max("instances").alias("instances"))
    few = found.withColumn("h", order).join(F.broadcast(bounds), "pattern").filter(F.substring("h", 1, digits) <= F.col("last"))  # one row a pattern
    nth = F.row_number().over(whole.orderBy("h", "key"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth", "h", "last")


def pattern_tokens(found: DataFrame, models: dict[str, tuple[Merges, str]]) -> DataFrame:
    """(pattern, tokenizer, instances, mean_tokens, mean_bytes, mean_chars) of all matches (pattern, found), for models with their modes by name.

    Each match is measured with a space before it, mean_tokens rounded to 2 places. Equal matches are encoded once.
    """
    shared = found.sparkSession.sparkContext.broadcast([(m.merges, mode) for m, mode in models.values()])

    @F.pandas_udf("array<long>")
    def n_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = [counter_of(Merges(merges), mode) for merges, mode in shared.value]
        for batch in batches:
            yield batch.map(lambda s: [count(s) for count in own])

    counted = found.groupBy("pattern", "found").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.withColumn("s", F.concat(F.lit(" "), "found")).withColumn("ids", n_ids("s"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col("ids")[k].alias("tokens")) for k, name in enumerate(models)))).alias("each")
    sums = rows.select("pattern", "n", F.octet_length("s").alias("b"), F.length("s").alias("c"), each).groupBy("pattern", "each.tokenizer")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return sums.agg(F.sum("n").alias("instances"), F.round(mean("each.tokens"), 2).alias("mean_tokens"), mean("b").alias("mean_bytes"), mean("c").alias("mean_chars"))
