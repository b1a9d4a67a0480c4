"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, partitioned tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, STEP, U64, forget, mix, stored, table

#: Words with pairs of their own, the most frequent; None: all. Others share the class 0 and are told apart inside it.
VOCABULARY: int | None = None
#: Words whose counts every task knows, the most frequent; the others go by a hash of 63 bits and are looked up.
KNOWN_WORDS = (1 << 16) - 2
UNKNOWN, BEGIN = 0, 1
#: Counts above are not discounted.
HIGHEST = 5
#: Word pairs that every task knows, the most frequent; the others are looked up in their partition.
KNOWN_PAIRS = 600_000
END = b""
#: Characters of text for each partition of the tables.
PER_PARTITION = 16_000_000


def tokens(text: bytes | None) -> list[bytes]:
    words = text.translate(ASCII_LOWER).split() if text else []
    words.append(END)
    return words


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discount by count, 1 beyond HIGHEST; n[r] is how many events have count r.

    Where Good-Turing's estimate isn't between 0 and 1, as on small data, it is (r - 1/2) / r.
    """
    out = np.ones(HIGHEST + 2)
    tail = (HIGHEST + 1) * n[HIGHEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, HIGHEST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Words(NamedTuple):
    """Unigram level: counts of all tokens, with the classes of the pair level."""

    total: int
    distinct: int
    discount: np.ndarray
    unseen: float  # share of all words never seen
    vocabulary: list[bytes]
    counts: np.ndarray  # by id
    share: np.ndarray  # by id: probability, class UNKNOWN included

    def of_count(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word of count c (0: of all unseen words together)."""
        return np.where(c > 0, self.discount[np.minimum(c, HIGHEST + 1)] * c / max(self.total, 1), self.unseen)


class Pairs(NamedTuple):
    """Pair level by context id, and the pairs known everywhere."""

    discount: np.ndarray
    total: np.ndarray  # count as a context
    scale: np.ndarray
    backoff: np.ndarray
    ids: np.ndarray
    counts: np.ndarray


def bucket_of_words(words: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words)) % U64(buckets)).astype(np.int64)


def bucket_of_pairs(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(U64)) % U64(buckets)).astype(np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        for part in np.split(order, cuts):
            yield int(buckets[part[0]]), part


def pair_ids(ids: np.ndarray) -> np.ndarray:
    before = np.concatenate((np.array([BEGIN], np.uint32), ids[:-1].astype(np.uint32)))
    return (before << np.uint32(16)) | ids.astype(np.uint32)


def wide_ids(words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Ids of all words: those of known words, below 0 the hashes of the others."""
    out = ids.astype(np.int64)
    at = np.flatnonzero(ids == UNKNOWN)
    hashes = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in at.tolist()), U64, len(at))
    out[at] = (hashes | U64(1 << 63)).view(np.int64)
    return out


def split_pairs(words: list[bytes], ids: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of known words as packed ids; if every word has its own pairs, the others as contexts and words."""
    packed, none = pair_ids(ids), np.zeros(0, np.int64)
    if not every or ids.all():
        return packed, none, none
    wide = wide_ids(words, ids)
    before = np.concatenate((np.array([BEGIN], np.int64), wide[:-1]))
    rare = (wide < 0) | (before < 0)
    return packed[~rare], before[rare], wide[rare]


def distinct_pairs(contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of wide ids and how often each came."""
    with np.errstate(over="ignore"):
        keys = mix(contexts.view(U64) * U64(STEP) + mix(words.view(U64)))
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    return contexts[first], words[first], n


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            words = list(seen)
            counts = np.fromiter(seen.values(), np.int64, len(words))
            out = [(k, b" ".join([words[i] for i in part.tolist()]), counts[part].tobytes()) for k, part in by_bucket(bucket_of_words(words, buckets))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "words", "counts"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(tokens(text.as_py()))
                if len(seen) > 300_000:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    return run


def _merge_words(group: pd.DataFrame) -> pd.DataFrame:
    seen: Counter = Counter()
    for words, counts in zip(group["words"], group["counts"], strict=True):
        for w, c in zip(words.split(b" "), np.frombuffer(counts, np.int64).tolist(), strict=True):
            seen[w] += c
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "words": [b" ".join(seen)], "counts": [np.fromiter(seen.values(), np.int64, len(seen)).tobytes()]})


def _count_pairs(vocabulary, buckets: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k + 2 for k, w in enumerate(vocabulary.value)}
        seen, counts, held, waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def fold() -> None:
            nonlocal seen, counts, held, waiting
            values, new = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate((seen, values)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, new)), len(both)).astype(np.int64)
            seen, held, waiting = both, [], 0

        def rows() -> pa.RecordBatch:
            out = [(k, seen[part].tobytes(), counts[part].astype(np.uint32).tobytes()) for k, part in by_bucket(bucket_of_pairs(seen, buckets))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "counts"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = tokens(text.as_py())
                held.append(split_pairs(words, np.fromiter(map(number.get, words, repeat(UNKNOWN)), np.uint32, len(words)), every)[0])
                waiting += len(words)
                if waiting > 1_000_000:
                    fold()
                    if len(seen) > 1_500_000:
                        yield rows()
                        seen, counts = seen[:0], counts[:0]
        if held:
            fold()
        if len(seen):
            yield rows()

    return run


def _count_rare_pairs(vocabulary):
    """Pairs with a word that isn't known, counted run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k + 2 for k, w in enumerate(vocabulary.value)}
        held, waiting = [], 0

        def rows() -> pa.RecordBatch:
            contexts, words, n = distinct_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(contexts), pa.array(words), pa.array(n)], names=["h", "w", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = tokens(text.as_py())
                ids = np.fromiter(map(number.get, words, repeat(UNKNOWN)), np.uint32, len(words))
                held.append(split_pairs(words, ids, True)[1:])
                waiting += len(held[-1][0]) + 1
                if waiting > 500_000:
                    yield rows()
                    held, waiting = [], 0
        if held:
            yield rows()

    return run


def _rare_words(vocabulary):
    """(w, c) of the words that aren't known, from the packed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(vocabulary.value)
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                words, counts = words.as_py().split(b" "), np.frombuffer(counts.as_py(), np.int64)
                at = np.array([i for i, w in enumerate(words) if w not in known], np.int64)
                own = [words[i] for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(wide_ids(own, np.zeros(len(own), np.uint32))), pa.array(counts[at])], names=["w", "c"])

    return run


def _merge_pairs(group: pd.DataFrame) -> pd.DataFrame:
    ids = np.concatenate([np.frombuffer(x, np.uint32) for x in group["ids"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]])
    both, at = np.unique(ids, return_inverse=True)
    total = np.bincount(at, counts, len(both)).astype(np.int64)
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "ids": [both.tobytes()], "counts": [total.tobytes()]})


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many events have each count, exact up to 64 and by powers of 2 ** 1/8 beyond, and the sum of counts."""
    for batch in batches:
        for c in batch.column(0):
            counts = np.frombuffer(c.as_py(), np.int64)
            steps = np.where(counts <= 64, counts, 64 + np.ceil(np.log2(np.maximum(counts, 64) / 64) * 8).astype(np.int64))
            kinds, n = np.unique(steps, return_counts=True)
            least = np.minimum.reduceat(counts[np.argsort(steps, kind="stable")], np.concatenate(([0], np.cumsum(n)[:-1]))) if len(kinds) else kinds
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n), pa.array(np.bincount(np.searchsorted(kinds, steps), counts, len(kinds)).astype(np.int64)), pa.array(least)], names=["step", "n", "total", "least"])


def histogram(packed: DataFrame) -> list:
    rows = packed.select("counts").mapInArrow(_histogram, "step long, n long, total long, least long")
    return rows.groupBy("step").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least")).orderBy("step").collect()


def of_counts(rows: list) -> list[int]:
    n = dict.fromkeys(range(HIGHEST + 2), 0) | {r.step: r.n for r in rows}
    return [n[r] for r in range(HIGHEST + 2)]


def _most_frequent(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                words, counts = words.as_py().split(b" "), np.frombuffer(counts.as_py(), np.int64)
                if len(words) > most:
                    floor = np.partition(counts, len(counts) - most)[len(counts) - most]
                    keep = np.flatnonzero(counts >= floor)
                    words, counts = [words[i] for i in keep.tolist()], counts[keep]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], names=["word", "c"])

    return run


def learn_words(train: DataFrame, buckets: int) -> tuple[DataFrame, Words]:
    """The stored table of all token counts, by bucket, and the unigram level."""
    packed = train.mapInArrow(_count_words(buckets), "bucket long, words binary, counts binary")
    counts = stored(packed.groupBy("bucket").applyInPandas(_merge_words, "bucket long, words binary, counts binary"))
    rows = histogram(counts)
    total, distinct = sum(r.total for r in rows), sum(r.n for r in rows)
    most = KNOWN_WORDS if VOCABULARY is None else min(VOCABULARY, KNOWN_WORDS)
    top = counts.select("words", "counts").mapInArrow(_most_frequent(most), "word binary, c long").orderBy(F.desc("c"), "word").limit(most).collect()
    d = discounts(of_counts(rows))
    seen = sum(r.total * (d[r.step] if r.step <= HIGHEST else 1.0) for r in rows) / total if total else 0.0
    vocabulary = [bytes(r.word) for r in top]
    own = np.array([0, 0, *(r.c for r in top)], np.int64)
    share = d[np.minimum(own, HIGHEST + 1)] * own / max(total, 1)
    share[UNKNOWN] = 1 - share.sum()  # words without an id, and unseen ones
    unseen = 1 - seen
    if unseen <= 0:  # no count is low enough to be discounted
        share, unseen = share * total / (total + 1), 1 / (total + 1)
        share[UNKNOWN] = 1 - share[BEGIN:].sum()
        d = d * total / (total + 1)
    if VOCABULARY is None:
        share[UNKNOWN] = unseen
    return counts, Words(total, distinct, d, unseen, vocabulary, own, share)


def _context_sums(discount: np.ndarray, share: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(share)
        sums = np.zeros((3, size))
        for batch in batches:
            for ids, counts in zip(batch.column(0), batch.column(1), strict=True):
                ids, counts = np.frombuffer(ids.as_py(), np.uint32), np.frombuffer(counts.as_py(), np.int64)
                context, word = ids >> np.uint32(16), ids & np.uint32(0xFFFF)
                for k, x in enumerate((counts, discount[np.minimum(counts, HIGHEST + 1)] * counts, share[word])):
                    sums[k] += np.bincount(context, x, size)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(s[at]) for s in sums)], names=["context", "c", "kept", "lower"])

    return run


def _frequent_pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts in zip(batch.column(0), batch.column(1), strict=True):
                ids, counts = np.frombuffer(ids.as_py(), np.uint32), np.frombuffer(counts.as_py(), np.int64)
                keep = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array([ids[keep].tobytes()]), pa.array([counts[keep].tobytes()])], names=["ids", "counts"])

    return run


class Rare(NamedTuple):
    """What isn't known everywhere: (h, w, n) of pairs, (w, share) of words, (h, total, scale, backoff) of contexts."""

    pairs: DataFrame
    words: DataFrame
    contexts: DataFrame


def weights(total: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and backoff weight of contexts, from their counts, the discounted ones and their followers' shares."""
    some = total > 0
    kept = np.where(some, kept / np.maximum(total, 1), 0.0)
    free = 1 - lower  # what the lower level gives to words not seen here
    scale = np.where(some & (kept > 1 - 1e-12), total / (total + 1), 1.0)  # nothing was discounted
    closed = some & (free < 1e-12)  # every word was seen here
    scale = np.where(closed, 1 / np.where(closed, kept, 1), scale)
    return scale, np.where(closed, 0.0, (1 - scale * kept) / np.maximum(free, 1e-300))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, kept, lower = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, weights(total, kept, lower))], names=["h", "total", "scale", "backoff"])


def discounted(discount: np.ndarray, c: str):
    """Column: the count less its discount."""
    return F.element_at(F.array(*(F.lit(float(x)) for x in discount)), F.least(F.col(c), F.lit(HIGHEST + 1)).cast("int") + 1) * F.col(c)


def learn_pairs(train: DataFrame, words: Words, buckets: int, word_table: DataFrame) -> tuple[DataFrame, Pairs, Rare | None]:
    """The stored table of counts of known words' pairs, by bucket, the pair level, and all other pairs."""
    spark = train.sparkSession
    vocabulary = spark.sparkContext.broadcast(words.vocabulary)
    every = VOCABULARY is None
    packed = train.mapInArrow(_count_pairs(vocabulary, buckets, every), "bucket long, ids binary, counts binary")
    counts = stored(packed.groupBy("bucket").applyInPandas(_merge_pairs, "bucket long, ids binary, counts binary"))
    rows = histogram(counts)
    n = of_counts(rows)
    if every:
        rare = stored(train.mapInArrow(_count_rare_pairs(vocabulary), "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n")))
        for r in rare.filter(F.col("n") <= HIGHEST + 1).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect():
            n[r.n] += r.k
    d = discounts(n)
    size = len(words.share)
    sums = counts.select("ids", "counts").mapInArrow(_context_sums(d, words.share), "context long, c double, kept double, lower double")
    sums = sums.groupBy("context").agg(F.sum("c").alias("c"), F.sum("kept").alias("kept"), F.sum("lower").alias("lower")).collect()  # a row for each id at most
    total, kept, lower = np.zeros(size), np.zeros(size), np.zeros(size)
    at = np.array([r.context for r in sums], np.int64)
    for out, name in ((total, "c"), (kept, "kept"), (lower, "lower")):
        out[at] = [r[name] for r in sums]
    if every:
        shares = stored(word_table.select("words", "counts").mapInArrow(_rare_words(vocabulary), "w long, c long").select("w", (discounted(words.discount, "c") / max(words.total, 1)).alias("share")))
        known = spark.createDataFrame(pd.DataFrame({"w": np.arange(size), "share": words.share}))
        both = rare.filter("w < 0").join(shares.hint("merge"), "w").select("h", "n", "share")
        both = both.unionAll(rare.filter("w >= 0").join(F.broadcast(known), "w").select("h", "n", "share"))  # KNOWN_WORDS rows and the begin mark
        more = stored(both.groupBy("h").agg(F.sum("n").cast("double").alias("total"), F.sum(discounted(d, "n")).alias("kept"), F.sum("share").alias("lower")))
        for r in more.filter("h >= 0").collect():  # a row for each id at most
            total[r.h] += r.total
            kept[r.h] += r.kept
            lower[r.h] += r.lower
        rare = Rare(rare, shares, more.filter("h < 0").mapInArrow(_weigh, "h long, total double, scale double, backoff double"))
    scale, backoff = weights(total, kept, lower)
    least, most = 1 << 62, 0
    for r in reversed(rows):
        most += r.n
        if most > KNOWN_PAIRS:
            break
        least = r.least
    frequent = counts.select("ids", "counts").mapInArrow(_frequent_pairs(least), "ids binary, counts binary").collect()  # KNOWN_PAIRS pairs at most
    ids = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.ids, np.uint32) for r in frequent)])
    own = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.counts, np.int64) for r in frequent)])
    order = np.argsort(ids)
    return counts, Pairs(d, total, scale, backoff, ids[order], own[order]), rare if every else None


def log_pair(ids: np.ndarray, counts: np.ndarray, words: Words, pairs: Pairs) -> np.ndarray:
    """log10 of P(word id | context id): the discounted share if the pair was seen, else the backoff weight times P(word id)."""
    context, word = ids >> np.uint32(16), ids & np.uint32(0xFFFF)
    total = pairs.total[context]
    seen = pairs.scale[context] * pairs.discount[np.minimum(counts, HIGHEST + 1)] * counts / np.maximum(total, 1)
    lower = np.where(total > 0, pairs.backoff[context], 1.0) * words.share[word]
    with np.errstate(divide="ignore"):
        return np.log10(np.where(counts > 0, seen, lower))


def find_counts(table_ids: np.ndarray, table_counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(table_ids):
        return np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(table_ids, ids), len(table_ids) - 1)
    return np.where(table_ids[at] == ids, table_counts[at], 0)


SENT = "kind long, bucket long, what binary, counts binary, docs binary, keys binary, doc long, a long, b long, n_tokens long, n_known long, base double, score double"


def _send(model, word_buckets: int, pair_buckets: int, every: bool):
    """From each document a row of what can be told here, and in packs by bucket what must be looked up there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Words(*model.value[0]), Pairs(*model.value[1])
        number = {w: k + 2 for k, w in enumerate(words.vocabulary)}
        names = [x.split()[0] for x in SENT.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 5, pa.float64(), pa.float64()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(x) for r in rows], t) for x, t in zip(names, types, strict=True)], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            pack = np.array(keys, np.int64)
            out = []
            rare_docs = np.repeat(np.arange(len(keys)), [len(x) for x in rare])
            flat = [w for x in rare for w in x]
            flat_n = np.concatenate([np.zeros(0, np.int64), *rare_n])
            for k, part in by_bucket(bucket_of_words(flat, word_buckets)):
                own, local = np.unique(rare_docs[part], return_inverse=True)
                out.append({"kind": 1, "bucket": k, "what": b" ".join([flat[i] for i in part.tolist()]), "counts": flat_n[part].astype(np.uint32).tobytes(), "docs": local.astype(np.uint32).tobytes(), "keys": pack[own].tobytes()})
            pair_docs = np.repeat(np.arange(len(keys)), [len(x) for x in asked])
            ids, n = np.concatenate([np.zeros(0, np.uint32), *asked]), np.concatenate([np.zeros(0, np.int64), *asked_n])
            for k, part in by_bucket(bucket_of_pairs(ids, pair_buckets)):
                own, local = np.unique(pair_docs[part], return_inverse=True)
                out.append({"kind": 2, "bucket": k, "what": ids[part].tobytes(), "counts": n[part].astype(np.uint32).tobytes(), "docs": local.astype(np.uint32).tobytes(), "keys": pack[own].tobytes()})
            wide_docs = np.repeat(np.arange(len(keys)), [len(x[0]) for x in wide])
            for k in range(0, len(wide_docs), 100_000):
                own, local = np.unique(wide_docs[k : k + 100_000], return_inverse=True)
                h, w, n = (np.concatenate(x)[k : k + 100_000] for x in zip(*wide, strict=True))
                out.append({"kind": 3, "bucket": 0, "what": np.concatenate((h, w)).tobytes(), "counts": n.astype(np.uint32).tobytes(), "docs": local.astype(np.uint32).tobytes(), "keys": pack[own].tobytes()})
            for k in range(0, len(out), 200):
                yield batch_of(out[k : k + 200])

        keys, rare, rare_n, asked, asked_n, wide, held = [], [], [], [], [], [], 0
        for batch in batches:
            heads = []
            for text, doc, a, b in zip(batch.column(0).cast(pa.binary()), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                split = tokens(text.as_py())
                ids = np.fromiter(map(number.get, split, repeat(UNKNOWN)), np.uint32, len(split))
                own = words.counts[ids[ids != UNKNOWN]]
                rest = Counter([split[i] for i in np.flatnonzero(ids == UNKNOWN).tolist()])
                packed, contexts, followers = split_pairs(split, ids, every)
                wide.append(distinct_pairs(contexts, followers))
                kinds, n = np.unique(packed, return_counts=True)
                c = find_counts(pairs.ids, pairs.counts, kinds)
                here = c > 0
                score = float((log_pair(kinds[here], c[here], words, pairs) * n[here]).sum())
                heads.append({"kind": 0, "bucket": 0, "doc": doc, "a": a, "b": b, "n_tokens": len(split), "n_known": len(own), "base": float(np.log10(own + 1).sum()), "score": score})
                keys.append((a, b))
                rare.append(list(rest))
                rare_n.append(np.fromiter(rest.values(), np.int64, len(rest)))
                asked.append(kinds[~here])
                asked_n.append(n[~here])
                held += len(split)
                if held > 400_000 or len(keys) >= 20_000:
                    yield from flush()
                    keys, rare, rare_n, asked, asked_n, wide, held = [], [], [], [], [], [], 0
            if heads:
                yield batch_of(heads)
        if keys:
            yield from flush()

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and pair from the packs of kind 3."""
    for batch in batches:
        for what, n, docs, keys in zip(*batch.columns, strict=True):
            h, w = np.frombuffer(what.as_py(), np.int64).reshape(2, -1)
            own = np.frombuffer(keys.as_py(), np.int64).reshape(-1, 2)[np.frombuffer(docs.as_py(), np.uint32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[:, 0].copy(), own[:, 1].copy(), h, w, np.frombuffer(n.as_py(), np.uint32).astype(np.int64))], names=["a", "b", "h", "w", "m"])


def score_rare(asked: DataFrame, words: Words, pairs: Pairs, rare: Rare) -> DataFrame:
    """(a, b, score) of the asked pairs (a, b, h, w, m), each of which has a word that isn't known everywhere.

    Known words' weights are broadcast, so only rare words and pairs are keys of an exchange.
    Tables go as soon as nothing reads them any more, rare.pairs too.
    """
    spark, size = asked.sparkSession, len(words.share)
    contexts = F.broadcast(spark.createDataFrame(pd.DataFrame({"h": np.arange(size), "total": pairs.total, "scale": pairs.scale, "backoff": np.where(pairs.total > 0, pairs.backoff, 1.0)})))
    shares = F.broadcast(spark.createDataFrame(pd.DataFrame({"w": np.arange(size), "share": words.share})))
    found = rare.pairs.filter("h < 0").join(rare.contexts.hint("merge"), "h").select("h", "w", "n", "total", "scale")
    found = found.unionAll(rare.pairs.filter("h >= 0").join(contexts, "h").select("h", "w", "n", "total", "scale"))
    found = stored(found.select("h", "w", F.log10(F.col("scale") * discounted(pairs.discount, "n") / F.col("total")).alias("p")))
    forget(rare.pairs)
    own = [F.when(F.col("p").isNull(), F.col(x)).alias(x) for x in ("h", "w")]  # of a pair that was found only p is asked for
    told = stored(asked.join(found.hint("merge"), ["h", "w"], "left").select("a", "b", *own, "m", "p"))
    forget(found)
    other = told.filter("p is null").select("a", "b", "h", "w", "m")
    other = other.filter("w < 0").join(rare.words.hint("merge"), "w", "left").unionByName(other.filter("w >= 0").join(shares, "w"))
    weighed = [other.filter("h < 0").join(rare.contexts.hint("merge"), "h", "left"), other.filter("h >= 0").join(contexts, "h")]
    lower = F.coalesce("backoff", F.lit(1.0)) * F.coalesce("share", F.lit(float(words.unseen)))
    lower = F.when(lower > 0, F.log10(lower)).otherwise(F.lit(float("-inf")))
    return told.filter("p is not null").select("a", "b", (F.col("m") * F.col("p")).alias("score")).unionAll(
        weighed[0].unionByName(weighed[1]).select("a", "b", (F.col("m") * lower).alias("score"))
    )


def _look_up(model, every: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        words, pairs = Words(*model.value[0]), Pairs(*model.value[1])
        kind = group["kind"].iloc[0]
        known = group[group["docs"].isna()]
        out = []
        asked = group[group["docs"].notna()]
        if kind == 1:
            table_ = {}
            for what, counts in zip(known["what"], known["counts"], strict=True):
                table_.update(zip(what.split(b" "), np.frombuffer(counts, np.int64).tolist(), strict=True))
        elif len(known):
            ids, counts = np.frombuffer(known["what"].iloc[0], np.uint32), np.frombuffer(known["counts"].iloc[0], np.int64)
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for what, n, docs, keys in zip(asked["what"], asked["counts"], asked["docs"], asked["keys"], strict=True):
            n, docs = np.frombuffer(n, np.uint32).astype(np.int64), np.frombuffer(docs, np.uint32)
            keys = np.frombuffer(keys, np.int64).reshape(-1, 2)
            sums = lambda x: np.bincount(docs, x, len(keys))  # noqa: E731, B023
            if kind == 1:
                split = what.split(b" ")
                c = np.fromiter(map(table_.get, split, repeat(0)), np.int64, len(split))
                score = n * (0.0 if every else np.log10(words.of_count(c) / words.share[UNKNOWN]))
                base, seen = sums(n * np.log10(c + 1)), sums(n * (c > 0))
            else:
                own = np.frombuffer(what, np.uint32)
                score = n * log_pair(own, find_counts(ids, counts, own), words, pairs)
                base = seen = np.zeros(len(keys))
            out.append(pd.DataFrame({"a": keys[:, 0], "b": keys[:, 1], "n_known": seen.astype(np.int64), "base": base, "score": sums(score)}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "n_known": pd.Series([], dtype="int64"), "base": pd.Series([], dtype="float64"), "score": pd.Series([], dtype="float64")})

    return run


def score_texts(docs: DataFrame, train: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, by a model of all texts of train.

    Tokens: A-Z lower-cased, parted by ASCII white space, then one end; a null text is empty, its one token the
    end. The model is a Katz pair model with a begin mark: counts up to HIGHEST are discounted by Good-Turing,
    what they lose goes to unseen followers of the same context in proportion to the unigram level, by
    weights that make each context's probabilities add up to 1; unigrams are discounted alike, for unseen words.
    Every training word has its own pairs, as follower and as context; the KNOWN_WORDS most frequent go by number,
    the others by hash. Should VOCABULARY be a number, words beyond are pairs' one class and keep their own share of
    it. The probabilities of all words and of "unseen" add up to 1 in each context. base_score: the add-one unigram score. Every training token is counted; nothing is cut off. Equal rows are scored once
    and returned as often as they came; other columns don't matter; without training text all is unseen.

    Tables of word and pair counts are stored in the shared folder by hash bucket, as many as the texts'
    size asks for. Tasks know the frequent words and pairs (fixed bounds); each document's others travel in
    packs to their bucket, and sums come back by document. A frequent pair never travels, so no bucket is hot.
    Pairs with a word that isn't known are rows of a table of their own, joined by pair, then by word and context.
    """
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{doc}`").cast("long").alias("doc"))
    rows = rows.withColumns({"a": F.xxhash64("doc", "text"), "b": F.xxhash64("text", F.lit(1))})
    texts = train.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    word_buckets = max(16, min(1 << 20, size // PER_PARTITION))
    pair_buckets = max(16, min(1 << 13, size // PER_PARTITION))
    word_table, words = learn_words(texts, word_buckets)
    pair_table, pairs, rare = learn_pairs(texts, words, pair_buckets, word_table)
    model = docs.sparkSession.sparkContext.broadcast((tuple(words), tuple(pairs)))
    sent = rows.mapInArrow(_send(model, word_buckets, pair_buckets, rare is not None), SENT)
    none = F.lit(None).cast("binary")
    tables = word_table.select(F.lit(1).cast("long").alias("kind"), "bucket", F.col("words").alias("what"), "counts", none.alias("docs"), none.alias("keys")).unionAll(
        pair_table.select(F.lit(2).cast("long").alias("kind"), "bucket", F.col("ids").alias("what"), "counts", none.alias("docs"), none.alias("keys"))
    )
    sent = stored(sent)
    packs = sent.filter("kind in (1, 2)").select("kind", "bucket", "what", "counts", "docs", "keys").unionAll(tables)
    found = packs.groupBy("kind", "bucket").applyInPandas(_look_up(model, rare is not None), "a long, b long, n_known long, base double, score double")
    if rare is not None:
        asked = sent.filter("kind = 3").select("what", "counts", "docs", "keys").mapInArrow(_unpack, "a long, b long, h long, w long, m long")
        own = score_rare(asked, words, pairs, rare)
        found = found.unionByName(own.select("a", "b", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), "score"))
    found = found.groupBy("a", "b").agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    heads = sent.filter("kind = 0").select("doc", "a", "b", "n_tokens", "n_known", "base", "score")
    # Equal rows sent equal packs: each of the m copies has an m-th of what was found for all of them.
    copies = heads.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    found = found.join(copies.hint("merge"), ["a", "b"]).select(
        "a", "b", F.round(F.col("n_known") / F.col("m")).cast("long").alias("found_n_known"), (F.col("base") / F.col("m")).alias("found_base"), (F.col("score") / F.col("m")).alias("found_score")
    )
    both = heads.join(found.hint("merge"), ["a", "b"], "left")
    zero = F.lit(0.0)
    return both.select(
        "doc",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found_n_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("found_base", zero) - F.col("n_tokens") * F.log10(F.lit(float(words.total + words.distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("found_score", zero)).alias("score"),
    )


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores by a model learned from six of seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    rows = score_texts(docs, docs.filter(fold != 2))
    held_out = F.coalesce(F.crc32(F.col("doc").cast("string")) % 7 == 2, F.lit(False))
    return rows.select(F.col("doc").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
