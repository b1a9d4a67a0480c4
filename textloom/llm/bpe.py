"""Byte-level BPE encoding and decoding by replaying merges over a shard of the corpus."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, pieces, table, tidy

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: Characters of text whose words are replayed together.
SHARD = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def plain_classes(pattern: str, top: int = 0x110000) -> str:
    """The pattern, for characters below `top`, with \\p{L}, \\p{N} and \\s spelled out as ranges, for the faster of the two regex engines."""
    ranges = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = regex.compile(f"{name}+").finditer("".join(map(chr, [*range(0xD800), *range(0xE000, top)])))
        ranges[name] = "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in found)
    inside = re.sub(r"\[(\^?)([^\]]*)\]", lambda m: f"[{m[1]}" + re.sub(r"\\p\{[LN]\}|\\s", lambda c: ranges[c[0]], m[2]) + "]", pattern)
    parts = re.split(r"(\[\^?(?:\\.|[^\]\\])*\])", inside)
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"\\p\{[LN]\}|\\s", lambda c: f"[{ranges[c[0]]}]", parts[k]).replace(r"\S", f"[^{ranges[chr(92) + 's']}]")
    return "".join(parts)


class Numbers(dict):
    """Words numbered in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Merges:
    """What the replay needs of a vocabulary: the rank of each pair of tokens, as a sorted table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys = np.array([k for k, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array([r for _, r in pairs], np.int32)[order]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    @classmethod
    def of(cls, **fields) -> Merges:
        out = cls.__new__(cls)
        vars(out).update(fields)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)


#: The rank of a pair that can't be merged; the ranks that one band of the index holds, as a power of two.
NONE, BAND = np.int32((1 << 31) - 1), 9


class MergeReplay:
    """Encodes the distinct words of a shard of the corpus at once.

    The words lie in one sequence with walls between them. An index leads from the rank of a pair, in bands,
    to the places in words where the pair stands. Bands are taken in rank order; of the places in the band
    each word merges its pair of lowest rank, leftmost in a tie, until the band is empty, and only the two
    neighbours of a merged place are ranked anew and entered in the index. A neighbour of lower rank than
    the band's joins the band at work, so each word sees its merges in the same order as if encoded alone.
    """

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.find, self.find_short = re.compile(plain_classes(pattern)), re.compile(plain_classes(pattern, 0x10000))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after another, and the number of each word's ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        size = len(flat) + len(words) + 1
        token, owner, rank = np.full(size, -1, np.int32), np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        places = np.arange(len(flat)) + word + 1
        token[places], owner[places] = self.merges.single[flat], word
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        table = self.merges.rank(np.repeat(self.merges.single, 256), np.tile(self.merges.single, 256))
        if len(flat) > 1:
            rank[places[:-1]] = np.where(places[1:] == places[:-1] + 1, table[flat[:-1].astype(np.int64) * 256 + flat[1:]], NONE)
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            bands = rank[at] >> BAND
            order = np.argsort(bands, kind="stable")
            at, bands = at[order], bands[order]
            cuts = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1], [True])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                index.setdefault(int(bands[i]), []).append(at[i:j])

        if (begin := np.flatnonzero(rank != NONE)).size:
            enter(begin)
        for band in range((len(self.merges.ranks) >> BAND) + 1):
            if band not in index:
                continue
            end = (band + 1) << BAND
            work = np.concatenate(index.pop(band))
            while (work := np.sort(work[rank[work] < end])).size:
                work = work[np.concatenate(([True], work[1:] != work[:-1]))]
                work = work[np.argsort(owner[work] << 32 | rank[work], kind="stable")]
                own = owner[work]
                first = np.concatenate(([True], own[1:] != own[:-1]))
                left = work[first]
                right, merged = after[left], rank[left]
                beyond = after[right]
                token[left], token[right], rank[right] = merged, -2, NONE
                after[left], before[beyond] = beyond, left
                ahead = before[left]
                rank[ahead] = self.merges.rank(token[ahead], merged)
                rank[left] = self.merges.rank(merged, token[beyond])
                touched = np.concatenate((ahead, left))
                new = rank[touched]
                if (later := touched[(new >= end) & (new != NONE)]).size:
                    enter(later)
                work = np.concatenate((work[~first], touched[new < end]))
        alive = token >= 0
        return token[alive], np.bincount(owner[alive], minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and the number of each text's ids; a null text has none."""
        numbers = Numbers()
        parts = [np.fromiter(map(numbers.__getitem__, self._words(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        words = [w.encode() for w in numbers]
        whole = np.fromiter((self.merges.ranks.get(w, -1) for w in words), np.int32, len(words))
        split = np.flatnonzero(whole < 0)
        ids, counts = self.replay([words[k] for k in split])
        n = np.ones(len(words), np.int64)
        n[split] = counts
        begins = np.zeros(len(words) + 1, np.int64)
        np.cumsum(n, out=begins[1:])
        store = np.empty(begins[-1], np.int32)
        store[np.repeat(whole < 0, n)] = ids
        store[np.repeat(whole >= 0, n)] = whole[whole >= 0]
        every = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        taken = n[every]
        ends = np.cumsum(taken)
        flat = store[np.repeat(begins[every] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        by_text = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=by_text[1:])
        ends = np.concatenate(([0], ends))
        return flat, np.diff(ends[by_text])

    def _words(self, text: str) -> Iterator[str] | list[str]:
        find = self.find_short if len(text.encode("utf-16-le")) == 2 * len(text) else self.find
        return find.findall(text) if len(text) < 1 << 20 else (m[0] for m in find.finditer(text))


def bytes_of(token: Callable[[int], bytes], flat: np.ndarray, counts: list[int | None]) -> pa.Array:
    """The bytes of each row's ids, which lie one row after another in flat; null for a count of None."""
    found, begin = [], 0
    for n in counts:
        found.append(None if n is None else b"".join(map(token, flat[begin : begin + n].tolist())))
        begin += n or 0
    return pa.array(found, pa.binary())


def encode(
    docs: DataFrame,
    text: str = "text",
    ids: str = "ids",
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    decoded: str | None = None,
) -> DataFrame:
    """docs with an array<int> column `ids`: each match of `pattern` in the whole text, encoded by itself.

    If `decoded` is given, a binary column of that name has what decode() makes of the ids, by the same
    Python worker: a pass of its own has a worker for each core besides, with a copy of the ids.

    A null text is taken as empty and has no ids; so has an empty one. Repeated rows stay. Other columns
    pass through; one named like `ids` or `decoded` is replaced. An empty table gives an empty table. The ranks file
    is read on the driver and broadcast: a vocabulary of fixed size that doesn't grow with the data.
    """
    ranks = read_ranks(ranks_path or public_tokenizers.path(RANKS_FILE))
    shared = docs.sparkSession.sparkContext.broadcast(vars(Merges(ranks)))  # plain arrays

    def make() -> Callable[[list], list[pa.Array]]:
        replay = MergeReplay(Merges.of(**shared.value), pattern)
        token = {r: t for t, r in replay.merges.ranks.items()}.__getitem__ if decoded else None

        def work(texts: list) -> list[pa.Array]:
            flat, counts = replay.encode(texts)
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            found = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            return [*found, bytes_of(token, flat, counts.tolist())] if decoded else found

        return work

    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return add_columns(docs, text, T.StructType(added), make, most=SHARD)


def decode(coded: DataFrame, ids: str = "ids", out: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """coded with a binary column `out`: the bytes of the ids, one after another; null for null ids.

    An id outside the vocabulary fails the job. Other columns pass through; one named like `out` is replaced.
    """
    ranks = read_ranks(ranks_path or public_tokenizers.path(RANKS_FILE))
    shared = coded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})
    kept = [c for c in coded.columns if c != out]
    schema = T.StructType([*(coded.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lengths = [n or 0 for n in column.value_lengths().to_pylist()]
            for part in pieces(batch, lengths, 1 << 19):
                rows = part.column(part.schema.get_field_index(ids))
                found = bytes_of(token, rows.flatten().to_numpy(zero_copy_only=False), rows.value_lengths().to_pylist())
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, found], names=schema.names)

    return coded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(tidy(run), schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded bytes for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
