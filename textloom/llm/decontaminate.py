"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, U64, Powers, Windows, add_columns, table, winnow

WINDOW = 8
#: Words of benchmark text that one pass holds; a larger benchmark takes several passes over the documents.
BLOCK_WORDS = 1 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split() if text else []


def gram_and_width(length: int) -> tuple[int, int]:
    """k-gram length and winnowing width for windows of `length` words: each window holds width k-grams."""
    k = -(-length * 5 // 8)
    return k, length - k + 1


class Fingerprints:
    """The winnowed k-grams of a block of benchmark items, by window length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        by_words: dict[tuple[bytes, ...], set] = defaultdict(set)  # items of the same words are one
        for item, words in items:
            if words:
                by_words[tuple(words)].add(item)
        self.ids = [sorted(x for x in names if x is not None) for names in by_words.values()]
        self.number: dict[bytes, int] = {}
        self.items = [[self.number.setdefault(w, len(self.number) + 1) for w in words] for words in by_words]
        self.codes = np.array([0, *map(xxhash.xxh64_intdigest, self.number)], U64)
        powers = Powers()
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, item in enumerate(self.items):
            length = min(window, len(item))
            k, width = gram_and_width(length)
            hashes = Windows(self.codes[item], powers).all(k)
            for q in winnow(hashes, width).tolist():
                places[length][int(hashes[q])].append((n, q))
        self.places = {length: dict(x) for length, x in places.items()}
        self.sorted = {length: np.sort(np.fromiter(x, U64, len(x))) for length, x in places.items()}


class Scanner:
    def __init__(self, prints: Fingerprints):
        self.prints, self.powers = prints, Powers()

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], np.ndarray, np.ndarray, list[set[int]]]:
        """Of each text the number of words; its first word's place in the run and which words of the run are hit; its items."""
        p = self.prints
        split = [words_of(t) for t in texts]
        counts = [len(w) for w in split]
        wall = [0] * WINDOW  # texts lie in one run; word 0 is in no item
        run: list[int] = []
        begins = np.zeros(len(texts), np.int64)
        for n, words in enumerate(split):
            begins[n] = len(run)
            run.extend(map(p.number.get, words, repeat(0)))
            run.extend(wall)
        numbers = np.array(run, np.int64)
        hit, found = np.zeros(len(run) + 1, np.int32), [set() for _ in texts]
        windows = Windows(p.codes[numbers], self.powers) if run else None
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        for length, table in p.sorted.items():
            k, width = gram_and_width(length)
            if windows is None or windows.n < length:
                continue
            hashes = windows.all(k)
            at = np.searchsorted(table, hashes)
            at[at == len(table)] = 0
            shared = (table[at] == hashes) & (unknown[k:] == unknown[:-k])
            chosen = np.flatnonzero(shared) if width == 1 else self._chosen(hashes, shared, width)
            done: dict[tuple[int, int], int] = {}  # item and offset to the end of the run that is known
            for i, owner in zip(chosen.tolist(), (np.searchsorted(begins, chosen, "right") - 1).tolist(), strict=True):
                for n, q in p.places[length][int(hashes[i])]:
                    if done.get((n, i - q), -1) > i:
                        continue
                    item = p.items[n]
                    a = b = 0
                    while a < q and run[i - a - 1] == item[q - a - 1] and i - a > 0:
                        a += 1
                    while q + b < len(item) and run[i + b] == item[q + b]:
                        b += 1
                    if a + b >= length and b >= k:
                        hit[i - a] += 1
                        hit[i + b] -= 1
                        found[owner].add(n)
                    done[n, i - q] = i + b
        return counts, begins, np.cumsum(hit)[:-1] > 0, found

    @staticmethod
    def _chosen(hashes: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
        chosen = winnow(hashes, width)
        return chosen[shared[chosen]]


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, held = [], 0
    for name, words in benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`").cast("string")).toLocalIterator():
        split = words_of(words.encode() if words is not None else None)
        block.append((name, split))
        held += len(split)
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """docs with n_words, hit_spans (word ranges that lie in occurrences of item windows) and items (their ids as sorted strings).

    Words are runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII. A window is
    `window` consecutive words of an item, or all words of a shorter one. Both sides keep the smallest k-gram
    of each run of k-grams that a window spans, so every shared window shares a fingerprint; hits are extended
    word by word to both sides and count from a window's length on. Null texts have no words; an item
    without words or with a null text occurs nowhere; words of an item with a null id are hit, but the id is
    not listed. Rows of the same item id count as one item. Repeated document rows stay, columns named like
    the added ones are replaced, and an empty benchmark hits nothing. Documents aren't shuffled: fingerprints
    are broadcast in blocks of BLOCK_WORDS words, one pass over the documents for each.
    """
    passes = 0
    for block in blocks_of(benchmark, item, item_text):
        docs = _pass(docs, text, vars(Fingerprints(block, window)), passes > 0)
        passes += 1
    return docs if passes else _pass(docs, text, vars(Fingerprints([], window)), False)


def _pass(docs: DataFrame, text: str, prints: dict, again: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(prints)

    def make() -> Callable[[list], list[pa.Array]]:
        own = Fingerprints.__new__(Fingerprints)
        vars(own).update(shared.value)
        scanner = Scanner(own)

        def work(texts: list) -> list[pa.Array]:
            counts, begins, hit, found = scanner.scan(texts)
            spans = [spans_of(hit[a : a + n]) if x else [] for a, n, x in zip(begins.tolist(), counts, found, strict=True)]
            items = [sorted({i for n in x for i in own.ids[n]}) for x in found]
            return [pa.array(v, f.type) for v, f in zip((counts, spans, items), arrow, strict=True)]

        return work

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(FOUND))
    if not again:
        return add_columns(docs, text, FOUND, make, binary=True)
    before = {f"{c} before": F.col(c) for c in ("hit_spans", "items")}
    both = add_columns(docs.withColumns(before), text, FOUND, make, binary=True)
    return both.withColumns(
        {
            "hit_spans": merged_spans(F.concat("hit_spans", "hit_spans before")),
            "items": F.array_sort(F.array_distinct(F.concat("items", "items before"))),
        }
    ).drop(*before)


def merged_spans(spans: F.Column) -> F.Column:
    """Overlapping word ranges united."""
    kind = "array<struct<begin:int,end:int>>"
    joined = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["begin"]),
        F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), joined)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hit words and items of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["begin"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


OP4_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
item as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(8, len(w)) as n, list_slice(w, i, i + least(8, len(w)) - 1) as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from item where len(w) > 0)),
lens as (select distinct n from win),
pos as (
  select r, n, i, list_slice(w, i, i + n - 1) as g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lens where len(w) >= n)),
occ as (select p.r, p.i, p.n, v.item_id from pos p join win v on p.n = v.n and p.g = v.g),
hit as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from occ) group by r),
ids as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s
  from (select distinct r, item_id from occ where item_id is not null) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(s.n_items, 0) as n_items,
  sha256(coalesce(s.s, '')) as items_sha256, coalesce(s.n_items, 0) >= 2 as contaminated
from doc d left join hit h on d.r = h.r left join ids s on d.r = s.r
"""
