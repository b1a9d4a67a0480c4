"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table

#: The bounded sample that a language's automaton is built from: so many documents at most, and so many symbols of them.
SAMPLE_DOCS, SAMPLE_SYMBOLS = 40, 24_000
#: Letters whose steps stand in a dense table; those of rarer letters are looked up in a sorted one.
DENSE_LETTERS = 250
#: Texts are laid out in segments of so many symbols; the state at a segment's end is the next one's begin.
SEGMENT = 2048


class Letters:
    """Turns a text into lower-case letters as code points."""

    def __init__(self):
        self.fold, self.letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for c in range(0x20000):  # beyond lie ideographs and private use
            if unicodedata.category(chr(c))[0] == "L":
                self.letter[c] = True
                if len(low := chr(c).lower()) == 1:
                    self.fold[c] = ord(low)
        self.letter[0x20000:0x323B0] = True

    def of(self, text: str) -> np.ndarray:
        """Each run of other characters is one 32, none at either end."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.where(self.letter[points], self.fold[points], 32).astype(np.uint32)
        if not len(out):
            return out
        out = out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))]
        return out[int(out[0] == 32) : len(out) - int(out[-1] == 32 and len(out) > 1)]


class Model(NamedTuple):
    langs: list[str]
    symbol: np.ndarray  # of a code point: 0 for letters that no sample has, 1 for the space
    step: np.ndarray  # state * n_dense + symbol to the next state, -1 where the phrase ends; symbols below n_dense
    rare: np.ndarray  # state * n_symbols + symbol, sorted: the steps of all other symbols
    rare_step: np.ndarray  # the next state of each of them
    roots: np.ndarray  # each language's first state
    root: np.ndarray  # language * n_dense + symbol to the state of a phrase that begins with it, the root if none does
    cost: np.ndarray  # bits that name a phrase in each language's sample
    n_dense: int
    n_symbols: int


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: from state 0 it reads exactly the substrings."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


def build(samples: dict[str, list[str]], most_symbols: int = SAMPLE_SYMBOLS) -> Model:
    """A model of whole sample texts by language, in the order given, until a language has most_symbols."""
    langs, texts, letters = sorted(samples), {}, Letters()
    for lang in langs:
        parts = [letters.of(t) for t in samples[lang]]
        texts[lang] = np.concatenate([np.append(p, np.uint32(32)) for p in parts] or [np.zeros(0, np.uint32)])[:most_symbols]
    counts = Counter()
    for lang in langs:
        counts.update(texts[lang].tolist())
    del counts[32]
    letters_found = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    n_symbols = len(letters_found) + 2
    n = min(n_symbols, DENSE_LETTERS + 2)
    symbol = np.zeros(0x110000, np.min_scalar_type(n_symbols))
    symbol[32] = 1
    symbol[letters_found] = np.arange(2, n_symbols)
    step, rare, roots, at = [], {}, [], 0
    root = np.zeros((len(langs), n), np.int32)
    for k, lang in enumerate(langs):
        states = automaton(symbol[texts[lang]].tolist())
        rows = np.full((len(states), n), -1, np.int32)
        for i, x in enumerate(states):
            for c, to in x.items():
                if c < n:
                    rows[i, c] = to + at
                else:
                    rare[(i + at) * n_symbols + c] = to + at
        step.append(rows)
        root[k] = np.where(rows[0] < 0, at, rows[0])
        roots.append(at)
        at += len(states)
    rare[np.iinfo(np.int64).max] = -1  # no key lies beyond it
    keys = sorted(rare)
    steps = np.concatenate(step).ravel() if step else np.zeros(0, np.int32)
    cost = np.log2(np.array([max(2, len(texts[x])) for x in langs]))
    return Model(langs, symbol, steps, np.array(keys, np.int64), np.array([rare[k] for k in keys], np.int32), np.array(roots, np.int32), root.ravel(), cost, n, n_symbols)


def rare_steps(model: Model, state: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The next states for symbols beyond the dense table, -1 where the phrase ends."""
    keys = state.astype(np.int64) * model.n_symbols + c
    at = np.searchsorted(model.rare, keys)
    return np.where(model.rare[at] == keys, model.rare_step[at], -1)


def read(model: Model, grid: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end within each segment (a column of grid, longest first) by language, and the state at its end."""
    state, roots = state.copy(), model.roots[:, None]
    count = np.zeros(state.shape, np.int32)
    first = (np.arange(len(roots), dtype=np.int32) * model.n_dense)[:, None]
    some_rare = bool((grid >= model.n_dense).any())
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # segments longer than t
    for t in range(lengths[0]):
        m = alive[t]
        c = grid[t, :m].astype(np.int32)
        dense = np.where(c < model.n_dense, c, 0) if some_rare else c
        to = model.step[state[:, :m] * model.n_dense + dense]
        fresh = model.root[first + dense]
        if some_rare and (rare := np.flatnonzero(c >= model.n_dense)).size:
            to[:, rare] = rare_steps(model, state[:, rare], c[rare])
            fresh[:, rare] = np.maximum(rare_steps(model, roots, c[rare]), roots)
        ended = to < 0
        count[:, :m] += ended
        # A symbol that the sample lacks is a phrase of its own.
        count[:, :m] += ended & (fresh == roots) & (state[:, :m] != roots)
        state[:, :m] = np.where(ended, fresh, to)
    return count, state


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text (its letters) by language: each is the longest match in the language's sample.

    All segments are read side by side, at first each from a phrase's begin, then from the state at the end of the
    one before. Parses from different places soon meet, so few are left after that; they are read again, of
    each text the earliest at a time, until every segment began where the one before ended.
    """
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    places = [(k, i) for k, t in enumerate(texts) for i in range(0, len(t), SEGMENT)]
    if not places or not model.langs:
        return out
    order = sorted(range(len(places)), key=lambda x: -min(SEGMENT, len(texts[places[x][0]]) - places[x][1]))
    column = np.argsort(order)
    owner, begin_at = np.array(places)[order].T
    before = np.where(begin_at > 0, column[np.array(order) - 1], -1)
    lengths = np.array([min(SEGMENT, len(texts[k]) - i) for k, i in zip(owner, begin_at, strict=True)])
    grid = np.zeros((len(order), lengths[0]), model.symbol.dtype)
    for x, (k, i) in enumerate(zip(owner, begin_at, strict=True)):
        grid[x, : lengths[x]] = model.symbol[texts[k][i : i + SEGMENT]]
    grid = np.ascontiguousarray(grid.T)
    roots = model.roots[:, None]
    begin = np.repeat(roots, len(order), axis=1)
    count, end = read(model, grid, lengths, begin)
    first = True
    while True:
        due = np.where(before >= 0, end[:, before], roots)
        again = np.flatnonzero((due != begin).any(axis=0))
        if not len(again):
            break
        if not first:
            by_place = again[np.lexsort((begin_at[again], owner[again]))]
            again = np.sort(by_place[np.unique(owner[by_place], return_index=True)[1]])
        first = False
        begin[:, again] = due[:, again]
        count[:, again], end[:, again] = read(model, grid[:, again], lengths[again], begin[:, again])
    last = begin_at + lengths == np.array([len(t) for t in texts])[owner]
    count += last & (end != roots)
    np.add.at(out, owner, count.T)
    return out


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def judge(model: Model, alphabet: Letters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    letters = [alphabet.of(t) if t else np.zeros(0, np.uint32) for t in texts]
    letters = [x if (x != 32).any() else x[:0] for x in letters]
    bits = phrases(model, letters) * model.cost
    langs, scores = [], []
    for x, b in zip(letters, bits, strict=True):
        if not len(x) or not model.langs:
            langs.append("und")
            scores.append(0.0)
            continue
        best = int(np.argmin(b))
        langs.append(model.langs[best])
        scores.append(float(1 / np.exp2(np.maximum((b[best] - b) / len(x) * min(len(x), 64), -60)).sum()))
    return langs, scores


def sample(train: DataFrame, text: str, lang: str, most_docs: int) -> dict[str, list[str]]:
    """Up to most_docs distinct texts of each language, those of the smallest hashes: the same at any partitioning.

    Only hashes are ranked and moved; the chosen texts are fetched by a second scan.
    """
    rows = train.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null and text rlike '\\\\p{L}'")
    hashed = rows.withColumn("h", F.xxhash64("lang", "text"))
    distinct = hashed.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    # A language of most rows is ranked in 64 parts first, of which each hands on most_docs rows at most.
    by_part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    by_hash = Window.partitionBy("lang").orderBy("h")
    few = distinct.withColumn("n", F.row_number().over(by_part)).filter(F.col("n") <= most_docs)
    chosen = few.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= most_docs)
    picks = [r.h for r in chosen.select("h").collect()]  # bounded: most_docs for each language
    texts = hashed.filter(F.col("h").isin(picks)).dropDuplicates(["lang", "h"]).orderBy("lang", "h").select("lang", "text").collect()
    out: dict[str, list[str]] = {}
    for r in texts:
        out.setdefault(r.lang, []).append(r.text)
    return out


def fit(train: DataFrame, text: str = "text", lang: str = "lang", most_docs: int = SAMPLE_DOCS, most_symbols: int = SAMPLE_SYMBOLS) -> Model:
    return build(sample(train, text, lang, most_docs), most_symbols)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the whole of each text alone.

    Letters are lower-cased, anything else parts words. Every language parses the text into the fewest
    phrases that its sample's suffix automaton reads; the one with the fewest, each weighed by the bits that
    name a phrase in its sample, wins, the first by name in a tie. `score` (0 to 1) is the winner's share
    when the languages' bits per letter are taken as log-likelihoods of at most 64 letters. Null texts and
    texts without a letter, as all texts where no language was learned, get 'und' and 0. Repeated rows stay, other columns pass through, those named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make() -> Callable[[list], list[pa.Array]]:
        own, alphabet = Model(*shared.value), Letters()

        def work(texts: list) -> list[pa.Array]:
            langs, scores = judge(own, alphabet, texts)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return add_columns(docs, text, FOUND, make, most=1 << 21)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.filter(fold != 2))
    rows = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).drop("text")
