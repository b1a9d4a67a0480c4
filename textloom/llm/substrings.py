"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Powers, Windows, WordHashes, mix, table, winnow

LENGTH = 35
#: Characters of text for each bucket of windows.
PER_BUCKET = 16_000_000


def levels(length: int) -> list[int]:
    """Window lengths, each at most twice the one before, the last the asked one."""
    out = [length]
    while out[0] > 9:
        out.insert(0, -(-out[0] // 2))
    return out[-3:] if len(out) > 3 else out


def offsets(short: int, long: int, length: int) -> list[int]:
    """Places of a `short` window in `long` ones such that each `length` window that holds it holds one of these."""
    spare = length - short
    out, at = [], 0
    while at < long - short:
        out.append(at)
        at += length - long + 1
    out.append(long - short)
    return [x for x in out if x <= spare]


def split(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


#: Windows that a task compares among themselves before it asks the buckets; marks a window without an owner.
UNIT, NOBODY = 1_000_000, 0xFFFFFFFF
PLACES = "doc long, version int, starts binary"


def places(owner: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[list, list, list]:
    """Each owner's starts as packed 32-bit integers."""
    if not len(owner):
        return [], [], []
    order = np.argsort(owner, kind="stable")
    owner, starts = owner[order], starts[order].astype(np.int32)
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)])).tolist()
    own = keys[owner[first[:-1]]]
    return own[:, 0].tolist(), own[:, 1].tolist(), [starts[i:j].tobytes() for i, j in zip(first, first[1:], strict=False)]


def again(hashes: np.ndarray, more: list[np.ndarray], nobody: np.ndarray) -> list[np.ndarray]:
    """Which windows stand twice or more, by each of the longer windows around them that fits (not 0)."""
    _, number = np.unique(hashes, return_inverse=True)
    weight = 1 + nobody.astype(np.int64)
    out = []
    for w in more:
        _, at = np.unique((number.astype(U64) << U64(32)) | w, return_inverse=True)
        out.append((np.bincount(at, weight)[at] > 1) & (w != 0) & ~nobody)
    return out


class Unit:
    """Windows of many texts on their way to the buckets of their hashes.

    A window that stands twice in the unit is repeated; it goes to its bucket once, without an owner, so that
    a window of a third of all texts is one row from each unit.
    """

    NAMES = ("bucket", "h", "w", "at", "owner", "keys", "doc", "version", "starts")
    TYPES = (pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int32(), pa.binary())
    SCHEMA = "bucket long, h binary, w binary, at binary, owner binary, keys binary, doc long, version int, starts binary"

    def __init__(self, buckets: int, around: list[int]):
        self.buckets, self.around = buckets, around
        self.clear()

    def clear(self) -> None:
        self.keys, self.parts, self.held = [], [], 0

    def add(self, doc: int, version: int, hashes: np.ndarray, at: np.ndarray, more: list[np.ndarray]) -> None:
        self.keys.append((doc, version))
        self.parts.append((hashes, at, *more))
        self.held += len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return self.clear()
        keys = np.array(self.keys, np.int64)
        owner = np.repeat(np.arange(len(keys)), [len(p[1]) for p in self.parts])
        hashes, at, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        whole = hashes.copy()
        for w in more:
            whole = mix(whole ^ w)
        _, first, number, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        twice = count[number] > 1
        known = [np.flatnonzero(twice & (w != 0)) for w in more]
        done = places(np.concatenate([owner[k] for k in known]), np.concatenate([at[k] - b for k, b in zip(known, self.around, strict=True)]), keys)
        ask = np.concatenate((np.flatnonzero(~twice), first[count > 1]))
        whose = np.where(twice[ask], NOBODY, owner[ask])
        bucket = (hashes[ask] % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                own, local = np.unique(whose[part], return_inverse=True)
                local = np.where(whose[part] == NOBODY, NOBODY, local).astype(np.uint32)
                packed = [np.concatenate([w[ask[part]].astype(np.uint32) for w in more])]
                rows.append((int(bucket[part[0]]), hashes[ask[part]].tobytes(), packed[0].tobytes(), at[ask[part]].astype(np.int32).tobytes(), local.tobytes(), keys[own[own != NOBODY]].tobytes(), None, None, None))
        rows += [(d % self.buckets, None, None, None, None, None, d, v, x) for d, v, x in zip(*done, strict=True)]
        self.clear()
        for k in range(0, len(rows), 500):
            columns = zip(*rows[k : k + 500], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.TYPES, strict=True)], names=self.NAMES)


def _decide(around: list[int]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        done = group[group["starts"].notna()]
        out = ([*done["doc"].astype("int64")], [*done["version"].astype("int32")], [*done["starts"]])
        asked = group[group["h"].notna()]
        if len(asked):
            hashes = np.concatenate([np.frombuffer(x, U64) for x in asked["h"]])
            at = np.concatenate([np.frombuffer(x, np.int32) for x in asked["at"]])
            more = [np.frombuffer(x, np.uint32).reshape(len(around), -1) for x in asked["w"]]
            more = [np.concatenate([m[k] for m in more]).astype(U64) for k in range(len(around))]
            keys, owners, base = [], [], 0
            for k, o in zip(asked["keys"], asked["owner"], strict=True):
                keys.append(np.frombuffer(k, np.int64).reshape(-1, 2))
                o = np.frombuffer(o, np.uint32).astype(np.int64)
                owners.append(np.where(o == NOBODY, -1, o + base))
                base += len(keys[-1])
            owner, keys = np.concatenate(owners), np.concatenate(keys)
            found = again(hashes, more, owner < 0)
            kept = [np.flatnonzero(f) for f in found]
            more_out = places(np.concatenate([owner[k] for k in kept]), np.concatenate([at[k] - b for k, b in zip(kept, around, strict=True)]), keys)
            out = tuple(a + b for a, b in zip(out, more_out, strict=True))
        return pd.DataFrame({"doc": np.array(out[0], np.int64), "version": np.array(out[1], np.int32), "starts": out[2]})

    return run


def repeated(asked: DataFrame, around: list[int]) -> DataFrame:
    """(doc, version, starts): packed starts of the windows that are repeated."""
    found = asked.groupBy("bucket").applyInPandas(_decide(around), PLACES)
    return found.groupBy("doc", "version").agg(F.collect_list("starts").alias("starts"))  # of one text: as long as it at most


def _anchors(short: int, middle: int, length: int, buckets: int):
    """The winnowed short windows of each text, with the middle windows around them."""
    around = offsets(short, middle, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, unit = WordHashes(), Powers(), Unit(buckets, around)
        for batch in batches:
            for text, doc, version in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = split(text.as_py())
                if len(words) < length:
                    continue
                windows = Windows(hashes.of(words), powers)
                first = windows.all(short)
                at = winnow(first, length - short + 1)
                more = []
                for before in around:
                    fits = (at >= before) & (at - before + middle <= len(words))
                    w = windows.at(np.where(fits, at - before, 0), middle) >> U64(32)
                    more.append(np.where(fits, np.maximum(w, U64(1)), U64(0)))
                unit.add(doc, version, first[at], at, more)
                if unit.held > UNIT // 4:
                    yield from unit.flush()
        yield from unit.flush()

    return run, around


def starts_of(chunks: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(chunks or []), np.int32).astype(np.int64)


def _final(middle: int, length: int, buckets: int):
    """The windows of full length that hold a repeated middle window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, unit = WordHashes(), Powers(), Unit(buckets, [0])
        for batch in batches:
            for text, doc, version, chunks in zip(batch["text"].cast(pa.binary()), *(batch[k].to_pylist() for k in ("key", "version", "starts")), strict=True):
                words, begin = split(text.as_py()), starts_of(chunks)
                windows = Windows(hashes.of(words), powers)
                wanted = np.zeros(len(words) + 2, np.int32)
                np.add.at(wanted, np.maximum(begin - (length - middle), 0), 1)
                np.add.at(wanted, np.minimum(begin, len(words) - length) + 1, -1)
                at = np.flatnonzero(np.cumsum(wanted) > 0)
                at = at[at <= len(words) - length]
                unit.add(doc, version, windows.at(at, length), at, [np.ones(len(at), U64)])
                if unit.held > UNIT:
                    yield from unit.flush()
        yield from unit.flush()

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, chunks in zip(batch["text"].cast(pa.binary()), batch["starts"].to_pylist(), strict=True):
                words, begin = split(text.as_py()), np.unique(starts_of(chunks))
                covered = np.zeros(len(words) + 1, np.int32)
                covered[begin] += 1
                covered[begin + length] -= 1
                gone = np.cumsum(covered)[:-1] > 0
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, n_words, n_removed, kept_text) for each row: its text without the words of repeated windows.

    A window is `length` consecutive words (ASCII white space parts them) of one row; it is repeated if the
    same words also start anywhere else, in the row itself or in another, a repeated row included. All
    windows are judged on the input. Null and empty texts have no words and an empty result; so nothing is
    removed from texts of fewer words. Columns other than doc and text don't matter.

    Levels: the length is halved until it is 9 words at most (35, 18, 9). At the first level stand the
    winnowed windows alone: every full window holds at least one, chosen by content, so all of its copies
    hold the same one. Those that are repeated grow to twice the length around the same place, those that
    are repeated still to twice that again, at last at every start where a full window may stand. The first
    two levels meet in the buckets of the shortest windows' hashes, the last in those of its own; a
    window must be repeated at all levels, the last by a 64-bit hash.
    """
    steps = [*levels(length)[:2], length]
    size = docs.agg(F.sum(F.length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    buckets = max(64, min(1 << 20, size // PER_BUCKET))
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = rows.withColumns({"key": F.coalesce("doc", F.lit(-(1 << 63))), "version": F.shiftright(F.xxhash64("doc", "text"), 32).cast("int")})
    run, around = _anchors(steps[0], steps[1] if len(levels(length)) > 1 else steps[0], length, buckets)
    texts = keyed.select("text", "key", "version")
    first = repeated(texts.mapInArrow(run, Unit.SCHEMA), around)
    first = first.select(F.col("doc").alias("found"), F.col("version").alias("found_version"), "starts")
    own = (F.col("key") == F.col("found")) & (F.col("version") == F.col("found_version"))
    # Both joins read the same columns, so one shuffle of the texts serves them.
    candidates = keyed.join(first.hint("merge"), own)
    last = repeated(candidates.mapInArrow(_final(steps[1] if len(levels(length)) > 1 else steps[0], length, buckets), Unit.SCHEMA), [0])
    last = last.select(F.col("doc").alias("found"), F.col("version").alias("found_version"), "starts")
    both = keyed.join(last.hint("merge"), own, "left")
    return both.mapInArrow(_remove(length), "doc long, n_words long, n_removed long, kept_text string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 35-word windows."""
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with doc as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select r, i, list_slice(w, i, i + 34) as g from (select r, w, unnest(range(1, len(w) - 33)) as i from doc where len(w) >= 35)),
twice as (select g from win group by g having count(*) > 1),
gone as (select distinct r, k from (select r, unnest(range(i, i + 35)) as k from win semi join twice using (g))),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from doc),
kept as (select r, string_agg(x, ' ' order by k) as s from word anti join gone using (r, k) group by r),
n as (select r, count(*) as c from gone group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n.c, 0) as n_removed, sha256(coalesce(kept.s, '')) as kept_sha256
from doc d left join kept using (r) left join n using (r)
"""
