"""Byte-pair merges learned by all executors together: each task of one barrier stage holds a part of the distinct chunks."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Tokens of a block, which is what one step reads at a time.
BLOCK = 1 << 20
#: A pair of ids as one number, and the number of its vocabulary above it.
SHIFT, OF = 24, 56


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums, but for those that are 0; float64 holds sums below 2^53 exactly."""
    distinct, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)
    return distinct[sums != 0], sums[sums != 0]


def pair_keys(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (t[at].astype(np.int64) << SHIFT) | t[at + 1]


class Block:
    """Words as ids, each followed by 0, and how often each word occurs."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray):
        self.ids, self.weight = ids, weight

    def weighted(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs at these places and their words' weights; a pair with a word's end is none."""
        at = at[(at >= 0) & (at < len(self.ids) - 1)]
        at = at[(self.ids[at] != 0) & (self.ids[at + 1] != 0)]
        return pair_keys(self.ids, at), self.weight[np.searchsorted(ends, at)]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*self.weighted(np.arange(len(self.ids) - 1), np.flatnonzero(self.ids == 0)))

    def merge(self, keys: np.ndarray, new: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges pairs (sorted keys) that can't overlap one another; how the counts of pairs change by it."""
        t = self.ids
        may = np.flatnonzero(left[t[:-1]] & right[t[1:]])
        key = pair_keys(t, may)
        nth = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[nth] == key
        p, nth = may[hit], nth[hit]
        twice = np.flatnonzero(t[p] == t[p + 1])
        if len(twice):  # in a run of one id every second place counts, from its begin
            q = p[twice]
            begins = np.concatenate(([True], np.diff(q) != 1))
            odd = (q - q[begins][np.cumsum(begins) - 1]) % 2 == 1
            p, nth = np.delete(p, twice[odd]), np.delete(nth, twice[odd])
        if not len(p):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.flatnonzero(t == 0)
        before, lost = self.weighted(np.unique(np.concatenate((p - 1, p, p + 1))), ends)
        keep = np.ones(len(t), bool)
        keep[p + 1] = False
        t[p] = new[nth]
        self.ids = t[keep]
        q = p - np.arange(len(p))
        after, won = self.weighted(np.unique(np.concatenate((q - 1, q))), ends - np.searchsorted(p, ends))
        return summed(np.concatenate((before, after)), np.concatenate((-lost, won)))


def block_of(chunk: pa.Array, n: pa.Array, ids_of_bytes: np.ndarray) -> Block:
    """A chunk's bytes are read from Arrow's buffer."""
    chunk = chunk.cast(pa.large_binary())
    at = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
    data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    ids = np.zeros(len(data) + len(chunk), ids_of_bytes.dtype)
    ids[np.arange(len(data)) + np.repeat(np.arange(len(chunk)), np.diff(at))] = ids_of_bytes[data]
    return Block(ids, n.to_numpy(zero_copy_only=False).astype(np.int64))


def blocks_of(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray]) -> list[list[Block]]:
    """Of rows (k, chunk, n) the blocks of each vocabulary k, whose ids of bytes are tables[k]."""
    out: list[list[Block]] = [[] for _ in tables]
    held: list[list[Block]] = [[] for _ in tables]

    def close(k: int) -> None:
        if held[k]:
            out[k].append(Block(np.concatenate([b.ids for b in held[k]]), np.concatenate([b.weight for b in held[k]])))
            held[k] = []

    for batch in batches:
        for k in pc.unique(batch.column(0)).to_pylist():
            own = batch.filter(pc.equal(batch.column(0), k))
            held[k].append(block_of(own.column(1), own.column(2), tables[k]))
            if sum(len(b.ids) for b in held[k]) >= BLOCK:
                close(k)
    for k in range(len(tables)):
        close(k)
    return out


class Chooser:
    """Which pairs are merged, by the counts over all tasks; every task comes to the same answer."""

    def __init__(self, sizes: list[int], vocab_size: int, min_frequency: int, longest: int | None):
        self.size, self.vocab_size, self.least, self.longest = sizes, vocab_size, max(1, min_frequency), longest
        self.count: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []
        self.merges: list[tuple[int, int]] = []

    def change(self, keys: np.ndarray, n: np.ndarray) -> None:
        for k, d in zip(keys.tolist(), n.tolist(), strict=True):
            now = self.count.pop(k, 0) + d
            if now:
                self.count[k] = now
            if d > 0:
                heapq.heappush(self.heap, (-now, k))

    def batch(self) -> list[tuple[int, int]]:
        """The next merges, the most frequent first, ties by the lower ids, as far as these counts tell them.

        A pair (c, d) is told by them if no (a, b) merged before it in the batch has d = a or c = b. Its count is then
        as before, that of older pairs has not grown, and a new pair (x, ab) or (ab, y) is no more frequent than (x, a)
        or (b, y), which come after (c, d), and has higher ids than they. Of a run of one id, (aa, aa) may be more
        frequent than what comes after (a, a), so that pair ends the batch.
        """
        out: list[tuple[int, int]] = []
        lefts, rights = set(), set()
        while self.heap and len(self.size) < self.vocab_size:
            n, k = self.heap[0]
            now = self.count.get(k, 0)
            if now != -n:
                heapq.heappop(self.heap)
                if now:
                    heapq.heappush(self.heap, (-now, k))
                continue
            a, b = k >> SHIFT, k & ((1 << SHIFT) - 1)
            if now < self.least or b in lefts or a in rights:
                break
            heapq.heappop(self.heap)
            if self.longest and self.size[a] + self.size[b] > self.longest:
                continue
            lefts.add(a)
            rights.add(b)
            out.append((a, b))
            self.size.append(self.size[a] + self.size[b])
            if a == b:
                break
        self.merges += out
        return out


def merges_of(counted: DataFrame, ids_of_bytes: list[int], sizes: list[int], wanted: list[tuple[int, int | None]], min_frequency: int) -> list[list[tuple[int, int]]]:
    """The merges, in order, of each vocabulary k = 0, 1, ... of counted chunks (k, chunk, n), learned side by side.

    `wanted` has its size and how many bytes a token has at most; ids are 1 and higher, `sizes` has the bytes of those there are.
    Distinct chunks are dealt over as many tasks as run at once and stay there; tasks tell each other how the counts of pairs
    change. The driver gets the merges alone. Tasks must run at the same time, so dynamic allocation has to be off.
    """
    kinds = [np.uint16 if size <= 1 << 16 else np.uint32 for size, _ in wanted]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        choosers = [Chooser(list(sizes), size, min_frequency, longest) for size, longest in wanted]

        def exchange(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            none = [np.empty(0, np.int64)]
            keys, n = summed(np.concatenate([x | (k << OF) for k, x, _ in parts] + none), np.concatenate([d for *_, d in parts] + none))
            said = context.allGather(base64.b64encode(zlib.compress(np.concatenate((keys, n)).tobytes(), 1)).decode())
            each = [np.frombuffer(zlib.decompress(base64.b64decode(m)), np.int64).reshape(2, -1) for m in said]
            keys, n = summed(*np.concatenate(each, axis=1))
            for k, chooser in enumerate(choosers):
                own = keys >> OF == k
                chooser.change(keys[own] & ((1 << OF) - 1), n[own])

        blocks = blocks_of(batches, [np.array(ids_of_bytes, kind) for kind in kinds])
        exchange([(k, *b.counts()) for k, own in enumerate(blocks) for b in own])
        while True:
            first = [len(c.size) for c in choosers]
            chosen = [c.batch() for c in choosers]
            if not any(chosen):
                break
            parts = []
            for k, batch in enumerate(chosen):
                if not batch:
                    continue
                keys = np.array([(a << SHIFT) | b for a, b in batch], np.int64)
                order = np.argsort(keys)
                left, right = np.zeros(wanted[k][0], bool), np.zeros(wanted[k][0], bool)
                left[[a for a, _ in batch]] = right[[b for _, b in batch]] = True
                parts += [(k, *b.merge(keys[order], (first[k] + order).astype(kinds[k]), left, right)) for b in blocks[k]]
            exchange(parts)
        if context.partitionId() == 0:
            rows = [(k, nth, a, b) for k, c in enumerate(choosers) for nth, (a, b) in enumerate(c.merges)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["k", "nth", "a", "b"])

    core = counted.sparkSession.sparkContext._jsc.sc()
    slots = max(1, core.maxNumConcurrentTasks(core.resourceProfileManager().defaultResourceProfile()))
    found = counted.select("k", "chunk", "n").repartition(slots).mapInArrow(learn, "k long, nth long, a long, b long", barrier=True).collect()
    out: list[list[tuple[int, int]]] = [[] for _ in wanted]
    for r in sorted(found):
        out[r.k].append((r.a, r.b))
    return out
