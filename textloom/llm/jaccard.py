"""N-gram Jaccard join with prefix trees, and the groups it makes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, U64, Powers, Windows, WordHashes, give_back, mix, stored, table, tidy
from .components import components

SIZE, PERCENT = 4, 85
#: Of the parts of a set, one of so many and one more need not leave for the exchange: those of fewest shingles.
SPARE = 8
#: Bits of the map that tells which documents' texts may be asked for.
BITS = 1 << 24
#: Shingles of a group of candidates that one task joins; a larger group is split into blocks.
BLOCK = 2_000_000


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any linked set."""
    return -(-percent * n // 100)


class Shingles:
    def __init__(self, size: int):
        self.size, self.hashes, self.powers = size, WordHashes(), Powers()

    def of(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles as sorted hashes; of fewer words, one of all; none without words."""
        words = text.translate(ASCII_LOWER).split() if text else []
        if not words:
            return np.zeros(0, U64)
        return np.unique(Windows(self.hashes.of(words), self.powers).all(min(self.size, len(words))))


def parts_of(end: int, percent: int) -> tuple[int, int]:
    """(parts, spare): into how many parts sets are cut that meet a set of a class that stops before `end`, and how many of
    them need not leave.

    Linked sets a <= b of which the smaller is in that class have (a + b) * (100 - percent) / (100 + percent) shingles at most that
    are in one of them alone. Each spoils a part, so spare + 1 parts at least are the same in both. No parts: only
    equal sets link.
    """
    least = end - 1
    apart = (least + 100 * least // percent) * (100 - percent) // (100 + percent)
    if not apart:
        return 0, 0
    spare = 1 + apart // (SPARE - 1)
    return apart + spare + 1, spare


class Parts:
    """Keys of a set's parts: linked sets have one in common."""

    def __init__(self, percent: int):
        self.percent, self.ends, self.plans = percent, [1], {}

    def plan(self, n: int) -> list[tuple[int, int, int]]:
        """(class, parts, spare) for sets of n shingles: as the larger of two, and as the one whose class is the smaller's.

        Classes are such that linked sets are of one class or of neighbouring ones.
        """
        ends = self.ends
        while ends[-1] <= n:
            ends.append(100 * ends[-1] // self.percent + 1)
        own = bisect_right(ends, n)
        if own not in self.plans:
            self.plans[own] = [(k, *parts_of(ends[k], self.percent)) for k in (own - 1, own) if k]
        return self.plans[own]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """From sorted hashes. A part holds the shingles of a range of hashes, and its key is told by all of them. Parts of fewest
        shingles stay behind, in one order for all sets, so the last part by this order that two sets share leaves from both."""
        if not len(shingles):
            return shingles
        out = []
        sums = np.zeros(len(shingles) + 1, U64)
        np.cumsum(mix(shingles), out=sums[1:])
        for number, parts, spare in self.plan(len(shingles)):
            if parts:
                part = (((shingles >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
                ends = np.cumsum(np.bincount(part, minlength=parts))
                counts = np.diff(ends, prepend=0)
                keys = mix((sums[ends] - sums[ends - counts]) ^ mix(np.arange(parts, dtype=U64) + U64(number << 32)))
                out.append(keys[np.lexsort((keys, counts))[spare:]])
        return np.concatenate(out) if out else shingles[:0]


class Node:
    __slots__ = ("edge", "children", "keys", "fewest", "most", "up", "mark")

    def __init__(self, edge: list[int], n: int, up: Node | None):
        self.edge, self.children, self.keys, self.fewest, self.most, self.up, self.mark = edge, {}, [], n, n, up, -1


class PrefixTree:
    """Sets as paths of shingles in one order; sets that begin alike share the path.

    A path may lack shingles that no other set has; `n` counts them, too. A probe marks the paths to the sets that share
    its first shingles and walks those once for all of them; an edge is read in runs, and a subtree is left when what
    remains can't bring the overlap to the bound.
    """

    RUN = 48

    def __init__(self, percent: int):
        self.percent, self.root, self.leaf, self.probes = percent, Node([], 0, None), {}, 0
        self.root.fewest = 1 << 60

    def add(self, key: int, path: list[int], n: int) -> None:
        node, at = self.root, 0
        while True:
            node.fewest, node.most = min(node.fewest, n), max(node.most, n)
            if at == len(path):
                break
            child = node.children.get(path[at])
            if child is None:
                child = node.children[path[at]] = Node(path[at:], n, node)
                node = child
                break
            edge, same = child.edge, 0
            while same < len(edge) and at + same < len(path) and edge[same] == path[at + same]:
                same += 1
            if same < len(edge):
                upper = Node(edge[:same], child.fewest, node)
                upper.most, upper.children[edge[same]] = child.most, child
                child.edge, child.up = edge[same:], upper
                node.children[path[at]] = child = upper
            node, at = child, at + same
        node.keys.append((key, n))
        self.leaf[key] = node

    def linked(self, path: list[int], n: int, candidates: set[int], skip) -> Iterator[int]:
        """Keys among the candidates whose sets are linked with the probe; skip(key) tells which need no answer."""
        p = self.percent
        inside = set(path).__contains__
        self.probes += 1
        for key in candidates:
            node = self.leaf[key]
            while node is not None and node.mark != self.probes:
                node.mark = self.probes
                node = node.up
        stack = [(self.root, 0, 0)] if candidates else []
        while stack:
            node, depth, shared = stack.pop()
            edge, dead = node.edge, False
            if 100 * min(n, node.most) < p * max(n, node.fewest):
                continue
            for k in range(0, len(edge), self.RUN):
                run = edge[k : k + self.RUN]
                shared += sum(map(inside, run))
                missed = depth + k + len(run) - shared
                # a set of m shingles below shares m - missed at most: 100 * (m - missed) >= p * (n + missed)
                if 100 * (min(node.most, n + missed) - missed) < p * (n + missed):
                    dead = True
                    break
            if dead:
                continue
            depth += len(edge)
            for key, m in node.keys:
                if key in candidates and 100 * shared >= p * (n + m - shared) and not skip(key):
                    yield key
            stack.extend((child, depth, shared) for child in node.children.values() if child.mark == self.probes)


class Groups:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x


def tree_join(keys: list[int], sets: list[list[int]], percent: int, cross: list[bool] | None = None, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the groups of the given sets: as many groups, one link fewer than sets in each.

    sizes: of whole sets, if shingles that one set alone has were left out. With cross, only pairs of a marked and an
    unmarked set are looked at.
    """
    tree, groups, out = PrefixTree(percent), Groups(), []
    sizes = sizes or [len(x) for x in sets]
    holders: dict[int, dict[int, list[int]]] = {}  # shingle to the sets that begin with it, by their group when added
    order = sorted(range(len(keys)), key=lambda k: (bool(cross and cross[k]), sizes[k], keys[k]))
    for k in order:
        own, path, n = keys[k], sets[k], sizes[k]
        first = path[: max(0, len(path) - least_overlap(n, percent) + 1)]
        if cross is None or cross[k]:
            candidates = set()
            for h in first:
                by_group = holders.get(h)
                if by_group:
                    if len(by_group) > 1:  # groups that have met by now are one
                        for g in [g for g in by_group if groups.root(g) != g]:
                            by_group.setdefault(groups.root(g), []).extend(by_group.pop(g))
                    here = groups.root(own)
                    for g, members in by_group.items():
                        if groups.root(g) != here:
                            candidates.update(members)
            skip = lambda other: groups.root(other) == groups.root(own)  # noqa: E731, B023
            for other in tree.linked(path, n, candidates, skip):
                a, b = groups.root(own), groups.root(other)
                if a != b:
                    groups.up[max(a, b)] = min(a, b)
                    out.append((own, other))
        if cross is None or not cross[k]:
            tree.add(own, path, n)
            for h in first:
                holders.setdefault(h, {}).setdefault(groups.root(own), []).append(own)
    return out


def signature(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; 0 stands for the empty one."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) or 1 if len(shingles) else 0


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            counts, names = [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingles.of(text.as_py())
                counts.append(len(found))
                names.append(signature(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.int64())], names=["doc", "n", "set"])

    return run


def _part_keys(size: int, percent: int, buckets: int):
    """The keys of each set's parts, packed by their bucket: 39 bits of each, and whether it is a set's first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, parts = Shingles(size), Parts(percent)
        held, owners, seen, waiting = [], [], set(), 0

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            table_ = np.array(owners, np.int64)
            bucket = (hashes % U64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            rows = []
            for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
                own, keys = owner[part], hashes[part]
                first = np.concatenate(([True], own[1:] != own[:-1]))
                low = (keys >> U64(24)).astype(np.uint8) << np.uint8(1) | first
                rows.append((int(bucket[part[0]]), (keys >> U64(32)).astype(np.uint32).tobytes(), low.astype(np.uint8).tobytes(), table_[own[first]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["bucket", "high", "low", "sets"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                found = shingles.of(text.as_py())
                name = signature(found)
                if not name or name in seen:
                    continue
                seen.add(name)
                keys = parts.of(found)
                if not len(keys):
                    continue
                held.append(keys)
                owners.append(name)
                waiting += len(keys)
                if waiting > 800_000:
                    yield flush()
                    held, owners, seen, waiting = [], [], set(), 0
        if held:
            yield flush()

    return run


def _places(group: pd.DataFrame) -> pd.DataFrame:
    """(at, rep): sets that share a part meet at the smallest of them."""
    low = np.concatenate([np.frombuffer(x, np.uint8) for x in group["low"]])
    hashes = np.concatenate([np.frombuffer(x, np.uint32) for x in group["high"]]).astype(U64) << U64(7) | (low >> np.uint8(1)).astype(U64)
    rep = np.concatenate([np.frombuffer(x, np.int64) for x in group["sets"]])[np.cumsum(low & np.uint8(1), dtype=np.int64) - 1]
    order = np.lexsort((rep, hashes))
    hashes, rep = hashes[order], rep[order]
    start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    at = np.repeat(rep[start], np.diff(np.append(start, len(hashes))))
    return pd.DataFrame({"at": at[at != rep], "rep": rep[at != rep]}).drop_duplicates()


def hopeful_paths(keys: list[int], sets: list[np.ndarray], marks: list[bool], percent: int) -> tuple[list[int], list[list[int]], list[int], list[bool]]:
    """Of sets that meet at a place: those that may link there, as paths of ranks, with their sizes and marks.

    Shingles are ranked by how many of these sets hold them, rarest first, so that what many share for a passage comes
    last. A shingle of one set alone can't be shared and is left out; a set of which too few shingles are left
    links with none, and goes before the others are counted again.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, name = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_inverse=True)
    name = name.astype(np.int32)
    least = -(-percent * sizes // 100)
    while True:
        held = np.bincount(name, minlength=1)
        both = held[name] > 1
        stay = np.bincount(owner[both], minlength=len(sizes)) >= least
        keep = both & stay[owner]
        if keep.all():
            break
        owner, name = owner[keep], name[keep]
    rank = np.empty(len(held), np.int32)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held))
    one_each = np.array(range(len(held)), object)  # copies' paths share the numbers themselves
    order = np.lexsort((rank[name], owner))
    owner, ranks = owner[order], rank[name][order]
    alive, begin = np.unique(owner, return_index=True)
    paths = [one_each[x].tolist() for x in np.split(ranks, begin[1:])] if len(alive) else []
    at = alive.tolist()
    return [keys[k] for k in at], paths, sizes[alive].tolist(), [marks[k] for k in at]


def _join(size: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingles(size)
        keys, sets, marks, seen = [], [], [], set()
        for rep, text, side in zip(group["rep"], group["text"], group["side"], strict=True):
            found = shingles.of(text.encode()) if text is not None else np.zeros(0, U64)
            if int(rep) in seen or signature(found) != rep:  # another row of the same document
                continue
            seen.add(int(rep))
            keys.append(int(rep))
            sets.append(found)
            marks.append(bool(side))
        one_block = group["i"].iloc[0] == group["j"].iloc[0]
        many = sum(map(len, sets))
        keys, paths, sizes, marks = hopeful_paths(keys, sets, marks, percent)
        del sets
        links = tree_join(keys, paths, percent, None if one_block else marks, sizes)
        if 4 * many > BLOCK:
            del paths
            give_back()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def group_similar(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc, n_shingles, component_id) for each row of docs.

    A text's set: its distinct `size`-word shingles (A-Z lower-cased, ASCII white space parts words), or all words
    as one if they are fewer; null texts and texts without words have none and link with nothing. Sets link
    when 100 * intersection >= percent * union; component_id is the smallest doc reachable by links, the
    row's own included; rows of one doc are one node, so repeated rows share a component. A row with a null doc
    has a null component and links nothing. doc must be an integer; other columns don't matter.

    Rows of equal sets are one from the start. Each set is cut into parts by its shingles' hashes, more of them than two
    linked sets can differ in, so that linked sets have a part of several shingles in common (see parts_of). The parts'
    keys leave for a shuffle; sets that share one meet at the smallest set of those that hold it, which
    gathers near copies at one place however many parts they share. Few sets meet that share single shingles
    by chance; a common passage may still bring more of them together. At its place a prefix tree joins the whole sets. Sets in a group already are not compared again, so a group of m copies yields m - 1 links, never all
    pairs. A place with more than BLOCK shingles is split into blocks that are joined two by two.
    """
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = stored(rows.mapInArrow(tidy(_signatures(size)), "doc long, n long, set long"))
    known = signed.filter("doc is not null and n > 0")
    reps = known.groupBy("set").agg(F.min("doc").alias("rep_doc"), F.max("n").alias("n"))
    same = known.join(reps.hint("merge"), "set").select(F.col("doc").alias("a"), F.col("rep_doc").alias("b")).filter("a <> b").distinct()
    links = similar_links(rows.filter("doc is not null"), reps, size, percent)
    roots = components(same.union(links))
    out = signed.select("doc", F.col("n").alias("n_shingles")).join(roots.hint("merge"), signed["doc"] == roots["node"], "left")
    return out.select("doc", "n_shingles", F.coalesce("root", "doc").alias("component_id"))


def among(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The rows whose key some has, and a few others: by a bitmap of BITS hashes, so that the rest need not be shuffled for a join."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    marked = some.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    found = rows.withColumn("_at", at).withColumn("_part", F.bitmap_bucket_number("_at")).join(F.broadcast(marked), "_part")  # BITS / 8 bytes
    place = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def similar_links(rows: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of documents that span the groups of distinct sets: reps has (set, rep_doc, n) for each set.

    Sets are named by signatures while they meet, so no text moves before it is known which sets may link; then one
    document's text stands for each of those.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, min(1 << 20, chars // 16_000_000))
    packed = rows.select("text").mapInArrow(tidy(_part_keys(size, percent, buckets)), "bucket long, high binary, low binary, sets binary")
    met = stored(packed.groupBy("bucket").applyInPandas(_places, "at long, rep long").distinct())
    # Copies of one text meet at one place, not two by two: each pair goes to the smallest set that its smaller one meets.
    nearest = met.union(met.select("rep", "at")).groupBy("at").agg(F.min("rep").alias("least")).withColumn("least", F.least("at", "least"))
    moved = met.join(nearest.hint("merge"), "at")
    places = moved.select(F.col("least").alias("at"), "rep").union(moved.select("least", "at")).distinct()
    sized = places.join(reps.withColumnRenamed("set", "rep").hint("merge"), "rep")
    sizes = sized.groupBy("at").agg(F.sum("n").alias("total"))
    spread = sized.join(sizes.hint("merge"), "at").withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = spread.withColumn("own", mine).withColumn("x", other).select(
        "at", "rep", F.col("rep_doc").alias("doc"), F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), (F.col("own") > F.col("x")).alias("side")
    )
    work = pairs.join(among(rows, sized.select(F.col("rep_doc").alias("doc")), "doc").hint("merge"), "doc").select("at", "i", "j", "rep", "side", "text")
    found = work.groupBy("at", "i", "j").applyInPandas(_join(size, percent), "a long, b long")
    for end in ("a", "b"):
        found = found.join(reps.select(F.col("set").alias(end), "rep_doc").hint("merge"), end).drop(end).withColumnRenamed("rep_doc", end)
    return found.filter("a <> b").distinct()


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document under links of Jaccard 0.85 over 4-word shingles."""
    groups = group_similar(table(spark, sf_dir, "documents"))
    return groups.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


OP6_SQL = r"""
with recursive doc as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + least(4, len(w)) - 1) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from doc where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) as component_id
from doc d left join n using (doc_id) left join reach r on r.a = d.doc_id group by d.doc_id, n.n
"""
