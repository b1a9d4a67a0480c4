"""Line dedup under edit distance by segment partition, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Edits that two near lines may differ by; shorter lines than LEAST_CHARS are duplicates only if equal.
EDITS, LEAST_CHARS = 2, 24
#: Lines of a key that are compared pair by pair; larger keys are split in rounds, so many at most.
FEW, LEVELS = 32, 4


def shifts(d: int, i: int, edits: int) -> range:
    """Where the i-th segment (from 0) of a line shorter by d may stand in a line within `edits` edits of it.

    It may be shifted by -i to i, and by d - (edits - i) to d + (edits - i): the edits before it and those after it
    both bound the shift.
    """
    return range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)


def line_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(k, gives, takes, h) from (h, line): keys of a line's own segments (gives) and of its other substrings that may
    equal a segment of a line that is no longer and within `edits` edits.

    A line is cut into edits + 1 segments of which the last ones take what is left over. Each line meets the same
    small list of segments and shifts, so that one short expression makes all keys.
    """
    parts = edits + 1
    places = [(d, i, shift) for d in range(parts) for i in range(parts) for shift in shifts(d, i, edits)]
    specs = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("shift"), F.lit(d == 0 and s == 0).alias("gives")) for d, i, s in places))
    rows = lines.withColumn("n", F.length("line")).select("h", "line", "n", F.inline(specs)).withColumn("m", F.col("n") - F.col("d"))
    left = F.col("i") - parts + F.col("m") % parts  # segments before this one that are longer by one, if above 0
    rows = rows.withColumns({"left": left, "size": (F.col("m") / parts).cast("int")})
    start = F.col("i") * F.col("size") + F.greatest("left", F.lit(0)) + F.col("shift")
    rows = rows.withColumns({"start": start, "size": F.col("size") + (F.col("left") >= 0).cast("int")})
    rows = rows.filter((F.col("m") >= 0) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    return rows.select(F.xxhash64("m", "i", F.col("line").substr(F.col("start") + 1, F.col("size"))).alias("k"), "gives", F.lit(True).alias("takes"), "h")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys that several lines have, of which one gives and one takes."""
    same = Window.partitionBy("k")
    marked = keys.withColumns({"_a": F.min("h").over(same), "_b": F.max("h").over(same), "_gives": F.max("gives").over(same), "_takes": F.max("takes").over(same)})
    return marked.filter("_a <> _b and _gives and _takes").drop("_a", "_b", "_gives", "_takes")


def let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def common_start(a: Column, b: Column) -> Column:
    """Number of characters that two strings share at their start, by halving steps."""

    def found(both: Column) -> Column:
        a, b, short = both["a"], both["b"], both["short"]
        steps = F.transform(F.sequence(F.log2(F.greatest(short, F.lit(1))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
        longer = lambda p, s: F.when((p + s <= short) & (a.substr(p + 1, s) == b.substr(p + 1, s)), p + s).otherwise(p)
        return F.aggregate(steps, F.lit(0), longer)

    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: let(F.struct(x["a"].alias("a"), x["b"].alias("b"), F.least(F.length(x["a"]), F.length(x["b"])).alias("short")), found))


def reach(line: Column, other: Column, edits: int) -> Column:
    """Struct (same, far): how many characters two strings share at their start, and how far into the other one `edits`
    edits of the first lead at most: an edit at every difference, each followed by all that is equal.

    All edits and kinds of edits are one expression, as every task reads the plan that holds it.
    """
    moves = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 1), (1, 0), (0, 1))))

    def onward(at: Column) -> Column:
        same = common_start(line.substr(at["x"] + 1, F.length(line)), other.substr(at["y"] + 1, F.length(other)))
        return let(same, lambda n: F.struct((at["x"] + n).alias("x"), (at["y"] + n).alias("y")))

    def moved(at: Column, move: Column) -> Column:
        return F.struct(F.least(at["x"] + move["x"], F.length(line)).alias("x"), F.least(at["y"] + move["y"], F.length(other)).alias("y"))

    more = lambda at: F.transform(moves, lambda move: let(moved(at, move), onward))

    def all_(same: Column) -> Column:
        first = F.array(F.struct(same.alias("x"), same.alias("y")))
        at = F.aggregate(F.array_repeat(F.lit(0), edits), first, lambda found, _: F.array_distinct(F.flatten(F.transform(found, more))))
        return F.struct(same.alias("same"), F.array_max(F.transform(at, lambda one: one["y"])).alias("far"))

    return let(common_start(line, other), all_)


def band_distance(longer: Column, shorter: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters, the first longer by `edits` at most; more than `edits` may come out larger.

    A column of the table of distances is held in a band of 2 * edits + 1 rows around the diagonal, as bits of two
    integers: rows that exceed the one above by one (up) and rows that are one below it (down). A character of
    the shorter string updates all rows at once. The distance along the diagonal of the table's end grows unless
    its bit says that the value was carried over.
    """
    full = F.lit((1 << (2 * edits + 1)) - 1)
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(full)
    apart = F.size(longer) - F.size(shorter)
    bit = lambda row, b, char: F.when(F.get(longer, row) == char, F.lit(1 << b)).otherwise(F.lit(0))

    def step(state: Column, j: Column) -> Column:
        up, down, char = state["up"], state["down"], F.get(shorter, j)
        same = F.lit(0)
        for b in range(2 * edits + 1):
            same = same.bitwiseOR(bit(j + (b - edits), b, char))

        def carried_of(same: Column) -> Column:
            return (same.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down).bitwiseAND(full)

        def turn(carried: Column, more: Column) -> Column:
            moved = F.shiftright(carried, 1)
            return F.struct(
                carried.bitwiseAND(up).bitwiseOR(inverse(moved.bitwiseOR(more))).alias("up"),
                moved.bitwiseAND(more).alias("down"),
                (state["apart"] + 1 - F.call_function("shiftright", carried, apart + edits).bitwiseAND(F.lit(1))).alias("apart"),
            )

        return let(let(same, carried_of), lambda carried: let(down.bitwiseOR(inverse(carried.bitwiseOR(up))), lambda more: turn(carried, more)))

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("up"), F.lit(0).alias("down"), apart.alias("apart"))
    places = F.when(F.size(shorter) > 0, F.sequence(F.lit(0), F.size(shorter) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda state: state["apart"])


def rest(a: Column, b: Column) -> Column:
    """Struct (a, b) of two strings less their common start, reversed."""
    return let(common_start(a, b), lambda same: F.struct(F.reverse(a.substr(same + 1, F.length(a))).alias("a"), F.reverse(b.substr(same + 1, F.length(b))).alias("b")))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are `edits` edits apart at most (2 or more). Common starts and ends are cut off; what is left begins and
    ends with an edit, so one of edits - 1 pieces of its middle must stand in the other one; then the bit-parallel part."""
    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    ordered = F.when(F.length(a) >= F.length(b), F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))

    def hopeful(x: Column) -> Column:
        size = F.length(x["b"])
        begin = lambda j: ((size - 2) * j / (edits - 1)).cast("int")
        stands = F.lit(False)
        for j in range(edits - 1):
            stands = stands | F.contains(x["a"], x["b"].substr(begin(j) + 2, begin(j + 1) - begin(j)))
        return (size < 3) | stands

    verdict = lambda x: let(chars(x["a"]), lambda longer: let(chars(x["b"]), lambda shorter: band_distance(longer, shorter, edits) <= edits))
    cut = let(ordered, lambda x: let(rest(x["a"], x["b"]), lambda y: let(rest(y["a"], y["b"]), lambda z: F.when(hopeful(z), verdict(z)).otherwise(F.lit(False)))))
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, cut).otherwise(F.lit(False))


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, version, at, line, h): the lines that hold more than white space; h identifies a line."""
    rows = docs.select(F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    split = rows.select("doc", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.filter(F.col("line").rlike("[^ \\t-\\r]")).withColumn("h", F.xxhash64("line"))


def place(of: str = "") -> Column:
    return F.struct(*(F.col(of + c).alias(c) for c in ("doc", "version", "at")))


def checked(pairs: DataFrame, edits: int) -> DataFrame:
    """(h, g, of_pivot) of the pairs (h, g, of_pivot, a, b) of which the lines a and b are within `edits` edits of each other."""
    pairs = pairs.groupBy("h", "g").agg(F.max("of_pivot").alias("of_pivot"), F.first("a").alias("a"), F.first("b").alias("b"))
    return pairs.filter(within(F.col("a"), F.col("b"), edits)).select("h", "g", "of_pivot")


#: Where a line of a smaller key leaves the pivot: it takes blocks of 2^bits characters of [head.same, head.far] and of the tail, 2^own
#: being the smallest size that it needs; a and b are the blocks of this key.
SPOT = "struct<own: int, bits: int, a: int, b: int, head: struct<same: int, far: int>, tail: struct<same: int, far: int>>"


def meets(x: Column, y: Column) -> Column:
    """Whether two lines of a smaller key may be near by where they leave its pivot, and meet in this key and no other of that pivot.

    From the start and from the end, the later one to leave must do so within the reach of the other; that place names the block.
    """

    def side(name: str, block: str) -> Column:
        later = F.greatest(x[name]["same"], y[name]["same"])
        return (later <= F.least(x[name]["far"], y[name]["far"])) & (F.call_function("shiftright", later, x["bits"]) == x[block])

    return x.isNull() | (x["bits"] == F.greatest(x["own"], y["own"])) & side("head", "a") & side("tail", "b")


def split_keys(large: DataFrame, edits: int, level: int) -> DataFrame:
    """(k, gives, takes, place, h, line, spot): smaller keys for lines that meet under a large one.

    large: (k, place, h, line, other, near), other being the key's pivot and near whether line is near it. A line shares
    `same` characters with the pivot and reaches `far` into it. If two lines are near, then the one that shares more
    shares no more than the other one reaches; and likewise from the end. So a line that isn't near the pivot
    takes the blocks from its `same` to its `far`, from the start and from the end, and two such lines
    that are near have a pair of blocks in common. A line near the pivot gives its blocks from the start alone; those take them that
    are within twice as many edits of the pivot, as any line near it must be.

    Blocks have several sizes, each eight times the one before. A line takes few blocks of the smallest size that is as long as its own
    reach (2^own), and those of all larger sizes that a line of its key needs; two lines meet at the larger one of theirs.
    """
    base = max(4 - 2 * level, 0)
    ends = F.array(F.struct(F.col("line").alias("a"), F.col("other").alias("b")), F.struct(F.reverse("line").alias("a"), F.reverse("other").alias("b")))
    both = large.withColumn("ends", F.transform(ends, lambda x: reach(x["a"], x["b"], edits)))
    rows = both.withColumn("close", F.when(F.col("near"), F.lit(False)).otherwise(within(F.col("line"), F.col("other"), 2 * edits)))
    rows = rows.select("k", "place", "h", "line", "near", "close", F.get("ends", F.lit(0)).alias("head"), F.get("ends", F.lit(1)).alias("tail"))
    bits = lambda span: F.lit(base) + 3 * F.ceil(F.greatest(F.log2(span + 1) - base, F.lit(0.0)) / 3).cast("int")
    span = lambda at: F.col(f"{at}.far") - F.col(f"{at}.same")
    rows = rows.withColumns({"of_head": bits(span("head")), "of_both": bits(F.greatest(span("head"), span("tail")))})
    rows = rows.withColumn("top", F.max(F.when(F.col("near"), F.col("of_head")).otherwise(F.col("of_both"))).over(Window.partitionBy("k")))
    # Both kinds of keys from one pass, so that no line is compared with its pivot twice.
    way = lambda beside, own: F.transform(F.sequence(F.col(own), F.col("top"), F.lit(3)), lambda b: F.struct(F.lit(beside).alias("beside"), F.col(own).alias("own"), b.alias("bits")))
    apart, beside = F.when(~F.col("near"), way(False, "of_both")), F.when(F.col("near") | F.col("close"), way(True, "of_head"))
    rows = rows.withColumn("way", F.explode(F.flatten(F.array_compact(F.array(apart, beside))))).select("*", "way.beside", "way.own", "way.bits")
    block = lambda at: F.sequence(*(F.call_function("shiftright", F.col(f"{at}.{c}"), F.col("bits")) for c in ("same", "far")))
    rows = rows.withColumn("a", F.explode(block("head"))).withColumn("b", F.explode(F.when(F.col("beside"), F.array(F.lit(0))).otherwise(block("tail"))))
    none = F.struct(F.lit(0).alias("same"), F.lit(0).alias("far"))
    return shared_keys(
        rows.select(
            F.when(F.col("beside"), F.xxhash64("k", "bits", "a", F.lit("near"))).otherwise(F.xxhash64("k", "bits", "a", "b")).alias("k"),
            F.when(F.col("beside"), F.col("near")).otherwise(F.col("bits") == F.col("own")).alias("gives"),
            (~F.col("beside") | ~F.col("near")).alias("takes"),
            "place",
            "h",
            "line",
            F.struct("own", "bits", "a", "b", "head", F.when(F.col("beside"), none).otherwise(F.col("tail")).alias("tail")).cast(SPOT).alias("spot"),
        )
    )


def near_lines(rows: DataFrame, edits: int, few: int = FEW, levels: int = LEVELS) -> DataFrame:
    """(h): the lines that are within `edits` edits of one that first stands before them.

    rows: (k, gives, takes, place, h, line), the lines of each key; two of them may be near if one gives and the other takes.
    In a key of at most `few` lines all such pairs are verified. In a larger one every line meets
    the earliest, the pivot: that decides copies with few edits of one original, however many they are. The
    others meet again in smaller keys (see split_keys), where pairs are verified that may be near by where they leave the pivot; so
    are those of a larger one that few lines give. Keys still larger after `levels` rounds have all such pairs verified.

    Lines have few keys, so rows carry the line itself: a round then has few exchanges.
    """
    found = None
    rows = rows.withColumn("spot", F.lit(None).cast(SPOT))
    columns = ["k", "gives", "takes", "place", "h", "line", "spot"]
    for level in range(levels):
        of_key = Window.partitionBy("k")
        small = (F.count(F.lit(1)).over(of_key) <= few) | F.lit(level == levels - 1)
        if level:
            small |= F.sum(F.col("gives").cast("int")).over(of_key) <= few // 2
        rows = rows.withColumns({"small": small, "first": F.min(F.struct("place", "h", "line")).over(of_key)})
        members = stored(rows.select(*columns, "small", F.when(~F.col("small"), F.col("first.h")).alias("pivot"), F.when(~F.col("small"), F.col("first.line")).alias("other")))
        if members.isEmpty():
            break
        all_ = members.filter("small").select(*columns)
        # Those that give against those that take, so that a key of few that give costs no square; a pair that both give and take comes once.
        other = all_.filter("gives").select("k", F.col("takes").alias("it_takes"), F.col("place").alias("its_place"), F.col("h").alias("g"), F.col("line").alias("its_line"), F.col("spot").alias("its_spot"))
        later = F.col("its_place") < F.col("place")
        once = (F.col("h") != F.col("g")) & (later | ~(F.col("gives") & F.col("it_takes")))
        pairs = all_.filter("takes").join(other.hint("merge"), (all_["k"] == other["k"]) & once & meets(F.col("spot"), F.col("its_spot")))
        ordered = lambda x, y: (F.when(later, F.col(x)).otherwise(F.col(y)), F.when(later, F.col(y)).otherwise(F.col(x)))  # noqa: E731, B023
        (h, g), (a, b) = ordered("h", "g"), ordered("line", "its_line")
        pairs = pairs.select(h.alias("h"), g.alias("g"), F.lit(False).alias("of_pivot"), a.alias("a"), b.alias("b"))
        large = members.filter("not small and h <> pivot").select("k", "place", "h", "line", "pivot", "other")
        # which lines are near their pivot matters below, for those that were decided before, too
        met = stored(checked(pairs.union(large.select("h", "pivot", F.lit(True), "line", "other")), edits))
        near = met.select("h").distinct()
        found = near if found is None else found.union(near)
        if level == levels - 1 or large.isEmpty():
            break
        decided = found.distinct().withColumn("decided", F.lit(True))
        open_ = large.join(decided.hint("merge"), "h", "left").withColumn("open", F.max(F.col("decided").isNull()).over(of_key)).filter("open")
        # Keys of one pivot become one, as copies share several keys.
        large = open_.groupBy("h", "pivot").agg(*(F.first(c).alias(c) for c in ("place", "line", "other")))
        to_pivot = met.filter("of_pivot").select("h", F.col("g").alias("pivot"), F.lit(True).alias("near"))
        large = large.join(to_pivot.hint("merge"), ["h", "pivot"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
        rows = split_keys(large.withColumnRenamed("pivot", "k"), edits, level)
    return rows.select("h").limit(0) if found is None else found.distinct()


def removed_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(doc, version, removed): for each document that loses lines, their numbers from 0 in order.

    Lines follow each other by (doc, hash of the text, number). A line is removed if an equal line stands before
    it, or if it and a line that first stands before it are `least` characters or longer and within `edits`
    edits (insertion, deletion, change of a character). Lines of white space alone are never removed. Rows that
    are equal in doc and text are one document; a null doc stands before all others; null texts have no lines.
    Other columns don't matter. Lines are told apart by 64-bit hashes.

    Equal lines are one before any join. A line of length n is cut into edits + 1 segments, of which one must
    stand unedited in any near line; it is looked up by length, segment number and content, at the places
    where it may stand. Keys that two lines share are the few that go on; see near_lines. Candidate pairs are
    verified by a banded bit-parallel edit distance.
    """
    lines = lines_of(docs, doc, text)
    distinct = lines.groupBy("h").agg(F.min(F.struct("doc", "version", "at", "line")).alias("m"), F.count(F.lit(1)).alias("times"))
    # Both uses of the distinct lines ask for all their columns, so that they read the same shuffle.
    long = distinct.filter((F.length("m.line") >= least) & (F.col("times") > 0)).select("h", "m.line")
    shared = shared_keys(line_keys(long, edits)).groupBy("h").agg(F.collect_list(F.struct("k", "gives", "takes")).alias("keys"))
    # One job from end to end: as two, the lines would be shuffled twice.
    held = distinct.join(shared.hint("merge"), "h", "left").filter("keys is not null or times > 1")
    held = stored(held.select("h", place("m.").alias("place"), F.when(F.col("keys").isNotNull(), F.col("m.line")).alias("line"), "keys"))
    places = held.select("h", "place")
    near = near_lines(held.select(F.inline("keys"), "place", "h", "line"), edits)
    firsts = stored(places.join(near.withColumn("near", F.lit(True)).hint("merge"), "h", "left").select("h", F.col("place").alias("first"), "near"))
    told = lines.select("h", "doc", "version", "at").join(firsts.hint("merge"), "h")
    gone = told.filter((place() != F.col("first")) | F.col("near"))
    return gone.groupBy("doc", "version").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """docs with `text` less its removed lines (see removed_lines); every row and every other column stays."""
    gone = removed_lines(docs, doc, text, edits, least).select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("removed").alias("_removed"))
    rows = docs.withColumns({"_key": F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(-(1 << 63))), "_hash": F.xxhash64(F.col(f"`{text}`").cast("string"))})
    both = rows.join(gone.hint("merge"), (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_version")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    return both.withColumn(text, F.when(F.col("_removed").isNull(), F.col(f"`{text}`")).otherwise(left)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its number of lines and which are removed (numbers from 0, joined by commas)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs)
    counts = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("version"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    counts = counts.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    both = counts.join(gone.hint("merge"), ["doc", "version"], "left")
    return both.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))


OP1_SQL = r"""
with line as (select doc_id, pos, l from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)
  where regexp_matches(l, '[^ \t-\r]')),
d as (select l, min((doc_id, pos)) as first, length(l) as n from line group by l),
c as (select l, first, n from d where n >= 24),
near as (select distinct case when a.first < b.first then b.l else a.l end as l
  from c a join c b on b.n between a.n and a.n + 2 and a.l <> b.l where levenshtein(a.l, b.l) <= 2),
gone as (select x.doc_id, x.pos from line x join d using (l) where (x.doc_id, x.pos) <> d.first or x.l in (select l from near)),
g as (select doc_id, count(*) as n, string_agg(cast(pos as varchar), ',' order by pos) as s from gone group by doc_id)
select t.doc_id, cast(coalesce(len(string_split(t.text, chr(10))), 0) as bigint) as n_lines, coalesce(g.n, 0) as n_removed, coalesce(g.s, '') as removed_lines
from documents t left join g using (doc_id)
"""
