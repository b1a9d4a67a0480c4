import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import patterns, text
from textloom.operators import choose, html, lines, split, tokens
from textloom.plans import queries
from textloom.sources import http


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw,want",
    [("C3A9", ("é", "utf-8")), ("93E29481", ("“â”�", "cp1252")), ("818D8F909D", ("�" * 5, "cp1252")), ("EDA080", None), ("C080", None)],
)
def test_decode(spark, raw, want):
    got = one(spark, bytearray(bytes.fromhex(raw)), text.decode_bytes, "binary")
    assert tuple(got) == (want or (bytes.fromhex(raw).decode("cp1252", "replace"), "cp1252"))


@pytest.mark.parametrize("line", ["2023", "F-12", "Page 21", "- 12 -", "12.", "pg. 3", "S5", "-5", "١٢", "ſ-1", "iv", "Table of Contents", "TABLE OF CONTENTS ..... 3"])
def test_layout_lines_go(spark, line):
    assert one(spark, line, lambda c: lines.reason(c, F.lit(1), 80, 5)) is not None


@pytest.mark.parametrize("line", ["(1)", "12345", "$45", "page", "mix", "xxxxxx", "1,234", "Page i", "12 3", "See Table of Contents", "Table of Contents Page 3"])
def test_text_lines_stay(spark, line):
    assert one(spark, line, lambda c: lines.reason(c, F.lit(1), 80, 5)) is None


def test_headers_blanks_and_ends(spark):
    body = "\n".join(["h" * 79] * 6 + ["k" * 79] * 5 + ["w" * 80] * 6 + ["", "", "b", ""])
    got = one(spark, body, lines.clean_in_row)
    assert got.header == 6 and got.text == "\n".join(["k" * 79] * 5 + ["w" * 80] * 6 + ["", "b"])


def test_clean_in_row_equals_lines(spark):
    rng = random.Random(3)
    docs = [(k, "\n".join(rng.choice(["", " ", "a", "b c", "iv", "12", "head", "table of contents", "x" * 90]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    by_row = {r.doc_id: r.t for r in df.select("doc_id", lines.clean_in_row(F.col("text"))["text"].alias("t")).collect()}
    kept = lines.joined_lines(lines.collapse_blanks(lines.marked_lines(df).filter("reason is null")))
    by_line = {r.doc_id: r.text for r in kept.collect()}
    assert all(by_row[k] == by_line.get(k, "") for k, _ in docs)


def test_markup(spark):
    assert html.text_of("<p>a</p>b") == "\nab"
    assert html.text_of("<div style='display : NONE'>x<div>y</div>z</div>k") == "k"
    assert html.text_of("<table><tr><td>1</td><td>2</td></tr></table>") == "\n\n 1 2"
    assert html.text_of("net <ix:nonFraction>3,232,193</ix:nonFraction> for&#160;the &#8217;x") == "net 3,232,193 for\xa0the ’x"
    assert html.text_of("<noscript>x</noscript><script>y</script>z<br>w") == "z\nw"
    assert one(spark, None, html.parse_markup).text is None


def test_references_need_a_semicolon():
    """A text cut within a reference keeps what is left of it, as in the SQL."""
    assert html.text_of("<p>a &amp; b&amp</p>") == "\na & b&amp"
    assert html.text_of("&&amp;am&copy &copy; &ampx; &#38 &#38; &#x26;") == "&&am&copy © &ampx; &#38 & &"
    assert html.text_of('<div style="display:none">&amp</div><a href="?a=1&copy=2">x</a><xmp>a & b</xmp>') == "xa & b"


def test_wrapper(spark):
    wrapped = "<DOCUMENT>\n<TYPE>10-K\n<TEXT>body</text>tail</TEXT></DOCUMENT>"
    assert tuple(one(spark, wrapped, text.strip_wrapper)) == ("body</text>tail", True)
    late = " " * 600 + wrapped
    assert tuple(one(spark, late, text.strip_wrapper)) == (late, False)
    assert one(spark, "<document> <type>x<text>rest", text.strip_wrapper).html == "rest"


def test_stems_and_numbers(spark):
    stem = "0001493761_000104432198000034_13D"
    assert tuple(one(spark, stem, text.stratum)) == ("13D", 2098) and one(spark, stem, text.era) == "2019+"
    assert tuple(one(spark, "notes", text.stratum)) == ("OTHER", 0) and one(spark, "notes", text.era) == "pre-2019"
    assert one(spark, "CIK0000012", text.padded_cik) == "0000000012" and one(spark, "x1", text.padded_cik) is None
    assert one(spark, "\x1c\u0085\xa0a​", text.strip) == "a​"
    assert one(spark, "‘’‚‛“”„–—―‑…′″§", text.plain_punctuation) == "''''\"\"\"----...'\"§"


def test_pattern_counts(spark):
    """Counted by hand."""
    body = (
        "Item 5. The Reporting Person holds 1,234,567 shares (CUSIP No. 88160R101), or 4.25% of the class and 10 % of votes, bought at $3.50 a share\n"
        "for $1,200,000 under Rule 13d-1(a) and Section 13(d). See § 240.13d-1. The rate is 150 bps."
    )
    both = patterns.CENSUS | patterns.COSTS
    got = spark.createDataFrame([(body,)], "x string").select(*patterns.counts(F.col("x"), both)).first()
    want = {
        "dollar_amount": 2, "percentage": 2, "basis_points": 1, "cusip_keyword": 1, "cusip_like": 1, "rule_section_citation": 3, "section_symbol": 1, "big_number": 2,
    }
    assert {k: v for k, v in got.asDict().items() if v} == want


def test_patterns_equal_python(spark):
    rng = random.Random(1)
    parts = ["$1,234.56", "$ 5", "4.25 %", "150bps", "Basis  Points", "88160R101", "ABCDEFGHI", "Rule 206(4)-1", "§251(h)", "us-gaap:Cash", "<ix:x", "1,234,567", "RevenueFromContractWith", "$ABC", "٣%", " "]
    rows = [("".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(8)),) for _ in range(200)]
    both = patterns.CENSUS | patterns.COSTS
    for r in spark.createDataFrame(rows, "x string").select("x", *patterns.counts(F.col("x"), both)).collect():
        for n, p in both.items():
            assert r[n] == len(re.findall(p, r.x, re.I if n in patterns.ANY_CASE else 0)), (n, r.x)


def test_chunks(spark):
    assert "|".join(one(spark, "it's $1,234.56  now", tokens.chunks)) == "it|'s| $|1|,|234|.|56| | now"
    got = one(spark, "Revenues of $3,232,193 up 4.25%  x", lambda c: tokens.chunks(c, "digits"))
    assert "|".join(got) == "Revenues| of| $3,232,193| up| 4.25%|  |x"


def test_training_toy():
    model = tokens.train([("ab", 1), (" ab", 1), (" cd", 2), (" ef", 2)], 300, 2)
    assert [model.bytes[i] for i in range(257, len(model.bytes))] == [b"ab", b"cd", b"ef", b" cd", b" ef"]
    assert tokens.train([("ab", 1)], 300, 2).merges == []


def test_training_equals_library(spark):
    tk = pytest.importorskip("tokenizers")
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    ours = tokens.train_on(spark.createDataFrame([(t,) for t in rows], "text string"), 500)
    own = tk.Tokenizer(tk.models.BPE())
    own.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.train_from_iterator(rows, tk.trainers.BpeTrainer(vocab_size=500, min_frequency=2, special_tokens=[tokens.SPECIAL], initial_alphabet=tk.pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    count = tokens.counter_of(ours)
    assert own.get_vocab_size() == len(ours.bytes)
    assert all(count(t) == len(own.encode(t).ids) for t in rows)


def test_executors_learn_what_one_process_learns(spark):
    """Runs of one letter, ties, bounds of length and frequency; distinct chunks don't come to the driver."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "aa", "aaa", "b", "ab", " ", "é", "\n", "7", "c" * 40]) for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    sizes = {"gpt2": 280, "digits": 270, "line": 285}
    got = tokens.train_each(docs, sizes, 3)
    for mode, size in sizes.items():
        counted = sorted((r.chunk, r.n) for r in tokens.chunk_counts(docs, mode).collect())
        want = tokens.train(counted, size, 3, tokens.LINE_TOKEN_MOST if mode == "line" else None)
        assert got[mode].merges == want.merges and got[mode].bytes == want.bytes
    assert tokens.train_on(docs.limit(0), 300).merges == [] and tokens.train_on(docs.limit(1), 300, 10**6).merges == []


def test_batches_of_merges_are_those_made_one_by_one():
    import numpy as np
    import pyarrow as pa
    import regex

    from textloom.operators import learn

    for seed in range(5, 12):
        rng = random.Random(seed)
        texts = ["".join(rng.choice(["a", "aa", "aaa", "b", "ab", " ", "é", "\n", "7", "c" * 40]) for _ in range(60)) for _ in range(80)]
        for mode, size in {"gpt2": 330, "digits": 300, "line": 900}.items():
            longest = tokens.LINE_TOKEN_MOST if mode == "line" else None
            counted = sorted(Counter(c for t in texts for c in regex.findall(tokens.CHUNKS[mode], t)).items())
            rows = pa.table({"k": [0] * len(counted), "chunk": [c for c, _ in counted], "n": [n for _, n in counted]}).to_batches(max_chunksize=100)
            blocks = learn.blocks_of(iter(rows), [np.array(tokens.ID, np.uint16)])[0]
            chooser = learn.Chooser([13, *[1] * 256], size, 3, longest)
            for b in blocks:
                chooser.change(*b.counts())
            while batch := chooser.batch():
                pairs = sorted((a << learn.SHIFT | b, len(chooser.size) - len(batch) + k) for k, (a, b) in enumerate(batch))
                ends = [np.isin(np.arange(size), x) for x in zip(*batch, strict=True)]
                for b in blocks:
                    chooser.change(*b.merge(np.array([k for k, _ in pairs]), np.array([n for _, n in pairs], np.uint16), *ends))
            assert chooser.merges == tokens.train(counted, size, 3, longest).merges


def test_training_collects_merges_alone(spark, monkeypatch):
    collected = []
    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        kept = getattr(type(spark.range(0)), name)
        monkeypatch.setattr(type(spark.range(0)), name, lambda self, *a, f=kept, **b: collected.append(self.columns) or f(self, *a, **b))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(tokens.train_on(docs, 300).merges) == 43
    assert collected and not any("chunk" in c for c in collected)


def test_model_round_trip(spark, tmp_path):
    model = tokens.train([(" the", 5), (" then", 3), ("ab", 2)], 270)
    tokens.save(spark, model, str(tmp_path), {"name": "m"})
    again, meta = tokens.load(spark, str(tmp_path))
    assert again.merges == model.merges and meta == {"name": "m", "pretokenizer": "gpt2"}


def test_list_digest_sees_every_name(spark):
    digest = lambda ids: tuple(split.list_digest(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id").first())
    ids = [*range(0, 3000, 7), 5000]
    assert digest(ids) == digest(ids[::-1]) and digest(ids)[0] == len(ids)
    assert len({digest(ids), digest(ids[1:]), digest(ids[:-1]), digest([i for i in ids if i != 1400]), digest([*ids, 999])}) == 5
    assert digest([])[0] == 0


def test_train_list_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    train = queries.train_eval_split(spark, sf).filter("split = 'train'").count()
    assert queries.train_list_digest(spark, sf).first()["names"] == train


def test_every_pattern_is_counted_in_tokens(spark):
    import regex

    body = "$1,234.56 4.25% 150bps 88160R101 Rule 206(4)-1 §251(h) 1,234,567 RevenueFromContractWith $7"
    rows = spark.createDataFrame([(body,)], "x string").select(F.posexplode(patterns.matches(F.col("x"))).alias("i", "m"))
    sample = tokens.pattern_sample(rows.select("m.pattern", "m.found", F.col("i").cast("string").alias("key")))
    model = tokens.train([(" the", 5), ("12", 3), (" $", 2)], 300)
    got = {(r.pattern, r.tokenizer): r for r in tokens.pattern_tokens(sample, {"gpt2": (model, "gpt2"), "line": (model, "line")}).collect()}
    assert {p for p, _ in got} == set(patterns.COSTS) and len(got) == 2 * len(patterns.COSTS)
    for (name, mode), r in got.items():
        found = [" " + m for m in re.findall(patterns.COSTS[name], body, re.I if name in patterns.ANY_CASE else 0)]
        n = [sum(len(model.encode(c.encode())) for c in regex.findall(tokens.CHUNKS[mode], s)) for s in found]
        assert r.instances == len(n) and r.mean_tokens == pytest.approx(sum(n) / len(n), abs=0.006)
        assert r.mean_bytes == pytest.approx(sum(len(s.encode()) for s in found) / len(n))
    assert queries.QUERIES["pattern_token_costs"](spark, "/root/testdata/sf0.001").select("pattern").distinct().count() == len(patterns.COSTS)


def test_costs_count_every_match(spark):
    """3,000 matches of two lengths, of which a sample of 2,000 holds the shares only by luck."""
    found = spark.range(3000).select(F.lit("p").alias("pattern"), F.when(F.col("id") < 1, "wwww").otherwise("x").alias("found"))
    model = tokens.train([("zz", 5)], 257)
    r = tokens.pattern_tokens(found, {"gpt2": (model, "gpt2")}).first()
    assert (r.instances, r.mean_bytes, r.mean_tokens) == (3000, pytest.approx(2 + 3 / 3000), 2.0)
    sf, rows = "/root/testdata/sf0.001", queries.QUERIES["pattern_token_costs"](spark, "/root/testdata/sf0.001").collect()
    lines = queries.filing_lines(spark, sf).select(F.explode(patterns.matches(F.col("line"))).alias("m")).select("m.pattern", F.octet_length("m.found").alias("b"))
    sums = {x["pattern"]: (x.n, x.b / x.n + 1) for x in lines.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect()}
    assert max(n for n, _ in sums.values()) > 2000
    assert all((r.instances, r.mean_bytes) == (sums[r.pattern][0], pytest.approx(sums[r.pattern][1], rel=1e-12)) for r in rows)


def test_pattern_sample_ranks_few_rows(spark):
    """The same matches as by ranking all; rows that reach one task's window are about as many as are taken."""
    from pyspark.sql import Window

    found = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("pattern"), F.lit("x").alias("found"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    found = found.union(spark.createDataFrame([("r", "y", str(k)) for k in range(3)], "pattern string, found string, key string"))
    order = Window.partitionBy("pattern").orderBy(F.md5(F.concat(F.lit("42:"), F.col("key"))), "key")
    want = {(r.pattern, r.key) for r in found.withColumn("nth", F.row_number().over(order)).filter("nth <= 2000").collect()}
    sample = tokens.pattern_sample(found)
    rows = sample.collect()
    assert len(rows) == len(want) == 4003 and {(r.pattern, r.key) for r in rows} == want
    assert {(r.pattern, r.instances) for r in rows} == {("p", 20000), ("q", 40000), ("r", 3)}
    kept = []

    def visit(node):
        if node.nodeName() == "Window":
            kept.append(node.child())
        for k in range(node.children().size()):
            visit(node.children().apply(k))

    visit(sample._jdf.queryExecution().optimizedPlan())
    top = kept[0].children().apply(0) if kept[0].children().size() else kept[0]
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, top).count() < 4200


def test_digits_of_any_script_are_counted_fast(spark):
    import time

    from textloom.functions.text import digit_class
    from textloom.operators import profile

    rows = ["7" * 30 + " rows", "٣" * 11 + "x" * 10, "²" * 11 + "é" * 10, "²" * 10 + "é" * 10 + "x", "7" * 20, "a" * 2001, None]
    got = [r.flag for r in profile.line_flags(spark.createDataFrame([(x,) for x in rows], "line string").coalesce(1)).collect()]
    assert got == ["digit_dense", "digit_dense", "digit_dense", None, None, "long", None]
    many = spark.range(0, 8000, 1, 1).select(F.concat(F.repeat(F.lit("Der Bericht führt fort, "), F.lit(60)), F.col("id").cast("string")).alias("line")).localCheckpoint()
    plain = F.regexp_count(F.col("line"), F.lit(f"(?U)[{digit_class()}]"))

    def seconds(df):
        begin = time.perf_counter()
        df.collect()
        return time.perf_counter() - begin

    fast, slow = profile.line_flags(many).agg(F.count_if(F.col("flag") == "long")), many.agg(F.sum(plain))
    assert min(seconds(fast) for _ in range(3)) < min(seconds(slow) for _ in range(2)) / 2


def test_quotas_read_the_rows_once(spark, monkeypatch):
    """Companies of several years, ties over years, a target beyond what there is; one job for all forms and years."""
    rng = random.Random(8)
    rows = [(f"{rng.randint(1, 40):010d}", f"a{k}", rng.choice([1995, 1996, 1997, 1998]), rng.choice(["10K", "8K", "13D"])) for k in range(300)]
    df = spark.createDataFrame(rows, "cik string, accession string, year int, form string")

    def want(target, years, form):
        digest = lambda a: hashlib.md5(f"42:{a}".encode()).hexdigest()
        out, used = [], set()
        for year, most in [*((y, max(1, target // len(years))) for y in years), *((y, target) for y in years)]:
            least = {}
            for cik, a, y, f in rows:
                if y == year and f == form and cik not in used:
                    least[cik] = min(least.get(cik, ("z", "")), (digest(a), a))
            taken = sorted((m, cik) for cik, m in least.items())[: max(0, min(most, target - len(out)))]
            out += [(cik, m[1], year) for m, cik in taken]
            used |= {cik for _, cik in taken}
        return out

    reads = []
    kept = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: reads.append(1) or kept(self))
    years = [1996, 1995, 1997]
    for target in (1, 7, 20, 500):
        del reads[:]
        out = choose.form_sample(df, 2 * target, ["8K", "10K"], years)
        assert len(reads) == 1
        got = [tuple(r) for r in out.collect()]
        assert sorted(got) == sorted((*r, f) for f in ("8K", "10K") for r in want(target, years, f))
    assert sorted(map(tuple, choose.quota_sample(df.filter("form = '10K'"), 20, years).collect())) == sorted(want(20, years, "10K"))


def test_training_takes_the_train_split(spark):
    sf = "/root/testdata/sf0.001"
    train = {r.doc_id for r in queries.train_eval_split(spark, sf).filter("split = 'train'").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id").isin(train))
    want = tokens.train_on(docs, 600).merges
    assert [(r.left, r.right) for r in queries.bpe_train(spark, sf).orderBy("rank").collect()] == want


def test_years_and_requests():
    assert choose.pad_years("2013-2015") == [2013, 2014, 2015] and choose.pad_years("2015,2013") == [2013, 2015]
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = http.TokenBucket(2, lambda: now[0], sleep)
    answers = iter([(503, b""), (200, b"x")])
    assert http.get("u", lambda _: next(answers), bucket, sleep=sleep) == b"x"
    bucket.take()
    bucket.take()
    assert now[0] >= 1
    with pytest.raises(ValueError):
        http.check_user_agent("none")
