"""Small tables with nulls, empty and long texts, repeated rows, clashing columns; brute force where SQL can't tell."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import same
from textloom.llm import bpe, chat, components, decontaminate, jaccard, katz, language, lines, quality, registry, secrets, substrings

ROWS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, h string, n_words string"


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)], ROWS)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    say = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))
    base = say(120)
    near = base.split()
    near[60] = "changed"
    return [None, "", " \n\t", "one", "É ñ", base, base, " ".join(near), base.upper(), say(60) + "\n" + base[:300], "a " * 200, say(5000), "漢字 😀 x\x1cy", say(9), say(40) + " " + base]


def docs_of_sf(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]


def empty(spark):
    return docs_of(spark, [], [])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe(spark, odd):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS_FILE))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs_of(spark, odd))).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r.ids == own.encode_ordinary(odd[r.doc_id] or "") and bytes(r.decoded) == (odd[r.doc_id] or "").encode()
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0


def test_bpe_decodes_in_the_pass_that_encodes(spark, odd):
    docs = docs_of(spark, odd).withColumn("decoded", F.lit(7))
    rows = bpe.encode(docs, decoded="decoded")
    assert rows.columns == [*(c for c in docs.columns if c not in ("ids", "decoded")), "ids", "decoded"]
    twice = bpe.decode(bpe.encode(docs))
    key = lambda r: (r.doc_id, r.ids, bytes(r.decoded))
    assert sorted(map(key, rows.collect())) == sorted(map(key, twice.collect()))
    assert [bytes(r.decoded) for r in rows.orderBy("doc_id").collect()] == [(t or "").encode() for t in odd]
    assert bpe.encode(empty(spark), decoded="decoded").count() == 0
    stage = corpus_pipeline.encode(spark, docs_of(spark, odd), "")
    assert str(stage._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1


def test_bpe_random_strings():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS_FILE))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(bpe.Merges(ranks), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaab  \n\t'sstdllve.,;0123éß😀漢۱ẞʰ́Ⅷ²\x1c\x85 ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, counts = replay.encode(texts)
    ends = np.cumsum(counts)
    assert all(ids[e - n : e].tolist() == own.encode_ordinary(t) for t, n, e in zip(texts, counts, ends, strict=True))


def brute_decontaminate(texts, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for t in texts:
        w, hit, got = find(t), set(), set()
        for name, item in items:
            v = find(item)
            n = min(8, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    got.add(str(name))
        out.append((len(w), len(hit), sorted(got)))
    return out


def test_decontaminate(spark, odd, monkeypatch):
    items = [(1, odd[5][100:400]), (2, odd[5][100:400].upper()), (10, "one"), (3, None), (4, "!!"), (5, odd[9][:80]), (7, "a a a a a a a a a"), (8, "alpha1 beta2")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = brute_decontaminate(odd, items)
    for block in (1 << 20, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        rows = decontaminate.find_benchmark(docs_of(spark, odd), bench).collect()
        assert len(rows) == len(odd)
        for r in rows:
            assert (r.n_words, sum(s.end - s.begin for s in r.hit_spans), r["items"]) == want[r.doc_id]
    assert decontaminate.find_benchmark(empty(spark), bench).count() == 0
    assert decontaminate.find_benchmark(docs_of(spark, odd), bench.limit(0)).filter("size(hit_spans) > 0").count() == 0


def brute_groups(ids, texts):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, []).append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_jaccard(spark, odd, monkeypatch):
    rng = random.Random(2)
    family = ["f%d " % k for k in range(90)]
    texts, ids = list(odd), list(range(len(odd)))
    for k in range(40):  # near copies that link in chains
        for j in range(3):
            family[rng.randrange(90)] = f"g{k}{j} "
        texts.append("".join(family))
        ids.append(100 + (k * 7) % 40)
    texts += [texts[5], "other words here now and then", texts[20]]
    ids += [5, 5, 200]
    want = brute_groups(ids, texts)
    for block in (4_000_000, 300):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        rows = jaccard.group_similar(docs_of(spark, [*texts, None, "x y z a b"], [*ids, None, None])).collect()
        assert len(rows) == len(ids) + 2
        assert {r.doc: r.component_id for r in rows if r.doc is not None} == want
        assert all(r.component_id is None for r in rows if r.doc is None)
    assert jaccard.group_similar(empty(spark)).count() == 0


def test_tree_join_equals_pairs():
    rng = random.Random(4)
    for _ in range(60):
        sets = [sorted(rng.sample(range(60), rng.randint(5, 40))) for _ in range(12)]
        for k in range(12):
            c = list(sets[rng.randrange(12)])
            c[rng.randrange(len(c))] = 60 + k
            sets.append(sorted(set(c)))
        links = jaccard.tree_join(list(range(24)), sets, 85)
        root = list(range(24))
        got = list(range(24))
        for _ in range(24):
            for a in range(24):
                for b in range(24):
                    if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]}):
                        root[a] = root[b] = min(root[a], root[b])
            for a, b in links:
                got[a] = got[b] = min(got[a], got[b])
        assert got == root


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(50)] + [(500, 500 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[x] == got.get(x, x) for x in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, length):
    split = [words_of(t) for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("length", [5, 14, 35, 50])
def test_substrings(spark, odd, length):
    ids = [*range(len(odd)), 5, None]
    texts = [*odd, odd[5], odd[7]]
    want = defaultdict(list)
    for i, x in zip(ids, brute_repeats(texts, length), strict=True):
        want[i].append(x)
    rows = substrings.remove_repeats(docs_of(spark, texts, ids), length=length).collect()
    assert len(rows) == len(ids)
    assert all((r.n_words, r.n_removed, r.kept_text) in want[r.doc] for r in rows)
    assert substrings.remove_repeats(empty(spark), length=length).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits_apart(a: str, b: str, most: int) -> bool:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        if min(now) > most:
            return False
        before = now
    return before[-1] <= most


def test_lines_of_one_original(spark):
    """A large group of near copies, most of them too far apart: every earlier line counts, as in brute force."""
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dög and runs far away"
    texts = [base]
    for _ in range(220):
        words = base.split()
        words[rng.randrange(len(words))] = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 7)))
        if rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at] = words[at][::-1]
        line = " ".join(words)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", "x", line[at] + "z"]) + line[at + 1 :]
        texts.append(line)
    rng.shuffle(texts)
    want = {}
    for i, a in enumerate(texts):
        if any(a == b or abs(len(a) - len(b)) <= 2 and edits_apart(a, b, 2) for b in texts[:i]):
            want[i] = [0]
    got = {r.doc: r.removed for r in lines.removed_lines(docs_of(spark, texts)).collect()}
    assert got == want and 20 < len(want) < 120


def test_lines_that_leave_an_original_at_several_places(spark, monkeypatch):
    """Long lines with a few changed words each: few pairs are verified, and none that is near is lost."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(240):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(1, 5)):
            words[at] = "".join(rng.choice("xyz") for _ in range(rng.randrange(3, 6))) + words[at][:2]
        texts.append(" ".join(words))
    for line in rng.sample(texts, 40):
        at = rng.randrange(len(line))
        texts.append(line[:at] + rng.choice(["", "x", line[at] + "z"]) + line[at + 1 :])
    rng.shuffle(texts)

    def near(a, b):
        same = len(os.path.commonprefix([a, b]))
        a, b = a[same:][::-1], b[same:][::-1]
        same = len(os.path.commonprefix([a, b]))
        return len(a) - same <= 30 and edits_apart(a[same:], b[same:], 2)

    want = {i: [0] for i, a in enumerate(texts) if any(a == b or abs(len(a) - len(b)) <= 2 and near(a, b) for b in texts[:i])}
    pairs, checked = [], lines.checked

    def counted(of, *args):
        pairs.append(of.filter("not of_pivot").count())
        return checked(of, *args)

    monkeypatch.setattr(lines, "checked", counted)
    got = {r.doc: r.removed for r in lines.removed_lines(docs_of(spark, texts)).collect()}
    assert got == want and len(want) >= 20
    assert sum(pairs[1:]) < 300  # of the smaller keys


def test_lines_are_compared_with_an_original_once(spark):
    """Both kinds of smaller keys come from one pass over a large key's lines, by one expression for all edits and both ends."""
    rows = spark.createDataFrame([], "k long, place struct<doc: long, version: long, at: int>, h long, line string, other string, near boolean")
    plan = lines.split_keys(rows, 2, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("reverse(line") == 1


def test_line_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abü𝒳") for _ in range(rng.choice([0, 1, 2, 5, 30])))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "ü"])
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *(lines.within(F.col("a"), F.col("b"), k).alias(f"within{k}") for k in (2, 4)))
    for r in rows.collect():
        assert r.within2 == edits_apart(r.a, r.b, 2) and r.within4 == edits_apart(r.a, r.b, 4)


def test_lines(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((10, 23, 24, 25, 30, 31, 40)))) for _ in range(12)]
    pool = list(base)
    for b in base * 4:
        v = list(b)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(v))
            v[k : k + rng.randint(0, 1)] = rng.choice(("", "x", "yz"))
        pool.append("".join(v))
    texts = ["\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 8))) for _ in range(30)] + [None, ""]
    first, all_lines = {}, []
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if re.search(r"[^ \t-\r]", x):
                all_lines.append((i, k, x))
                first.setdefault(x, (i, k))
    gone = defaultdict(list)
    for i, k, x in all_lines:
        near = any(f < first[x] and len(y) >= 24 and len(x) >= 24 and edit(x, y) <= 2 for y, f in first.items() if abs(len(x) - len(y)) <= 2)
        if (i, k) != first[x] or near:
            gone[i].append(k)
    got = {r.doc: r.removed for r in lines.removed_lines(docs_of(spark, texts)).collect()}
    assert got == dict(gone)
    kept = lines.dedup_lines(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, texts).columns and kept.count() == len(texts)
    for r in kept.collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id]))
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(docs.filter(fold != 2))
    told = language.identify(docs.filter(fold == 2), model)
    assert told.filter("lang_pred = lang").count() >= 0.97 * told.count()
    rows = {r.doc_id: r for r in language.identify(docs_of(spark, odd), model).collect()}
    assert [rows[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows.values())
    assert len(rows) == len(odd) and language.identify(empty(spark), model).count() == 0
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs_of(spark, odd), none).collect()} == {"und"}


@pytest.mark.parametrize("segment,dense", [(2048, 250), (3, 250), (2048, 2), (4, 1)])
def test_longest_matches(monkeypatch, segment, dense):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "DENSE_LETTERS", dense)
    model = language.build({"a": ["abcabd"], "b": ["xyz abd"]}, 100)
    steps = language.Letters()
    sample = {"a": "abcabd ", "b": "xyz abd "}
    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice("abcdxyz q") for _ in range(rng.randint(1, 25)))
        letters = steps.of(t)
        got = language.phrases(model, [letters])[0]
        s = "".join(map(chr, letters))
        for k, lang in enumerate(model.langs):
            n = i = 0
            while i < len(s):
                j = i + 1
                while j < len(s) and s[i : j + 1] in sample[lang] and s[i:j] in sample[lang]:
                    j += 1
                n, i = n + 1, j
            assert got[k] == n, (t, lang)


def test_long_texts_parse_as_one(spark, monkeypatch):
    texts = [t for t in docs_of_sf(spark) if t]
    model = language.build({"a": texts[:3], "b": texts[3:6]}, 5000)
    letters = [language.Letters().of(t) for t in (" ".join(texts[6:60]), "a " * 5000, texts[7], "q", "ab" * 4000)]
    parts = [letters[:2], letters[2:], letters]
    parted = [language.phrases(model, x).tolist() for x in parts]
    monkeypatch.setattr(language, "SEGMENT", 1 << 20)
    assert len(letters[0]) > 10_000 and parted == [language.phrases(model, x).tolist() for x in parts]
    assert parted[0] + parted[1] == parted[2]


def brute_katz(texts, train, vocabulary):
    toks = [katz.tokens(None if t is None else t.encode()) for t in texts]
    c = Counter(w for k, t in enumerate(toks) if train[k] for w in t)
    total = sum(c.values())
    d1 = katz.discounts([sum(v == i for v in c.values()) for i in range(7)])
    known = {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]}
    one = lambda w: d1[min(c[w], 6)] * c[w] / total
    unseen = 1 - sum(map(one, c))
    share = {w: one(w) for w in known}
    share[None] = 1 - sum(share.values())
    pairs = Counter()
    for k, t in enumerate(toks):
        if train[k]:
            h = "begin"
            for w in t:
                x = w if w in known else None
                pairs[h, x] += 1
                h = x
    d2 = katz.discounts([sum(v == i for v in pairs.values()) for i in range(7)])
    after = defaultdict(dict)
    for (h, w), n in pairs.items():
        after[h][w] = n

    def prob(h, w):
        seen = after.get(h)
        if not seen:
            return share[w]
        n = sum(seen.values())
        kept = sum(d2[min(v, 6)] * v for v in seen.values()) / n
        scale = n / (n + 1) if kept > 1 - 1e-12 else 1.0
        if w in seen:
            return scale * d2[min(seen[w], 6)] * seen[w] / n
        return (1 - scale * kept) / (1 - sum(share[x] for x in seen)) * share[w]

    for h in after:
        if len(after[h]) < len(share):
            assert abs(sum(prob(h, w) for w in share) - 1) < 1e-9
    out = []
    for t in toks:
        base = sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in t)
        score, h = 0.0, "begin"
        for w in t:
            x = w if w in known else None
            score += math.log10(prob(h, x))
            if x is None:
                score += math.log10((one(w) if c[w] else unseen) / share[None])
            h = x
        out.append((len(t), sum(c[w] > 0 for w in t), total, base, score))
    return out


def test_katz(spark, odd, monkeypatch):
    monkeypatch.setattr(katz, "VOCABULARY", 40)
    monkeypatch.setattr(katz, "KNOWN_PAIRS", 30)
    texts = [*odd, *(t and t[::2] for t in odd), odd[5]]
    ids = [*range(len(texts) - 1), 5]
    docs = docs_of(spark, texts, ids)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    want = brute_katz(texts, [not h for h in held], 40)
    rows = katz.score_texts(docs, docs.filter(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base, score = want[r.doc]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert katz.score_texts(empty(spark), docs).count() == 0
    assert all(r.score == 0 for r in katz.score_texts(docs_of(spark, ["", None]), empty(spark)).collect())


def test_katz_every_word_has_pairs(spark, odd, monkeypatch):
    """Few words and pairs are known everywhere; all others have their own pairs nonetheless."""
    monkeypatch.setattr(katz, "KNOWN_WORDS", 40)
    monkeypatch.setattr(katz, "KNOWN_PAIRS", 30)
    texts = [*odd, *(t and t[::2] for t in odd), odd[5], "alpha1 never seen alpha1 beta2 seen"]
    docs = docs_of(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 or i == len(texts) - 1 for i in range(len(texts))]
    want = brute_katz(texts, [not h for h in held], 1 << 60)
    assert want != brute_katz(texts, [not h for h in held], 40)
    train = docs.filter((F.crc32(F.col("doc_id").cast("string")) % 7 != 2) & (F.col("doc_id") < len(texts) - 1))
    rows = katz.score_texts(docs, train).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base, score = want[r.doc]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_katz_deletes_tables_of_rare_pairs(spark, odd, monkeypatch):
    monkeypatch.setattr(katz, "KNOWN_WORDS", 40)
    kept, keep = [], katz.stored

    def stored(df):
        kept.append(((out := keep(df)).columns, out, out.inputFiles()))
        return out

    monkeypatch.setattr(katz, "stored", stored)
    docs = docs_of(spark, odd)
    rows = katz.score_texts(docs, docs.filter("doc_id % 3 <> 2"))
    left = {tuple(columns): any(os.path.exists(f.removeprefix("file:")) for f in files) for columns, _, files in kept}
    assert not left["h", "w", "n"] and not left["h", "w", "p"] and left["a", "b", "h", "w", "m", "p"]
    told = next(df for columns, df, _ in kept if columns[-1] == "p" and "a" in columns)
    assert told.filter("p is null").count() and told.filter("p is not null").count()
    assert told.filter("(p is null) <> (h is not null) or (p is null) <> (w is not null)").count() == 0
    assert rows.count() == len(odd)


def test_quality(spark, odd):
    texts = [*odd, "# $ x\nsame line\nsame line\n\n\n|", "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 z " * 2]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1), (9, None)], "doc_id int, quality int")
    good = quality.trusted(labels)
    assert [r.id for r in good.collect()] == [5]
    rows = quality.assess(docs, good).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        w = words_of(t)
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        solid = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(solid) - len(set(solid)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert quality.assess(empty(spark), good).count() == 0
    plan = quality.assess(docs, good)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets(spark):
    words = ["settings", "contain", "value", "there", "which", "server"]
    found = secrets.labelled_findings(words, 2000)
    forest = secrets.fit(found[:1400], words)
    features = secrets.Features(words)
    scores = forest.score(np.array([features.of(f) for f in found[1400:]]))
    assert np.mean((scores >= 0.5) == np.array([f.label for f in found[1400:]])) > 0.95
    key = hashlib.sha1(b"1").hexdigest()
    texts = [None, "", f'set token = "{key}" here', f"commit {key} was fine", "plain words only", f'token = "{key}" ' * 2]
    rows = {r.doc_id: r for r in secrets.scan(docs_of(spark, texts), forest, words).collect()}
    assert [len(rows[k].secrets) for k in range(6)] == [0, 0, 1, 0, 0, 2]
    s = rows[2].secrets[0]
    assert texts[2][s.begin : s.end] == key
    assert secrets.scan(empty(spark), forest, words).count() == 0


def test_chat(spark, monkeypatch):
    turns = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "x\ny"), (2, 0, "system", "alone"), (3, None, "ann", "a"), (3, 0, "ann", "a"), (3, 0, "ann", "a"), (None, 1, "ann", "n")]
    turns += [(9, k // 3, "ann" if k % 2 else "bob", f"t{k}") for k in range(40)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").withColumn("part", F.lit("clash"))
    whole = {(r.conv_id, r.perspective): r for r in chat.perspectives(df).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann"), (None, "ann"), (9, "ann"), (9, "bob")}
    r = whole[1, "ann"]
    assert r.rendered == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx\ny<|im_end|>\n"
    assert [r.rendered[m.begin : m.end] for m in r.mask] == ["hi<|im_end|>\n"]
    assert whole[3, "ann"].n_own == 3
    monkeypatch.setattr(chat, "PART_TURNS", 7)
    parts = defaultdict(list)
    for r in chat.perspectives(df).collect():
        assert r.n_turns <= 7 and len(r.mask) == r.n_own
        parts[r.conv_id, r.perspective].append((r.part, r.rendered))
    assert {k: sum(len(t) for _, t in v) for k, v in parts.items()} == {k: len(r.rendered) for k, r in whole.items()}
    assert [p for p, _ in sorted(parts[9, "ann"])] == list(range(6))
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_order_holds_at_every_size(spark, monkeypatch, tmp_path):
    """Equal and null turn numbers in conversations of many parts, against the SQL of parts of seven turns."""
    rng = random.Random(8)
    turns = [(k % 3, rng.choice([None, 0, 1, 2]), rng.choice(["ann", "bob", "zoe", "system", None]), rng.choice([None, "", "x", "y", f"t{k}"])) for k in range(200)]
    schema = "conv_id int, turn int, role string, text string"
    spark.createDataFrame(turns, schema).write.parquet(f"{tmp_path}/rows")
    pq.write_table(pq.read_table(f"{tmp_path}/rows"), f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(chat, "PART_TURNS", 7)
    same(spark, chat.op10_chat, chat.OP10_SQL.replace("1024", "7"), str(tmp_path))
    told = lambda rows: sorted((r.perspective, r.part, r.rendered) for r in chat.perspectives(spark.createDataFrame(rows, schema)).collect())
    assert told([(None, *t[1:]) for t in turns]) == told([(5, *t[1:]) for t in turns])


def test_katz_query(spark, odd, tmp_path):
    """The registered query against brute force; what is registered as SQL is text."""
    assert all(isinstance(sql, str) for sql in registry.ORACLES.values())
    docs_of(spark, odd).write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(odd))]
    want = brute_katz(odd, [not h for h in held], 1 << 60)
    rows = registry.QUERIES["op5_katz"](spark, str(tmp_path)).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == held[r.doc_id]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])


@pytest.mark.parametrize("percent", [50, 80, 85, 97, 100])
def test_jaccard_parts(percent):
    """Linked sets of any sizes have a part in common; few of the sets that share a passage do."""
    rng = np.random.default_rng(percent)
    parts = jaccard.Parts(percent)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for _ in range(3000):
        n = int(np.exp(rng.uniform(0, 7)))
        a = fresh(n)
        gone, new = rng.integers(0, 1 + n * (100 - percent) // 100), rng.integers(0, 2 + n * (100 - percent) // percent)
        b = np.unique(np.concatenate((a[gone:], fresh(new))))
        both = n - gone
        if 0 < 100 * both >= percent * (n + new) and gone + new:
            assert {*parts.of(np.unique(a)).tolist()} & {*parts.of(b).tolist()}
    boilerplate = fresh(60)
    if percent >= 80:
        keys = Counter(k for _ in range(200) for k in parts.of(np.unique(np.concatenate((boilerplate, fresh(400))))).tolist())
        assert max(keys.values(), default=1) <= 40  # of 200, which all have each shingle of the passage


def test_jaccard_passage_is_no_meeting_place(spark):
    """Documents that share a passage, but little else, don't meet, however many they are."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(300)) for _ in range(120)]
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("doc"), "text")
    packed = rows.select("text").mapInArrow(jaccard._part_keys(4, 85, 4), "bucket long, high binary, low binary, sets binary")
    assert packed.groupBy("bucket").applyInPandas(jaccard._places, "at long, rep long").distinct().count() < 20
    some = docs_of(spark, texts).filter("doc_id % 3 = 0").select("doc_id")
    assert {r.doc for r in jaccard.among(rows, some.toDF("doc"), "doc").collect()} >= set(range(0, 120, 3))
    assert jaccard.among(rows, some.toDF("doc"), "doc").count() < 60


def test_similar_stage_meets_by_parts(spark):
    """By the pipeline's 5 words and 0.8, too, sets that have single frequent shingles in common don't meet, and near copies do."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n))
    frequent = [fresh(5) for _ in range(20)]
    texts = [" ".join(f"{fresh(30)} {rng.choice(frequent)}" for _ in range(10)) for _ in range(120)]
    near = [x.replace(" w", " v", 4) for x in texts[:5]]
    keys = docs_of(spark, texts).select("text").mapInArrow(jaccard._part_keys(5, 80, 4), "bucket long, high binary, low binary, sets binary")
    assert keys.groupBy("bucket").applyInPandas(jaccard._places, "at long, rep long").distinct().count() < 30
    rows = jaccard.group_similar(docs_of(spark, texts + near), size=5, percent=80).collect()
    assert {r.doc: r.component_id for r in rows} == {k: k % 120 for k in range(125)}
