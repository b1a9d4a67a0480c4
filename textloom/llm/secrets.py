"""Secret scan: candidates by shape, false positives removed by a random forest."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table
from .katz import _count_words, _merge_words, _most_frequent

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Characters of text before and after a candidate that its features see.
NEAR = 48
#: Words of the dictionary: the corpus's most frequent ones of four letters or more.
DICTIONARY = 4096
TREES, DEPTH, LEAF = 40, 9, 3
# Words near a finding, and parts of paths, that speak for or against a secret.
FOR_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "access", "key")
AGAINST_WORDS = ("example", "sample", "dummy", "placeholder", "test", "sha", "sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "hash", "uuid", "guid", "etag", "integrity", "build", "version")
FOR_PATHS = (".env", ".pem", ".key", "config", "settings", "credentials", "deploy", "secrets", ".cfg", ".ini")
AGAINST_PATHS = ("test", "spec", "mock", "fixture", "example", "doc", "readme", ".md", "lock", "vendor", "dist", "changelog")


class Finding(NamedTuple):
    path: str
    before: str
    value: str
    after: str
    label: int = 0


class Features:
    """Numbers that describe a finding: length, character transitions, dictionary coverage, path, neighbouring words."""

    def __init__(self, dictionary: list[str]):
        self.words = {w.lower() for w in dictionary if len(w) >= 4}
        counts = np.ones((27, 27))
        for w in self.words:
            codes = [26, *(ord(c) - 97 if "a" <= c <= "z" else 26 for c in w), 26]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.transition = np.log(counts / counts.sum(1, keepdims=True))

    def covered(self, value: str) -> float:
        """Share of the letters that lie in words of the dictionary, longest first from the left."""
        low, n, k = value.lower(), 0, 0
        while k < len(low):
            for size in range(min(14, len(low) - k), 3, -1):
                if low[k : k + size] in self.words:
                    n += size
                    k += size
                    break
            else:
                k += 1
        return n / len(value)

    def of(self, f: Finding) -> list[float]:
        v, low = f.value, f.value.lower()
        n = len(v)
        kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in v]
        codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
        share = np.bincount(np.frombuffer(v.encode(), np.uint8)) / n
        share = share[share > 0]
        before, after, path = f.before.lower(), f.after.lower(), f.path.lower()
        near = set(re.split(r"[^a-z0-9_\-]+", before)[-5:]) | set(re.split(r"[^a-z0-9_\-]+", after)[:4])
        parts = {p for w in near for p in re.split(r"[_\-]", w)} | near
        return [
            float(n),
            kinds.count("d") / n,
            kinds.count("u") / n,
            kinds.count("s") / n,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            float(-(share * np.log2(share)).sum()),
            float(self.transition[codes[:-1], codes[1:]].mean()),
            self.covered(v),
            float(set(low) <= set("0123456789abcdef")),
            float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
            float(len(set(low)) / n),
            float(max((len(x) for x in re.findall(r"[a-z]+", low)), default=0)) / n,
            float(len(parts & set(FOR_WORDS))),
            float(len(parts & set(AGAINST_WORDS))),
            float(bool(re.search(r"[=:]\s*[\"']?$", before))),
            float(before[-1:] in "\"'" and after[:1] in "\"'" and before[-1:] != ""),
            float("/" in before[-1:] or "://" in before[-12:]),
            float(sum(p in path for p in FOR_PATHS)),
            float(sum(p in path for p in AGAINST_PATHS)),
        ]


class Forest(NamedTuple):
    """Trees as arrays over all nodes: the feature asked (-1 at a leaf), its bound, the next nodes, the leaf's share of secrets."""

    roots: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            step = np.where(x[rows, np.maximum(f, 0)] <= self.bound[at], self.low[at], self.high[at])
            at = np.where(f < 0, at, step)
        return self.value[at].mean(axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 0) -> Forest:
    """A random forest: bootstrap samples, the best Gini split among a random root of the features at each node."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []

    def node(rows: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
            return here
        best = (1e-9, -1, 0.0)
        total, n = y[rows].sum(), len(rows)
        whole = total * (n - total) / n
        for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, left = x[order, f], np.cumsum(y[order])[:-1]
            m = np.arange(1, n)
            gain = whole - left * (m - left) / m - (total - left) * (n - m - total + left) / (n - m)
            gain[(v[1:] == v[:-1]) | (m < LEAF) | (n - m < LEAF)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            mask = x[rows, best[1]] <= best[2]
            low = node(rows[mask], depth + 1)
            high = node(rows[~mask], depth + 1)
            nodes[here][:4] = [best[1], best[2], low, high]
        return here

    roots = [node(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]
    columns = list(zip(*nodes, strict=True))
    return Forest(np.array(roots), *(np.array(c) for c in columns))


def labelled_findings(words: list[str], n: int = 3000, seed: int = 7) -> list[Finding]:
    """Findings with labels, drawn by rule: keys and tokens in assignments on one side; digests, ids, names, paths,
    compounds of words and placeholders on the other. A labelled table of one's own can take their place."""
    rng = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["some", "word", "text", "here", "with", "more"]
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexes, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    out = []
    for _ in range(n // 2):
        value = rng.choice([lambda: pick(hexes, rng.choice((32, 40, 48, 64))), lambda: pick(b62, rng.randint(20, 48)), lambda: pick(b64, rng.randint(24, 60)) + rng.choice(("", "=", "==")), lambda: rng.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + "234567", 16), lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + pick(b62, rng.randint(20, 36))])()
        name = rng.choice(("token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key", "key", "pwd"))
        before, after = rng.choice(((f'{name} = "', '"'), (f"{name}: ", " "), (f"{name}='", "'"), (f'"{name}": "', '",'), (f"{name.upper()}=", "\n"), (f"bearer {name} ", " "), ("authorization: bearer ", "\n")))
        path = rng.choice(("src0", "src7", "config/app.env", "deploy/settings.ini", "main.py", "server.key", ""))
        out.append(Finding(path, f"{prose()} {before}"[-NEAR:], value, f"{after}{prose()}"[:NEAR], 1))
    for _ in range(n - n // 2):
        kind = rng.randint(0, 6)
        before, after = prose() + " ", " " + prose()
        if kind == 0:
            value, before = pick(hexes, rng.choice((32, 40, 64))), f"{prose()} {rng.choice(('commit', 'sha256', 'md5', 'sha1:', 'checksum:', 'digest =', 'revision', 'etag: ', 'build '))} "
        elif kind == 1:
            value = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
            before = f"{prose()} {rng.choice(('id', 'uuid', 'guid', 'request', ''))} "
        elif kind == 2:
            value = rng.choice(("_", "-", "/", "")).join([*(rng.choice(words) for _ in range(6)), str(rng.randint(1, 99))])[:50]
        elif kind == 3:
            value = "".join(rng.choice(words).capitalize() for _ in range(5)) + str(rng.randint(0, 99))
        elif kind == 4:
            value, before, after = rng.choice(("your_api_key_here_1", "xxxxxxxxxxxxxxxxxxxx1", "example-token-0123456789", "changeme-placeholder-1", "AAAAAAAAAAAAAAAAAAAA1234")), f'{prose()} {rng.choice(("token", "password", "key"))} = "', '"'
        elif kind == 5:
            value, before = "/".join(rng.choice(words) for _ in range(5)) + f"/{rng.randint(1, 2024)}", f"{prose()} http://{rng.choice(words)}."
        else:
            value = pick(string.digits, rng.randint(16, 24))
        path = rng.choice(("src0", "src3", "tests/test_app.py", "docs/readme.md", "package-lock.json", "CHANGELOG.md", "main.py", ""))
        value = value if len(value) >= 16 else value + "0" * (16 - len(value))
        out.append(Finding(path, before[-NEAR:], value, after[:NEAR], 0))
    rng.shuffle(out)
    return out


def fit(findings: list[Finding], dictionary: list[str], seed: int = 0) -> Forest:
    features = Features(dictionary)
    return grow(np.array([features.of(f) for f in findings]), np.array([f.label for f in findings]), seed=seed)


def dictionary_of(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> list[str]:
    """The corpus's most frequent words of four letters or more, lower-cased; counts cover all texts."""
    size = docs.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(16, min(1 << 20, size // 16_000_000))
    packed = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).mapInArrow(_count_words(buckets), "bucket long, words binary, counts binary")
    counts = packed.groupBy("bucket").applyInPandas(_merge_words, "bucket long, words binary, counts binary").select("words", "counts").mapInArrow(_most_frequent(8 * most), "word binary, c long")
    words = counts.select(F.decode("word", "utf-8").alias("w"), "c").filter("w rlike '^[a-z]{4,}$'").orderBy(F.desc("c"), "w").limit(most)
    return [r.w for r in words.collect()]


FOUND = T.StructType(
    [
        T.StructField("n_candidates", T.LongType()),
        T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def plausible(value: str) -> bool:
    """Digits, or capitals within the value: plain words are no candidates."""
    return any(c.isdigit() for c in value) or len(re.findall(r"[a-z][A-Z]", value)) > 1


def scan(docs: DataFrame, forest: Forest, dictionary: list[str], text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """docs with n_candidates and secrets (begin, end, score), places being characters of the text.

    Candidates are runs of 16 or more of A-Z a-z 0-9 + / _ - with a digit or inner capitals, over the whole text;
    those are secrets whose share of the forest's votes is `threshold` or more. A null or empty text has none; a
    null or missing path is an empty one. Repeated rows stay, other columns pass through, columns named like
    the added ones are replaced, an empty table stays empty. Without a dictionary nothing is covered by words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(forest), dictionary))
    has_path = path is not None and path in docs.columns
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if has_path else F.lit("")
    body = F.when(F.col(f"`{text}`").isNotNull(), F.concat(where, F.lit("\0"), F.col(f"`{text}`").cast("string")))
    columns = docs.withColumn("_path and text", body)

    def make() -> Callable[[list], list[pa.Array]]:
        own, find = Forest(*shared.value[0]), re.compile(CANDIDATE)
        features = Features(shared.value[1])

        def work(texts: list) -> list[pa.Array]:
            counts, rows, places, out = [], [], [], []
            for k, both in enumerate(texts):
                where, _, t = (both or "\0").partition("\0")
                n = 0
                for m in find.finditer(t):
                    if plausible(m[0]):
                        n += 1
                        a, b = m.span()
                        rows.append(features.of(Finding(where, t[max(0, a - NEAR) : a], m[0], t[b : b + NEAR])))
                        places.append((k, a, b))
                counts.append(n)
                out.append([])
            for (k, a, b), s in zip(places, own.score(np.array(rows)).tolist() if rows else [], strict=True):
                if s >= threshold:
                    out[k].append((a, b, s))
            return [pa.array(counts, pa.int64()), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]

        return work

    return add_columns(columns, "_path and text", FOUND, make).drop("_path and text")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: how many candidates, and the places that the forest keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    words = dictionary_of(docs)
    forest = fit(labelled_findings(words), words)
    found = scan(docs, forest, words).drop("text", "source")
    spans = F.transform("secrets", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        "n_candidates",
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(spans, ",").alias("secret_spans"),
        F.coalesce(F.array_max(F.transform("secrets", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
