"""Secrets in texts: wide candidate patterns, and a random forest that removes false findings."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable, hash64, map_arrow, tree_sum

#: Findings per family made by rule, beside those of the documents, and how many times as much the latter weigh at most, all together.
MADE, PER_MADE = 60, 5
TREES, DEPTH = 40, 10
#: Bins of a feature, by its quantiles over all findings, and nodes whose bins are counted at once.
BINS, NODES = 32, 4_096
#: Leading words of the documents that count as a dictionary, and words that a task counts before it hands them on.
DICTIONARY, HELD = 4_000, 1 << 18
#: Characters looked at on either side of a candidate.
REACH = 48

_RUN = r"A-Za-z0-9+/_=\-"
#: Candidates, the first that fits at a place: name and pattern; the value is the first group that took part, or all.
#: No part is searched twice from the same start, so that long texts take linear time.
PATTERNS = (
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]*"),
    ("url_password", r"(?<![\w+.\-])[A-Za-z][\w+.\-]*+://[^\s:/@\"'<>]*+:([^\s/@\"'<>]+)@"),
    ("password", r"(?i:\b(?:password|passwd|pwd|passphrase)\b[\"']?\s*+[:=]\s*+)"
                 r"(?:\"((?:[^\"\\\n]|\\.){6,}+)\"|'((?:[^'\\\n]|\\.){6,}+)'|[\"']?([^\s\"',;]{6,}+))"),
    ("long_run", rf"(?<![{_RUN}.@])[{_RUN}]{{16,}}(?![{_RUN}@])"),
)
_CANDIDATE = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))
_FIRST, _GROUPS = _CANDIDATE.groupindex, {name: re.compile(pattern).groups for name, pattern in PATTERNS}
#: Prefixes that issuers give their keys (fixed values).
ISSUED = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|glpat-|npm_|SG\.|hf_)")
_ASKS = re.compile(r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|passwd|pwd|credential|auth|bearer|access[_-]?key|private[_-]?key)")
_BENIGN = re.compile(r"(?i)(?:sha-?\d*|md5|commit|checksum|digest|integrity|hash|uuid|guid|revision|etag|isbn|order|card|phone|tel|id)\b")
_PLACEHOLDER = re.compile(r"(?i)(?:example|dummy|sample|placeholder|changeme|your|xxxx|test|fake|1234567|abcdef|redacted)")
_TEST_PATH = re.compile(r"(?i)(?:test|example|sample|fixture|mock|docs?/|\.lock$)")
_WORDS = re.compile(r"[a-z]{3,12}")
_CLASS = np.full(128, 5, np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"+/=", 3), (b"_-.", 4)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_LETTER = np.full(128, 27, np.int64)
_LETTER[48:58], _LETTER[97:123] = 26, np.arange(26)


def candidates(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(pattern name, start, end) of each candidate, without overlaps; runs of one class of letters are none."""
    for m in _CANDIDATE.finditer(text or ""):
        name = next(n for n, _ in PATTERNS if m.group(n) is not None)
        inner = range(_FIRST[name] + 1, _FIRST[name] + 1 + _GROUPS[name])
        start, end = m.span(next((k for k in inner if m.group(k) is not None), name))
        value = m.string[start:end]
        if name != "long_run" or (not value.isalpha() and re.search(r"[0-9]", value)) or (value.isalpha() and re.search(r"[a-z][A-Z].*[a-z][A-Z]", value)):
            yield name, start, end


@dataclass
class Language:
    """What ordinary letters look like: transition log-probabilities and a dictionary."""

    transitions: np.ndarray
    words: frozenset

    def fluency(self, value: str) -> float:
        """Mean log-probability of a letter after the one before it."""
        codes = _codes(value)
        return float(self.transitions[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the value's letters inside dictionary words, longest first."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            size = next((k for k in range(min(12, len(low) - at), 2, -1) if low[at : at + k] in self.words), 0)
            covered, at = covered + size, at + max(size, 1)
        return covered / max(1, len(low))


def _codes(text: str) -> np.ndarray:
    """Letters a-z as 0-25 whatever their case, digits 26, others 27."""
    return _LETTER[np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8)]


FEATURES = ("length", "lower", "upper", "digit", "base64", "joiner", "changes", "distinct", "entropy", "fluency", "coverage", "hex", "issued",
            "asked", "assigned", "quoted", "benign", "placeholder", "in_url", "asks_after", "near_fluency", "test_path", "pattern", "modulo")


def features(name: str, value: str, before: str, after: str, path: str | None, language: Language) -> list[float]:
    """Numbers about a candidate, its neighbouring words and its path."""
    kinds = _CLASS[np.frombuffer(value.encode("ascii", "replace"), np.uint8)]
    share = np.bincount(kinds, minlength=6) / max(1, len(kinds))
    _, counts = np.unique(list(value), return_counts=True)
    p = counts / max(1, counts.sum())
    near = re.sub(r"[\s\"'`(\[{<]+$", "", before)
    return [min(len(value), 400), share[0], share[1], share[2], share[3], share[4], float((kinds[1:] != kinds[:-1]).mean()) if len(kinds) > 1 else 0.0,
            len(counts) / max(1, len(value)), float(-(p * np.log2(p)).sum()), language.fluency(value), language.coverage(value),
            float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), float(ISSUED.match(value) is not None), float(_ASKS.search(before[-24:]) is not None),
            float(near[-1:] in ("=", ":")), float(before[-1:] in "\"'`" and before != "" and after[:1] == before[-1:]), float(_BENIGN.search(before[-24:]) is not None),
            float(_PLACEHOLDER.search(value) is not None or _PLACEHOLDER.search(before[-24:]) is not None), float("/" in before[-2:] or "://" in before or "www." in before),
            float(_ASKS.search(after) is not None), language.fluency(before[-24:]), float(_TEST_PATH.search(path or "") is not None),
            float([n for n, _ in PATTERNS].index(name)), float(len(value) % 4 == 0)]


#: Chances of 0, at most 1, at most 2, ... draws of a row into a tree's bag.
_DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


class Forest:
    """A random forest of class probabilities, in flat arrays.

    Trees grow together, level by level, from counts of each node's rows by feature, bin and
    class. Counts of parts of the rows add up, so the rows may lie in a Spark table
    (``of_table``) and none is left out. How often a row is in a tree's bag follows from its hash.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        edges = [np.unique(v) for v in np.quantile(x, np.arange(BINS) / BINS, axis=0, method="lower").T] if len(y) else []
        rows = x, y.astype(np.int64), np.ones(len(y)), np.arange(len(y))
        self._grow(lambda *at: self._counts(*rows, edges, *at), edges, len(y), trees, depth, seed)

    @classmethod
    def of_table(cls, examples: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
        """The forest of all rows (x array of double, y int, made boolean, h long). The driver gets quantiles and sums."""
        width = len(FEATURES)
        ranks = F.array(*[F.lit(i / BINS) for i in range(BINS)])
        seen = examples.agg(F.count(F.lit(1)), F.count_if("made"), *[F.percentile_approx(F.col("x")[f], ranks, 10_000) for f in range(width)]).first()
        edges = [np.unique(v) for v in seen[2:]] if seen[0] else []
        # Whole numbers, so that sums don't depend on their order.
        weight = max(1, round((seen[0] - seen[1]) / (PER_MADE * max(1, seen[1]))))
        forest = cls.__new__(cls)

        def count(*at) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for batch in batches:
                    x = batch.column(0).flatten().to_numpy().reshape(-1, width)
                    y, made, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                    part = forest._counts(x, y.astype(np.int64), np.where(made, float(weight), 1.0), h, edges, *at)
                    total = part if total is None else total + part
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

            sums = tree_sum(examples.select("x", "y", "made", "h").mapInArrow(run, "sums binary"))
            return sums.reshape(len(at[0]), -1, BINS + 1, 2)

        forest._grow(count, edges, seen[0], trees, depth, seed)
        return forest

    def _counts(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, h: np.ndarray, edges: list, nodes: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """Weights of the rows in ``nodes`` by tried feature, bin and class."""
        slot = np.full(len(self.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        bins = np.stack([np.searchsorted(edge, x[:, f]) for f, edge in enumerate(edges)], 1)
        out = np.zeros((*tried.shape, BINS + 1, 2))
        for tree, root in enumerate(self.roots):
            draw = hash64(hash64(h) + np.uint64(tree)) >> np.uint64(11)
            bag = weight * np.searchsorted(_DRAWS, draw / 2.0**53, side="right")
            rows = np.flatnonzero(bag)
            at = slot[self._leaf(root, x[rows])]
            rows, at = rows[at >= 0], at[at >= 0]
            for k in range(tried.shape[1]):
                np.add.at(out, (at, k, bins[rows, tried[at, k]], y[rows]), bag[rows])
        return out

    def _grow(self, count, edges: list, n: int, trees: int, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.roots = n, list(range(trees if n else 0))
        feature, cut, child, value = [0] * len(self.roots), [0.0] * len(self.roots), [[i, i] for i in self.roots], [0.5] * len(self.roots)

        def keep() -> None:
            self.feature, self.cut = np.array(feature, np.int64), np.array(cut)
            self.child, self.value = np.array(child, np.int64).reshape(-1, 2), np.array(value)

        keep()
        level = self.roots
        for _ in range(depth):
            below = []
            for start in range(0, len(level), NODES):
                nodes = np.array(level[start : start + NODES])
                tried = np.stack([rng.choice(len(edges), min(len(edges), int(np.sqrt(len(edges))) + 1), replace=False) for _ in nodes])
                for node, features, counts in zip(nodes, tried, count(nodes, tried)):
                    left, ones = counts.sum(2).cumsum(1), counts[:, :, 1].cumsum(1)
                    size, total = left[0, -1], ones[0, -1]
                    value[node] = (total + 0.5) / (size + 1)
                    if size < 4 or not 0 < total < size:
                        continue
                    a, left = ones[:, :-1], left[:, :-1]
                    b, right = total - a, size - left
                    with np.errstate(divide="ignore", invalid="ignore"):
                        impurity = np.where((left > 0) & (right > 0), a * (left - a) / left + b * (right - b) / right, np.inf)
                    k, bin_ = np.unravel_index(np.argmin(impurity), impurity.shape)
                    if impurity[k, bin_] < np.inf:
                        feature[node], cut[node], child[node] = features[k], edges[features[k]][bin_], [len(feature), len(feature) + 1]
                        for some, of in ((a[k, bin_], left[k, bin_]), (b[k, bin_], right[k, bin_])):
                            below.append(len(feature))
                            feature.append(0), cut.append(0.0), child.append([below[-1]] * 2), value.append((some + 0.5) / (of + 1))
            level = below
            keep()

    def _leaf(self, root: int, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), root)
        while True:
            nxt = self.child[node, (x[np.arange(len(x)), self.feature[node]] > self.cut[node]).astype(np.int64)]
            if (nxt == node).all():
                return node
            node = nxt

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            total += self.value[self._leaf(root, x)]
        return total / max(1, len(self.roots))


def made_findings(n: int = MADE, seed: int = 3) -> list[tuple[str, str, str, str, str, int]]:
    """Findings with labels, made by rule: (pattern, value, before, after, path, secret or not)."""
    rng = np.random.default_rng(seed)
    low, hexa, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    both = low + low.upper() + digits
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    word = lambda: pick("bcdfghlmnprst", 1) + pick("aeiou", 1) + pick("lnrst", 1) + pick("aeiou", 1)
    names = ("token", "api_key", "secret", "apikey", "access_key", "auth_token", "client_secret", "SECRET_KEY")
    plain = ("commit", "sha256", "checksum", "md5", "uuid", "revision", "see", "order", "id", "hash of", "etag", "digest")
    out = []
    for _ in range(n):
        name, other, quote = rng.choice(names), rng.choice(plain), rng.choice(["\"", "'", ""])
        path, sep = rng.choice(["src/app.py", "web", "config.yml"]), rng.choice([" = ", "=", ": "])
        out += [("long_run", pick(hexa, int(rng.choice([32, 40, 64]))), f"{word()} {name}{sep}{quote}", f"{quote} {word()}", path, 1),
                ("long_run", pick(both, int(rng.integers(20, 60))), f"{word()} {name}{sep}{quote}", f"{quote}\n", path, 1),
                ("long_run", rng.choice(["AKIA", "ghp_", "sk_live_", "glpat-", "AIza", "xoxb-"]) + pick(both, 32), f"{word()} ", f" {word()}", path, 1),
                ("jwt", f"eyJ{pick(both, 20)}.eyJ{pick(both, 40)}.{pick(both, 40)}", f"bearer {word()} ", "", path, 1),
                ("password", pick(both + "!#%", 12), f"password{sep}{quote}", quote, path, 1),
                ("password", " ".join(word() for _ in range(int(rng.integers(3, 6)))), f"{rng.choice(['password', 'passphrase'])}{sep}\"", "\"", path, 1),
                ("url_password", pick(both, int(rng.integers(6, 20))), f"{rng.choice(['postgres', 'https', 'amqp', 'redis'])}://{word()}:", f"@{word()}.example/", path, 1),
                ("url_password", rng.choice(["password", "your_password", "example", "changeme"]), f"https://{word()}:", f"@{word()}.example/", "docs/readme.md", 0),
                ("private_key", "-----BEGIN RSA PRIVATE KEY-----" + pick(both, 200) + "-----END RSA PRIVATE KEY-----", "\n", "\n", path, 1),
                ("long_run", pick(hexa, int(rng.choice([32, 40, 64]))), f"{word()} {other} ", f" {word()}", path, 0),
                ("long_run", pick(hexa, 40), f"https://host.example/{word()}/", f"/{word()}", path, 0),
                ("long_run", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), f"{word()} id ", f" {word()}", path, 0),
                ("long_run", pick(digits, int(rng.integers(16, 20))), f"{word()} {word()} ", f" {word()}", path, 0),
                ("long_run", "-".join(word() for _ in range(5)) + pick(digits, 2), f"see {word()} ", ".", path, 0),
                ("long_run", "_".join(word() for _ in range(4)) + "_v" + pick(digits, 1), f"{word()}(", ")", path, 0),
                ("long_run", "/".join(word() for _ in range(5)) + pick(digits, 1), f"{word()} /", " ", path, 0),
                ("long_run", rng.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxx1", "example_token_12345678"]), f"{name}{sep}{quote}", quote, "docs/readme.md", 0),
                ("password", rng.choice(["changeme", "your_password", "example", "********"]), f"password{sep}{quote}", quote, "docs/readme.md", 0)]
    return out


def _spans(text: str | None) -> list[tuple[str, int, int, str, str, str]]:
    return [(n, a, b, text[a:b], text[max(0, a - REACH) : a], text[b : b + REACH]) for n, a, b in candidates(text)] if text else []


def _looks_issued(name: str, value: str, before: str, path: str | None) -> int:
    """The label of a finding of the documents: named as a secret where it is assigned, or of an issuer's form."""
    if _PLACEHOLDER.search(value):
        return 0
    named = re.search(_ASKS.pattern + r"[\"']?\s*[:=]\s*[\"'`]?$", before, re.I)
    return int(name in ("private_key", "jwt", "url_password") or ISSUED.match(value) is not None or bool(named))


@dataclass
class Detector:
    forest: Forest
    language: Language
    threshold: float = 0.5

    def find(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """(pattern, start, end, score) of what the forest keeps, for each text."""
        spans = [_spans(t) for t in texts]
        x = [features(n, v, before, after, path, self.language) for s, path in zip(spans, paths) for n, _, _, v, before, after in s]
        score = iter(self.forest.predict(np.array(x)).tolist() if x else [])
        found = [[(n, a, b, next(score)) for n, a, b, *_ in s] for s in spans]
        return [[f for f in s if f[3] >= self.threshold] for s in found]


def learn_language(texts: DataFrame) -> Language:
    """Letter pairs and leading words of all texts in the one column of ``texts``, without nulls."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(what: str, names: list[str], counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([what] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["what", "name", "n"])

        pairs, words = np.zeros(28 * 28, np.int64), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                codes = _codes(t)
                pairs += np.bincount(codes[:-1] * 28 + codes[1:], minlength=28 * 28)
                words.update(_WORDS.findall(t.lower()))
                if len(words) > HELD:
                    yield rows("word", list(words.keys()), list(words.values()))
                    words = Counter()
        yield rows("word", list(words.keys()), list(words.values()))
        yield rows("pair", [str(i) for i in np.flatnonzero(pairs)], pairs[pairs > 0].tolist())

    counted = texts.mapInArrow(learn, "what string, name string, n long").groupBy("what", "name").agg(F.sum("n").alias("n"))
    # Letter pairs come first, then the leading words.
    top = counted.orderBy("what", F.desc("n"), "name").limit(28 * 28 + DICTIONARY).collect()
    pairs = np.full((28, 28), 0.5)
    for r in top:
        if r.what == "pair":
            pairs[int(r.name) // 28, int(r.name) % 28] += r.n
    return Language(np.log(pairs / pairs.sum(1, keepdims=True)), frozenset([r.name for r in top if r.what == "word"][:DICTIONARY]))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> Detector:
    """Learn letters, a dictionary and the forest from all documents, whatever their ``key``.

    Labelled findings are all different ones of the documents, labelled by the name they are
    assigned to and by issuers' forms, and ``MADE`` of each made family, which together weigh a
    ``PER_MADE``-th of the others at least. The driver gets letter pairs, the leading words, quantiles and counts.
    """
    spark = docs.sparkSession
    where = F.lit(None).cast("string") if path is None else F.col(path).cast("string")
    usable = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"), where.alias("p"))
    language = learn_language(usable.select("t"))
    columns = ["name", "value", "before", "after", "path"]

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, v, before, after, p) for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, _, _, v, before, after in _spans(t)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], columns)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
        labels = batch.column(5).to_pylist()
        return pa.RecordBatch.from_arrays([
            pa.array([features(*r, language) for r in rows], pa.list_(pa.float64())),
            pa.array([_looks_issued(*r[:3], r[4]) if y is None else y for r, y in zip(rows, labels)], pa.int32()),
            pa.array([y is not None for y in labels], pa.bool_()), batch.column(6)], ["x", "y", "made", "h"])

    schema = ", ".join(f"{c} string" for c in columns)
    found = map_arrow(usable, find, schema, rows=256).distinct().withColumn("label", F.lit(None).cast("int"))
    made = spark.createDataFrame([tuple(v if isinstance(v, int) else str(v) for v in r) for r in made_findings()], f"{schema}, label int")
    labelled = found.unionByName(made).withColumn("h", F.xxhash64(*columns))
    return Detector(Forest.of_table(durable(map_arrow(labelled, describe, "x array<double>, y int, made boolean, h long"))), language, threshold)


def findings(docs: DataFrame, detector: Detector, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Rows (key, start, length, pattern, value_sha256, score): the secrets in each whole text.

    Positions count code points from 0. Secrets themselves are not returned. Null and
    empty texts have none; repeated rows give repeated findings; a null key stays null.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [(i, *f) for i, s in enumerate(detector.find(texts, batch.column(2).to_pylist())) for f in s]
        keys = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
        return pa.RecordBatch.from_arrays([
            keys, pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] - f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
            pa.array([hashlib.sha256(texts[f[0]][f[2] : f[3]].encode()).hexdigest() for f in found], pa.string()), pa.array([f[4] for f in found], pa.float64())],
            [key, "start", "length", "pattern", "value_sha256", "score"])

    where = F.lit(None).cast("string") if path is None else F.col(path).cast("string")
    return map_arrow(docs.select(key, F.col(text).cast("string").alias("#text"), where.alias("#path")), run,
                     f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, pattern string, value_sha256 string, score double", rows=256)


def redact(docs: DataFrame, detector: Detector, text: str = "text", path: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; no row goes, null texts stay null, no other column changes."""

    @F.pandas_udf("string")
    def clean(t: pd.Series, p: pd.Series) -> pd.Series:
        texts, out = [x if isinstance(x, str) else None for x in t], []
        for x, found in zip(texts, detector.find(texts, [q if isinstance(q, str) else None for q in p])):
            for _, a, b, _ in reversed(found):
                x = x[:a] + mark + x[b:]
            out.append(x)
        return pd.Series(out, dtype=object)

    where = F.lit(None).cast("string") if path is None else F.col(path).cast("string")
    return docs.withColumn(text, clean(F.col(text), where))
