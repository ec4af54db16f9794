"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable, map_arrow

#: Labelled rows at most that are learned from, and unlabelled rows beside them; chosen by hash.
FIT_ROWS = 15_000
#: Terms that make up the mined lexicons, and the number of these lexicons.
TERMS = 400
LEXICONS = 24

#: Seed lexicons (fixed values).
INSULTS = ("idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecile", "cretin", "dimwit", "dunce", "halfwit")
CONTEMPT = ("pathetic", "worthless", "disgusting", "scum", "trash", "garbage", "vermin", "filth", "useless", "repulsive", "vile", "despicable")
HOSTILITY = ("hate", "kill", "die", "hurt", "destroy", "shut", "ugly", "creep", "freak", "liar", "coward", "parasite")
INSULTS_ELSEWHERE = ("idiota", "imbécil", "estúpido", "basura", "asqueroso", "dummkopf", "trottel", "abschaum", "widerlich", "wertlos", "idiote", "crétin", "ordure", "dégoûtant", "minable", "nul")
SEEDS = (INSULTS, CONTEMPT, HOSTILITY, INSULTS_ELSEWHERE)
_ADDRESS = regex.compile(r"(?i)\b(?:you(?:'re| are)?|du|tu|vous|usted|eres|ihr)\b")
_SHOUT = regex.compile(r"\b\p{Lu}{4,}\b")
_BANG = regex.compile(r"[!?]{3,}")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PREFIXES = (5, 7)


def terms(text: str | None) -> tuple[Counter, int]:
    """Counts of the words of a text and of their beginnings, and its number of words."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) >= k:
                out["^" + w[:k]] += n
    return out, sum(words.values())


@dataclass
class Model:
    """What scoring needs: the terms by lexicon, the features' scale, and the weights."""

    term: dict[str, int]
    lexicon: np.ndarray
    odds: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def width(self) -> int:
        return len(self.term) + 2 * LEXICONS + len(SEEDS) + 6

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of term counts, counts and densities by lexicon, and style marks."""
        found, n = terms(text)
        counts = np.zeros(len(self.term))
        for t in self.term.keys() & found.keys():
            counts[self.term[t]] = found[t]
        by = np.bincount(self.lexicon, counts, LEXICONS) if len(counts) else np.zeros(LEXICONS)
        whole, text = max(n, 100), text or ""  # one hit in a short text is no dense hit
        odds = float(counts @ self.odds)
        seeds = [sum(found.get(w, 0) for w in words) for words in SEEDS]
        style = [odds / whole * 10, np.log1p(odds), np.log1p(len(_SHOUT.findall(text)) / whole * 100), np.log1p(len(_BANG.findall(text))),
                 np.log1p(len(_ADDRESS.findall(text)) / whole * 100), np.log1p(whole) / 10]
        return np.concatenate((np.log1p(counts), np.log1p(by), np.minimum(by / whole * 100, 10), np.log1p(seeds), style))

    def votes(self, x: np.ndarray) -> np.ndarray:
        """+1, -1 or 0 (no opinion) of every voter for rows of features.

        A lexicon votes for toxic on a dense hit; all lexicons together, each seed lexicon
        and the style patterns vote too, and silence of all lexicons is a vote for clean.
        """
        k = len(self.term)
        density, seeds, style = x[:, k + LEXICONS : k + 2 * LEXICONS], x[:, k + 2 * LEXICONS : k + 2 * LEXICONS + len(SEEDS)], x[:, -6:]
        total = density.sum(1)
        out = [np.where(density > 0.5, 1, np.where((density == 0) & (total == 0)[:, None], -1, 0)), np.where(seeds > 0, 1, 0),
               np.where(total > 1.0, 1, np.where(total < 0.2, -1, 0))[:, None], np.where(style[:, :1] > 0.5, 1, np.where(style[:, :1] < 0.05, -1, 0)),
               np.where(style[:, 2:3] > 1.0, 1, 0), np.where(style[:, 3:4] > 0, 1, 0), np.where((style[:, 4:5] > 0.7) & (seeds.sum(1)[:, None] > 0), 1, 0)]
        return np.concatenate(out, axis=1).astype(np.int8)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        out = np.zeros(len(texts))
        for start in range(0, len(texts), 256):
            some = texts[start : start + 256]
            x = (np.array([self.features(t) for t in some]).reshape(-1, self.width) - self.mean) / self.scale
            out[start : start + 256] = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))
        return out


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's accuracy, and the voters' correlations.

    Expectation maximisation of a generative model: a class, then each voter's vote given
    the class. Voters that agree beyond what the class explains are correlated; such a
    voter's evidence counts as one over the number of voters it stands for. ``known`` is
    1, 0 or -1 (not labelled); labelled rows keep their label.
    """
    n, m = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    given = known >= 0
    prior = float(np.clip(known[given].mean() if given.any() else 0.1, 0.01, 0.5))
    post = np.where(given, known, prior).astype(float)
    if not given.any():  # nothing labelled: start from the balance of votes
        post = np.clip(prior + 0.3 * np.sign((votes > 0).sum(1) - (votes < 0).sum(1)), 0.01, 0.9)
    weight, corr = np.ones(m), np.zeros((m, m))
    for step in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()])
        like = np.stack([np.einsum("n,nmv->mv", 1 - post, one_hot), np.einsum("n,nmv->mv", post, one_hot)]) + 0.5
        like /= like.sum(2, keepdims=True)
        if step % 5 == 0:
            rest = votes - ((1 - post)[:, None] * (like[0, :, 2] - like[0, :, 0]) + post[:, None] * (like[1, :, 2] - like[1, :, 0]))
            spread = rest.std(0) + 1e-9
            corr = (rest.T @ rest) / max(n, 1) / np.outer(spread, spread)
            np.fill_diagonal(corr, 1)
            weight = 1 / np.maximum(np.clip(corr, 0, 1).sum(1), 1)
        odds = np.log(mass[1] + 1) - np.log(mass[0] + 1) + np.einsum("nmv,mv,m->n", one_hot, np.log(like[1] / like[0]), weight)
        fresh = np.where(given, known, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        done, post = np.abs(fresh - post).max(initial=0) < 1e-4, fresh
        if done:
            break
    spoken = np.maximum((votes != 0).sum(0), 1)
    accuracy = ((votes > 0) * post[:, None] + (votes < 0) * (1 - post)[:, None]).sum(0) / spoken
    return post, accuracy, corr


def _regress(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps, over slices of the rows."""
    n = x.shape[1] + 1
    w, keep = np.zeros(n), np.r_[np.full(n - 1, ridge), 1e-6]
    for _ in range(rounds):
        hessian, slope = np.diag(keep), -keep * w
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            a = np.c_[(part - mean) / scale, np.ones(len(part))]
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian += (a * (p * (1 - p) + 1e-6)[:, None]).T @ a
            slope += a.T @ (y[start : start + 4096] - p)
        step = np.linalg.solve(hessian, slope)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learn from ``docs`` and their ``labels`` (1 or 0); rows to hold out must be left out of both.

    About ``rows`` labelled documents and at most as many others, each chosen by a hash of
    the key at the share that their own number asks for, are learned from. Terms that toxic ones hold more often are mined into lexicons from the
    labelled ones; the label model runs over the votes on all; the classifier is trained
    on its posteriors, which are the labels themselves for labelled documents. The driver gets counts of the leading terms and one row of numbers
    for each chosen document. Where both classes are not labelled, every score is the
    share of toxic labels, smoothed (0.25 without any).
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    n = marks.count()
    step = max(1, -(-n // rows))
    keyed = docs.where(F.col(key).isNotNull()).select(key, F.col(text).cast("string").alias("t"))
    known = durable(keyed.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).join(marks, key).select("t", "y"))
    counts = known.groupBy("y").count().collect()
    n_by = {r[0]: r[1] for r in counts}
    if set(n_by) != {0, 1}:
        share = (n_by.get(1, 0) + 0.5) / (sum(n_by.values()) + 2)
        return Model({}, np.zeros(0, np.int64), np.zeros(0), bias=float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(own)), *(pa.array([v[i] for v in own.values()], pa.int64()) for i in range(4))], ["term", "t_docs", "t_n", "c_docs", "c_n"])
            own.clear()
            return out

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term, k in terms(t)[0].items():
                    v = own.setdefault(term, [0, 0, 0, 0])
                    v[0 if y else 2] += 1
                    v[1 if y else 3] += k
                if len(own) > 200_000:
                    yield flush()
        yield flush()

    seen = known.mapInArrow(count, "term string, t_docs long, t_n long, c_docs long, c_n long").groupBy("term").agg(
        *(F.sum(c).alias(c) for c in ("t_docs", "t_n", "c_docs", "c_n")))
    # Surprise of the toxic count at the clean documents' rate.
    expected = (F.col("c_n") + 1) * n_by[1] / n_by[0] + 0.5
    ranked = seen.where(F.col("t_docs") >= 3).withColumn("z", (F.col("t_n") - expected) / F.sqrt(expected)).withColumn(
        "odds", F.log((F.col("t_n") + 0.5) / expected)).where((F.col("z") > 4) & (F.col("odds") > 0.7))
    top = ranked.orderBy(F.desc("z"), "term").limit(TERMS).select("term", "odds").collect()
    model = Model({r[0]: i for i, r in enumerate(top)}, np.arange(len(top)) % LEXICONS, np.array([min(r[1], 4.0) for r in top]))
    others = unlabelled(keyed, marks, key, rows).select("t", F.lit(-1).alias("y"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [model.features(t).astype("<f4").tobytes() for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "y"])

    rows_ = map_arrow(known.unionByName(others), measure, "x binary, y int", rows=512).toPandas()
    x, y = np.frombuffer(b"".join(rows_["x"]), "<f4").reshape(-1, model.width), rows_["y"].to_numpy()
    del rows_
    post, model.accuracy, model.correlation = label_model(model.votes(x), y)
    model.mean, model.scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6
    model.weights, model.bias = _regress(x, model.mean, model.scale, np.clip(post, 0.005, 0.995))
    return model


def unlabelled(docs: DataFrame, marks: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``docs`` without a mark: all, or those of so small a share of hashes that ``rows`` are not passed.

    The share leaves six standard deviations of such a choice below ``rows``.
    """
    n = docs.select(key).join(marks.select(key), key, "left_anti").count()
    share = 1.0 if n <= rows else max(0.0, rows - 6 * rows**0.5) / n
    return docs.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40))).join(marks.select(key), key, "left_anti")


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, predicted): the probability that each whole text is toxic, and 1 from 0.5 on.

    Null and empty texts are scored as texts without words. Repeated rows and null keys
    come out as they came in; other columns are no input.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                                          [key, "score", "predicted"])

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("#text")), run,
                     f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int", rows=256)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text scores below 0.5; null texts are scored as empty."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(t.tolist()))

    return docs.where(score(F.col(text).cast("string")) < 0.5)
