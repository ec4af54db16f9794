"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow

DIMENSIONS = 1024
GRAM = 3
SEED = 20240601
#: n-gram vectors that a task remembers.
MEMORY = 12_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 32, np.uint64)
    for c in range(0x110000):
        if (char := chr(c)).isalpha():
            low = char.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _forget() -> None:
    _space.cache_clear()


class Space:
    """Random letter vectors of +1 and -1, and the n-gram vectors bound from them.

    The vector of an n-gram is the product of its letters' vectors, each rotated by its
    distance from the end, so that order counts. A letter's vector follows from the seed
    and its code point alone: all tasks agree without a table.
    """

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.bits = 63 // gram
        self.letter_of: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((256, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        found = self.letter_of.get(code)
        if found is None:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            found = self.letter_of[code] = (2 * bits - 1).astype(np.float32)
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's n-grams as packed keys, with their counts; none if it has no letter."""
        codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        if len(codes) < 3:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = len(codes) - self.gram + 1
        if n < 1:
            codes, n = np.concatenate((codes, np.full(self.gram, 32, np.uint64))), 1
        keys = np.zeros(n, np.uint64)
        for k in range(self.gram):
            keys = (keys << np.uint64(self.bits)) | codes[k : k + n]
        return np.unique(keys, return_counts=True)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Where in ``vectors`` the keys' vectors are."""
        names = keys.tolist()
        new = [k for k in names if k not in self.row]
        if new:
            if len(self.row) + len(new) > MEMORY:
                self.row.clear()
                new = names
            while len(self.row) + len(new) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            for key in new:
                bound = np.ones(self.dimensions, np.float32)
                for k in range(self.gram):
                    code = (key >> (self.bits * (self.gram - 1 - k))) & ((1 << self.bits) - 1)
                    bound = bound * np.roll(self.letter(code), self.gram - 1 - k)
                self.vectors[len(self.row)] = bound
                self.row[key] = len(self.row)
        return np.array([self.row[k] for k in names], np.int64)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-gram vectors, each as often as it occurs."""
        total = np.zeros(self.dimensions)
        for start in range(0, len(keys), MEMORY // 2):
            some = slice(start, start + MEMORY // 2)
            at = self.rows(keys[some])  # may replace self.vectors
            total += counts[some].astype(np.float32) @ self.vectors[at]
        return total


@lru_cache(maxsize=1)
def _space(dimensions: int, gram: int, seed: int) -> Space:
    return Space(dimensions, gram, seed)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", space: tuple = (DIMENSIONS, GRAM, SEED)) -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all its texts' n-gram vectors, of length one.

    Each task bundles its own texts by language; the sums are added by (language,
    dimension) with map-side combining. The driver gets one vector for each language.
    Rows without a text or a language, or without letters, add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = _space(*space), {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                sums[name] = sums.get(name, 0) + own.bundle(*own.counts("\n".join(texts)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    source = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).dropna()
    summed = source.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found: dict[str, np.ndarray] = {}
    for name, at, x in summed.toLocalIterator():
        found.setdefault(name, np.zeros(space[0]))[at] = x
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", space: tuple = (DIMENSIONS, GRAM, SEED)) -> DataFrame:
    """Rows (key, lang_pred, score): the language whose prototype has the largest cosine.

    The score is that cosine, zero where it is negative. Texts that are null or have no
    letter, and all texts where nothing was learned, are ``und`` with score 0. Ties go to
    the first language by name. Repeated rows and null keys come out as they came in;
    other columns are ignored.
    """
    names, matrix = list(prototypes), np.array([prototypes[k] for k in prototypes]).reshape(len(prototypes), space[0])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, langs, scores = _space(*space), [], []
        for t in batch.column(1).to_pylist():
            keys, counts = own.counts(t or "")
            best, score = UNKNOWN, 0.0
            if len(keys) and names:
                vector = own.bundle(keys, counts)
                cosine = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
                best, score = names[int(np.argmax(cosine))], float(np.clip(cosine.max(), 0, 1))
            langs.append(best), scores.append(score)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("#text")), run,
                     f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double", rows=256, done=_forget)
