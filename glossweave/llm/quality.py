"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

A text's features are its words, its pairs of neighbouring words, and the shapes (case, length class and
the marks around a word) of its words and pairs, hashed into ``2**BITS`` buckets.  Counts are damped by a
square root and scaled to unit length, so that a score is one sparse dot product over the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import claim, id_fold, remember

BITS = 18
#: Labelled documents that the model is fitted on at most: the first in the order of their hashed identifier.
TRAIN_ROWS = 6000
#: Updates that training makes at least, by going over a small sample more often, but never more often than PASSES[1].
UPDATES, PASSES = 24_000, (3, 40)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.2
REMEMBERED = 150_000

_WORD = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


def _shape(unit: str) -> str:
    head, core, tail = _WORD.match(unit).groups()
    case = "u" if core.isupper() and len(core) > 1 else "t" if core[:1].isupper() else "l" if core.islower() else "d" if core.isdigit() else "m"
    return f"{head[:3]}\0{case}{min(len(core).bit_length(), 5)}{'x' if any(not c.isalnum() for c in core) else ''}\0{tail[:4]}"


class _Units(dict):
    """Hashes of a white-space unit: of its word and of its shape."""

    def __missing__(self, unit: str) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        word = unit.lower().strip(".,;:!?\"'()")
        got = xxhash.xxh3_64_intdigest(word, seed=1), xxhash.xxh3_64_intdigest(_shape(unit), seed=2)
        self[unit] = got
        return got


_units = remember("quality", _Units())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (uint32) and values (float32) of a text; none for a text without words."""
    units = (text or "").split()
    if not units:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    both = np.array([_units[x] for x in units], dtype=np.uint64)
    word, shape = both[:, 0], both[:, 1]
    parts = [word, shape]
    if len(units) > 1:
        same = (word[1:] == word[:-1]).astype(np.uint64) + np.uint64(77)
        parts += [(word[:-1] * _MIX) ^ (word[1:] + np.uint64(3)), (shape[:-1] * _MIX) ^ (shape[1:] + np.uint64(5)), same * _MIX]
    with np.errstate(over="ignore"):
        buckets = (np.concatenate(parts) * _MIX) >> np.uint64(64 - BITS)
    at, n = np.unique(buckets, return_counts=True)
    value = np.sqrt(n)
    return at.astype(np.uint32), (value / np.sqrt((value * value).sum())).astype(np.float32)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal updates of a logistic regression."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents outside the held-out fold; without any, all weights are 0.

    Repeated labels of a document count once, at their largest; null labels don't count.  The last weight is the bias.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).dropna().where(id_fold("doc_id", folds) != held_out)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches):
        claim("quality")
        for pdf in batches:
            pairs = [features(x) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": [x.tobytes() for x, _ in pairs], "value": [x.tobytes() for _, x in pairs]})

    # at most ``rows`` identifiers and labels
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(run, "doc_id long, label int, at binary, value binary")
    got = sample.toPandas().sort_values(["doc_id", "label", "at"], key=lambda c: c if c.name != "doc_id" else c.map(lambda x: xxhash.xxh3_64_intdigest(str(x)))).reset_index(drop=True)
    model = FollowTheLeader((1 << BITS) + 1)
    bias = np.uint32(1 << BITS)
    for _ in range(min(PASSES[1], max(PASSES[0], UPDATES // max(1, len(got))))):
        for label, at, value in zip(got["label"], got["at"], got["value"]):
            model.learn(np.append(np.frombuffer(at, np.uint32), bias), np.append(np.frombuffer(value, np.float32), np.float32(0.3)), int(label))
    return model.weights(slice(None)).astype(np.float32)


def _scores(texts, weights: np.ndarray) -> np.ndarray:
    """Score of each text: a sparse dot product in double precision, so that every caller decides alike."""
    dots = np.array([weights[at] @ value for at, value in map(features, texts)]) if len(texts) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(dots + 0.3 * weights[-1], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row; a text without words (or null) gets the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        claim("quality")
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": _scores(pdf["text"], shared.value)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, learned from the other folds' labels.

    Null and empty texts get the bias's score, repeated rows a row each, null identifiers are in fold 0; without labels
    every score is 0.5; an empty table gives no rows; other columns are not read.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score_quality() predicts as 1, all their columns as they are.

    Rows are judged by their own text, so repeated identifiers and rows don't matter; extra columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).astype(np.float64))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        claim("quality")
        return pd.Series(_scores(texts, shared.value))

    return docs.where(scored("text") >= threshold)
