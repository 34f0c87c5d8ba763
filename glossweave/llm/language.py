"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of the last 0 to ORDER bytes of UTF-8 text, ASCII letters in lower case.  A byte that a
context has not seen costs an escape (as many parts as the context has distinct bytes) and is coded by the next shorter
context, without the bytes already excluded; below the empty context all bytes are equal.  The statistics are frozen, so
a byte's code length in every language is worked out when the trees are fitted: one lookup by its longest known context,
and the escapes from the longer ones.  A text's language is the one with the shortest code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import id_fold

#: Documents of a language that its tree is fitted on at most, first in the order of their hashed identifier.
TRAIN_ROWS = 1500
#: Bytes of the longest contexts; a context and its byte fit eight bytes with their length.
ORDER = 4
#: Bytes scored at once.
PIECE = 1 << 19
UNKNOWN = "und"

#: A-Z to a-z, every other byte as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(FOLD)


def _grams(raw: bytes, size: int) -> np.ndarray:
    """For each byte: the ``size`` bytes that end with it (zeros before the text) as one number."""
    padded = np.frombuffer(bytes(size - 1) + raw, dtype=np.uint8)
    out = np.zeros(len(raw), dtype=np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | padded[k : k + len(raw)]
    return out


class Table:
    """Rows by number: a hash table with open addressing, as arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.rows[at] < 0)
            spot, first = np.unique(at[free], return_index=True)
            self.rows[spot], self.keys[spot] = left[free[first]], keys[left[free[first]]]
            open_ = np.ones(len(left), dtype=bool)
            open_[free[first]] = False
            left, at = left[open_], at[open_] + 1 & len(self.rows) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = self._slot(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = at + 1 & len(self.rows) - 1
            got = self.rows[at]
            out[wrong] = got
            more = (got >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[more], at[more]
        return out


def _tree(grams: list[np.ndarray], counts: list[np.ndarray], languages: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Contexts, escape bits and code bits, by order, of the grams seen (number, and counts by language in rows).

    A seen byte's probability is n / (T + D) for its count, the context's total and its distinct bytes.  Escaping has D
    / (T + D), shared among the other bytes as the shorter context has them.  Rows are those of any language: where a language
    has not seen the byte, its bits are those of the escape and of the shorter context.
    """
    lower = np.full((256, languages), 8.0)  # code bits of the shorter context by its gram's row
    lower_gram = np.arange(256, dtype=np.uint64)
    contexts, escapes, codes = [], [], []
    for order, (gram, n) in enumerate(zip(grams, counts)):
        mask = np.uint64((1 << (8 * order)) - 1) if order else np.uint64(0)
        context, of = np.unique(gram >> np.uint64(8), return_inverse=True)
        below = lower[np.searchsorted(lower_gram, gram & mask if order else gram)]
        seen = n > 0

        def by_context(values: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(of, weights=values[:, k], minlength=len(context)) for k in range(languages)], axis=1)

        total, distinct, taken = by_context(n), by_context(seen), by_context(np.where(seen, np.exp2(-below), 0))
        known, full = total > 0, distinct >= 256
        left = np.where(full, 1, np.maximum(1 - taken, 1e-12))
        whole = np.where(known, total + np.where(full, 0, distinct), 1)
        escape = np.where(known & ~full, -np.log2(np.where(known & ~full, distinct / whole / left, 1)), 0)
        bits = np.where(seen, -np.log2(np.where(seen, n / whole[of], 1)), escape[of] + below)
        contexts.append(context)
        escapes.append(escape)
        codes.append(bits)
        lower, lower_gram = bits, gram
    return contexts, escapes, codes


class Model:
    """Languages and, for each order, the tables of grams and contexts with their bits by language."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.languages = languages
        contexts, escapes, codes = _tree(grams, counts, len(languages))
        self.grams, self.contexts = [Table(g) for g in grams], [Table(c) for c in contexts]
        self.codes, self.escapes = ([x.astype(np.float32) for x in y] for y in (codes, escapes))

    def _add(self, out: np.ndarray, parts: list[tuple[int, bytes, bytes]]) -> None:
        """Add to ``out`` (texts, languages) the bits of parts (number of the text, ORDER bytes before, bytes)."""
        gram = _grams(b"".join([x for _, before, raw in parts for x in (before, raw)]), ORDER + 1)
        sizes = np.array([(ORDER, len(raw)) for _, _, raw in parts]).ravel()
        owner = np.repeat(np.array([(-1, i) for i, _, _ in parts]).ravel(), sizes)
        gram, owner = gram[owner >= 0], owner[owner >= 0]

        def add(rows: np.ndarray, of: np.ndarray, bits: np.ndarray) -> None:
            got = bits[rows]
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(of, weights=got[:, k], minlength=len(out))

        for order in range(ORDER, -1, -1):
            own = gram & np.uint64((1 << (8 * (order + 1))) - 1)
            row = self.grams[order].find(own)
            hit = row >= 0
            add(row[hit], owner[hit], self.codes[order])
            if hit.all():
                return
            gram, owner = gram[~hit], owner[~hit]
            context = self.contexts[order].find(own[~hit] >> np.uint64(8))
            known = context >= 0
            add(context[known], owner[known], self.escapes[order])
        out += 8.0 * np.bincount(owner, minlength=len(out))[:, None]  # bytes that no language has seen

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        parts: list[tuple[int, bytes, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            raw = bytes(ORDER) + folded(text)
            for begin in range(ORDER, len(raw), PIECE):
                part = raw[begin : begin + PIECE]
                parts.append((i, raw[begin - ORDER : begin], part))
                held += len(part) + ORDER
                if held >= PIECE:
                    self._add(out, parts)
                    parts, held = [], 0
        if parts:
            self._add(out, parts)
        return out


def _sample(docs: DataFrame, folds: int, held_out: int, rows: int) -> DataFrame:
    """About ``rows`` documents of each language: those with the smallest hashes; a hundred more at most by chance."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (id_fold("doc_id", folds) != held_out))
    sizes = known.groupBy("lang").count().select("lang", (F.least(F.lit(1.0), rows / F.col("count")) * float(1 << 32)).alias("below"))
    # a row for each language
    return known.join(F.broadcast(sizes), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < F.col("below")).select("text", "lang")


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> Model | None:
    """Frozen trees from text and lang of the documents outside the held-out fold; None without any text.

    Every context of the sample is kept.
    """
    sample = _sample(docs, folds, held_out, rows)

    def tally(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                parts = [_grams(raw, ORDER + 1) for raw in (folded(x or "") for x in texts) if raw]
                if parts:
                    at, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int64), "n": n})

    counted = sample.mapInPandas(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # of the sample
    if counted.empty:
        return None
    languages = sorted(counted["lang"].unique())
    gram, seen = np.unique(counted["gram"].to_numpy().astype(np.uint64), return_inverse=True)
    n = np.zeros((len(gram), len(languages)))
    n[seen, np.searchsorted(languages, counted["lang"].to_numpy(dtype=object))] = counted["n"].to_numpy()
    grams, counts = [], []
    for order in range(ORDER + 1):
        short, at = np.unique(gram & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
        grams.append(short)
        counts.append(np.stack([np.bincount(at, weights=n[:, k], minlength=len(short)) for k in range(len(languages))], axis=1))
    return Model(languages, grams, counts)


def predict(docs: DataFrame, model: Model | None, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; score is the language's share of the likelihood.

    Texts that are null or have no letters are ``und`` with score 0, and so are all without a model.  Of
    languages with equal code lengths the first by name is predicted.  Repeated rows are predicted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            known = [i for i, x in enumerate(texts) if any(map(str.isalpha, x))] if m else []
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if known:
                cost = m.code_lengths([texts[i] for i in known])
                best = cost.argmin(axis=1)
                share = 1 / np.exp2(np.clip(cost.min(axis=1, keepdims=True) - cost, -1000, 0)).sum(axis=1)
                lang[known], score[known] = np.array(m.languages, dtype=object)[best], share
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double").select("doc_id", (id_fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """predict() of every document, fitted on the other folds' documents; see there for nulls, ties and repeated rows.

    An empty table gives no rows; columns other than doc_id, text and lang are not read.
    """
    return predict(docs, fit(docs))
