"""Dependency paths: simple walks of at most L undirected edges of a sentence's tree.

A sentence is a row (doc_id, sent, source, t) whose tokens stay in one array of (word, pos, head, rel).  Workers walk the
sentences of a batch together, as arrays of token numbers: no join and no shuffle but the count's own, and no more memory
than the tokens and paths of a slice take.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import rule_pos, sentences, words

AT = ["doc_id", "sent"]
Test = Callable[[Column], Column]


def trees(documents: DataFrame) -> DataFrame:
    """The sentences of documents with the default parse: a token's head is the one before it, its relation its part of speech."""
    rows = documents.select("doc_id", "source", F.posexplode(sentences(F.col("text"))).alias("sent", "s")).select("doc_id", "sent", "source", words(F.col("s")).alias("w")).where(F.size("w") > 0)
    tagged = F.transform("w", lambda w: F.struct(w.alias("word"), rule_pos(w).alias("pos")))
    rows = rows.select(*AT, "source", tagged.alias("w"))
    return rows.select(*AT, "source", F.transform("w", lambda x, i: F.struct(x["word"].alias("word"), x["pos"].alias("pos"), i.alias("head"), F.lower(x["pos"]).alias("rel"))).alias("t"))


def trees_of(token_rows: DataFrame) -> DataFrame:
    """The sentences of token rows (doc_id, sent, source, tok, word, pos, head, rel); tokens are numbered from 0 without gaps."""
    got = token_rows.groupBy(*AT).agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("tok", "word", "pos", F.col("head").cast("int").alias("head"), "rel"))).alias("t"))
    return got.withColumn("t", F.transform("t", lambda x: F.struct(x["word"].alias("word"), x["pos"].alias("pos"), x["head"].alias("head"), x["rel"].alias("rel"))))


#: Tokens whose paths are walked at once, which bounds a worker's memory; a longer sentence is a slice of its own.
SLICE = 1 << 16
#: Paths that leave a worker in one batch.
ROWS = 1 << 17


def _edges(head: np.ndarray, rel: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's tokens the edges in both directions, by the token they leave: where each token's begin, their other end and their relation.

    ``head`` is 1-based within the sentence, which begins at ``first`` and has ``size`` tokens; heads outside it are none.
    """
    kid = np.flatnonzero((head > 0) & (head <= size))
    up = first[kid] + head[kid] - 1
    at, to, name = np.concatenate([kid, up]), np.concatenate([up, kid]), np.concatenate([rel[kid], rel[kid]])
    order = np.argsort(at, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(head)))]), to[order], name[order]


def _walk(starts: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], length: int, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """hops, and src, dst and code (relations as digits of ``base``, from 1) of the simple paths of 1, 2 ... ``length`` edges."""
    begin, to, rel = edges
    walked, code = [starts], np.zeros(len(starts), np.int64)
    for hops in range(1, length + 1):
        low = begin[walked[-1]]
        many = begin[walked[-1] + 1] - low
        back = np.repeat(np.arange(len(many)), many)
        edge = np.arange(len(back)) + np.repeat(low - np.cumsum(many) + many, many)
        onward = to[edge]
        new = np.ones(len(back), bool)
        for seen in walked:
            new &= seen[back] != onward
        back, edge = back[new], edge[new]
        walked, code = [*(seen[back] for seen in walked), onward[new]], code[back] * base + rel[edge] + 1
        yield hops, walked[0], walked[-1], code


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sentences (from, to) of SLICE tokens at most, or of one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, stop
        at = stop


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _found(batch: pa.RecordBatch, length: int, ends: bool, first: bool) -> Iterator[tuple[dict[str, np.ndarray], dict[str, pa.Array]]]:
    """For each slice its paths as numbers (row, src, dst, hops, path, last_rel, at and b of the ends' words), and what tokens, paths and relations are.

    With ``first`` only the first path of two ends stays: the shortest, then the smallest.
    """
    column = batch.column("t")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    token = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for low, high in _slices(sizes):
        begin, n = bounds[low], bounds[high] - bounds[low]
        if not n:
            continue
        own = {name: values.slice(begin, n) for name, values in token.items()}
        row = np.repeat(np.arange(low, high), sizes[low:high])
        start = bounds[row] - begin
        rel, names = _numbered(own["rel"])
        base = len(names) + 1
        if base**length >= 1 << 62:
            raise ValueError(f"{len(names)} relations in one slice are too many for paths of {length} edges")
        edges = _edges(own["head"].fill_null(0).to_numpy(zero_copy_only=False), rel, start, sizes[row])
        keep = own["keep"].to_numpy(zero_copy_only=False)
        end = own["end"].to_numpy(zero_copy_only=False) if ends else None
        parts = []
        for hops, src, dst, code in _walk(np.flatnonzero(keep), edges, length, base):
            if end is not None:
                good = end[dst]
                src, dst, code = src[good], dst[good], code[good]
            parts.append((np.full(len(src), hops), src, dst, code))
        hops, src, dst, code = (np.concatenate(x) for x in zip(*parts))
        codes, path = np.unique(code, return_inverse=True)
        text = [_path(int(c), base, names) for c in codes]
        if first and len(src):
            order = np.argsort(np.argsort(np.array(text, dtype=object), kind="stable"), kind="stable")[path]  # places of the paths by their text
            by = np.lexsort([order, hops, dst, src])
            lead = by[np.concatenate([[True], (src[by][1:] != src[by][:-1]) | (dst[by][1:] != dst[by][:-1])])]
            hops, src, dst, code, path = hops[lead], src[lead], dst[lead], code[lead], path[lead]
        yield (
            {"row": row[src], "src": src - start[src], "dst": dst - start[src], "hops": hops, "path": path, "last_rel": code % base - 1, "a": src, "b": dst},
            {**own, "paths": pa.array(text, pa.string()), "rels": names},
        )


def _path(code: int, base: int, names: pa.Array) -> str:
    out = ""
    while code:
        code, digit = divmod(code, base)
        out = f"{names[digit - 1].as_py()}:{out}"
    return out


def _ready(sentence_rows: DataFrame, word: Test, keep: Test, keep_end: Test | None) -> DataFrame:
    """Sentences as the walk takes them: tokens with the tests' results."""

    def token(x: Column) -> Column:
        more = [F.coalesce(keep_end(x), F.lit(False)).alias("end")] if keep_end is not None else []
        return F.struct(word(x).alias("word"), x["pos"].alias("pos"), x["head"].cast("int").alias("head"), x["rel"].alias("rel"), F.coalesce(keep(x), F.lit(False)).alias("keep"), *more)

    return sentence_rows.select(*AT, "source", F.transform("t", token).alias("t"))


def word_paths(sentence_rows: DataFrame, keep: Test, length: int, keep_end: Test | None = None, first: bool = False) -> DataFrame:
    """doc_id, sent, source, src, dst, hops, path (``rel:`` for each edge), last_rel, and word and pos of both ends, of every path of at most ``length`` edges.

    Paths lead from tokens that satisfy ``keep`` to those that satisfy ``keep_end``; with ``first`` the shortest, then smallest one of two ends.
    """
    ends = keep_end is not None
    schema = {f.name: f.dataType.simpleString() for f in sentence_rows.schema}
    out = [*AT, "source", "src", "dst", "hops", "path", "last_rel", "word_a", "pos_a", "word_b", "pos_b"]
    kinds = {**{c: schema[c] for c in (*AT, "source")}, **dict.fromkeys(("src", "dst", "hops"), "int"), **dict.fromkeys(out[6:], "string")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got, known in _found(batch, length, ends, first):
                for k in range(0, len(got["row"]), ROWS):
                    x = {name: values[k : k + ROWS] for name, values in got.items()}
                    own = [batch.column(c).take(pa.array(x["row"])) for c in (*AT, "source")] + [pa.array(x[c].astype(np.int32)) for c in ("src", "dst", "hops")]
                    own += [known["paths"].take(pa.array(x["path"])), known["rels"].take(pa.array(x["last_rel"]))]
                    own += [known[c].take(pa.array(x[at])) for at in ("a", "b") for c in ("word", "pos")]
                    yield pa.RecordBatch.from_arrays(own, out)

    return _ready(sentence_rows, lambda x: x["word"], keep, keep_end).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out))


def path_counts(sentence_rows: DataFrame, keep: Test, length: int, keep_end: Test | None = None, by: tuple[str, ...] = ("word_a", "word_b", "source", "path"), first: bool = False) -> DataFrame:
    """``by`` columns of word_paths(), words in lower case, and n of its paths: counted slice by slice in the workers, then over all."""
    return summed(slice_counts(sentence_rows, keep, length, keep_end, by, first), *by)


def summed(counts: DataFrame, *by: str) -> DataFrame:
    """``by`` and the sum of n.  Counts of words go to their partitions first: tasks that read the corpus would gather nearly all their pairs in memory and merge few."""
    rows = counts.repartition(*by) if any(c.startswith("word_") for c in by) else counts
    return rows.groupBy(*by).agg(F.sum("n").alias("n"))


def slice_counts(sentence_rows: DataFrame, keep: Test, length: int, keep_end: Test | None, by: tuple[str, ...], first: bool = False) -> DataFrame:
    """The counts of path_counts() of each slice."""
    ends = keep_end is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, sources = _numbered(batch.column("source")) if "source" in by else (None, None)
            for got, known in _found(batch, length, ends, first):
                word, words_ = _numbered(known["word"])
                what = {"word_a": (word, got["a"], words_), "word_b": (word, got["b"], words_), "source": (source, got["row"], sources), "path": (None, got["path"], known["paths"]), "last_rel": (None, got["last_rel"], known["rels"])}
                cols = [(x[at] if x is not None else at, values) for x, at, values in (what[c] for c in by)]
                digits, n = [numbers for numbers, _ in cols], np.ones(len(got["row"]), np.int64)
                if math.prod(len(values) + 1 for _, values in cols) < 1 << 62:  # else Spark counts them all
                    key = np.zeros(len(n), np.int64)
                    for numbers, values in cols:
                        key = key * (len(values) + 1) + numbers
                    key, n = np.unique(key, return_counts=True)
                    for k in reversed(range(len(cols))):
                        key, digits[k] = np.divmod(key, len(cols[k][1]) + 1)
                arrays = [values.take(pa.array(x)) for x, (_, values) in zip(digits, cols)]
                for k in range(0, len(n), ROWS):
                    yield pa.RecordBatch.from_arrays([*(x.slice(k, ROWS) for x in arrays), pa.array(n[k : k + ROWS])], [*by, "n"])

    rows = _ready(sentence_rows, lambda x: F.lower(x["word"]), keep, keep_end)
    return rows.mapInArrow(run, ", ".join([*(f"{c} string" for c in by), "n long"]))


def cooccurrence(found: DataFrame, with_relation: bool = True) -> DataFrame:
    """word, other (``word-rel`` of the last edge, or the bare word), n, from word_paths() or path_counts()."""
    other = F.lower("word_b")
    if with_relation:
        other = F.concat(other, F.lit("-"), F.col("last_rel"))
    rows = found.select(F.lower("word_a").alias("word"), other.alias("other"), F.col("n") if "n" in found.columns else F.lit(1).cast("long").alias("n"))
    return rows.repartition("word", "other").groupBy("word", "other").agg(F.sum("n").alias("n"))


def noun_pairs(found: DataFrame) -> DataFrame:
    """noun1, noun2, source, path, cnt: evidence of word pairs in long form, from word_paths() or path_counts(); words with a colon are left out."""
    rows = found.select(F.lower("word_a").alias("noun1"), F.lower("word_b").alias("noun2"), "source", "path", *(["n"] if "n" in found.columns else []))
    rows = rows.where(~F.col("noun1").contains(":") & ~F.col("noun2").contains(":"))
    if "n" in found.columns:  # counted already
        return rows.withColumnRenamed("n", "cnt")
    return rows.groupBy("noun1", "noun2", "source", "path").agg(F.count("*").alias("cnt"))


def path_count(evidence: DataFrame) -> DataFrame:
    """path, n of evidence (path, cnt)."""
    return evidence.groupBy("path").agg(F.sum("cnt").alias("n"))


def relation_tuples(sentence_rows: DataFrame, heads: Test) -> DataFrame:
    """head_word, rel, dependent, n of edges whose head satisfies ``heads`` and has a noun, verb or adjective tag."""
    rows = sentence_rows.select("t", F.explode(F.filter("t", lambda x: x["head"] > 0)).alias("c")).select("c", F.get("t", F.col("c.head") - 1).alias("h"))
    rows = rows.where(F.substring("h.pos", 1, 1).isin("N", "V", "J") & heads(F.col("h")))
    return rows.groupBy(F.lower("h.word").alias("head_word"), F.col("c.rel").alias("rel"), F.lower("c.word").alias("dependent")).agg(F.count("*").alias("n"))


def evidence_buckets(counts: DataFrame, above: DataFrame, lemmas: list[str], listed: list[str]) -> DataFrame:
    """bucket, noun1, noun2, path, cnt of first paths' counts (word_a, word_b, path, n): of pairs of ``lemmas``; of others only if the first word is listed.

    ``above`` (a, b) names known hypernym pairs; any other pair of lemmas is negative.
    """
    rows = counts.select(F.col("word_a").alias("noun1"), F.col("word_b").alias("noun2"), "path", F.col("n").alias("cnt"))
    known = F.col("noun1").isin(lemmas) & F.col("noun2").isin(lemmas)
    rows = rows.where(known | F.col("noun1").isin(listed)).join(above.select(F.col("a").alias("noun1"), F.col("b").alias("noun2"), F.lit(True).alias("is")), ["noun1", "noun2"], "left")
    bucket = F.when(F.col("is"), "positive").when(known, "negative").otherwise("unknown")
    return rows.select(bucket.alias("bucket"), "noun1", "noun2", "path", "cnt")
