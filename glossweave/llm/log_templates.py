"""Line dedup by a log-template tree.

A line's tokens are its white-space runs; tokens with a digit, an ``@`` or ``://`` are variable fields.  The tree has
fixed depth: token count, then the LEADING first tokens (variable fields as one wildcard).  Within a leaf
the distinct lines, in the order of their hashes, join the most similar template if at least SIMILAR of its positions
agree (the earliest of equally similar ones); positions that differ become wildcards.  The rule is the same
for leaves of every size.  A template that occurs in at least ``min_docs`` documents recurs, and its lines are
dropped everywhere.

Lines are counted by hash over all documents; only leaves with several distinct lines ship tokens, and each
task ships a line once.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import claim, numbered, remember, written

LEADING = 4
SIMILAR = 0.8
#: Templates of a leaf that are all compared with a line; among more, those that share a segment with it are looked up.
SCANNED = 64
REMEMBERED = 400_000
#: Distinct lines whose tokens a task remembers having shipped.
SHIPPED = 1_000_000
WILDCARD = 0


class _Tokens(dict):
    """32-bit hashes of tokens; all variable fields are WILDCARD."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        variable = not token.isalpha() and (any(c.isdigit() for c in token) or "@" in token or "://" in token)
        got = self[token] = WILDCARD if variable else xxhash.xxh32_intdigest(token.encode("utf-8", "replace")) | 1
        return got


_tokens = remember("log_templates", _Tokens())


def line_tokens(line: str) -> np.ndarray:
    return np.array([_tokens[t] for t in line.split()], dtype="<u4")


def leaf_of(tokens: np.ndarray, depth: int = LEADING) -> int:
    """The leaf's number: token count and leading tokens."""
    got = xxhash.xxh3_64_intdigest(tokens[:depth].tobytes(), seed=len(tokens))
    return got - (1 << 64) if got >> 63 else got


def line_hash(tokens: np.ndarray) -> int:
    got = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=7)
    return got - (1 << 64) if got >> 63 else got


def lines_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, line, leaf, at (line numbers), tokens: one row for each distinct line of a row of ``docs`` (doc_id, text), and one with a null line that has the number of its lines in ``n`` and the row's ``_row``, if there is one.

    Tokens are shipped with a line's first occurrence in a task.  Lines without tokens are only counted.
    """
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64()), ("leaf", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32())), ("tokens", pa.binary()), ("_row", pa.string())]

    def run(batches):
        claim("log_templates")
        shipped: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for row, doc_id, text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n") if text else []
                found: dict[bytes, list[int]] = {}
                for k, line in enumerate(lines):
                    tokens = [_tokens[t] for t in line.split()]
                    if tokens:
                        found.setdefault(np.array(tokens, dtype="<u4").tobytes(), []).append(k)
                out.append((row, doc_id, None, None, len(lines), None, None, key[0] if key else None))
                for raw, at in found.items():
                    tokens = np.frombuffer(raw, dtype="<u4")
                    line = line_hash(tokens)
                    new = line not in shipped
                    if new:
                        if len(shipped) > SHIPPED:
                            shipped.clear()
                        shipped.add(line)
                    out.append((row, doc_id, line, leaf_of(tokens), len(tokens), at, raw if new else None, None))
                    held += len(raw)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    more = [c for c in docs.columns if c == "_row"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return rows.mapInArrow(run, "row long, doc_id long, line long, leaf long, n long, at array<int>, tokens binary, _row string")


def grow_leaf(lines: np.ndarray) -> np.ndarray:
    """The template's number of each row of ``lines`` (tokens, rows in their order).

    A line differs from its template in ``spare`` positions at most, so of spare + 1 segments of the positions that
    vary in the leaf one agrees whole: templates found by segments are all that a scan would take.
    """
    count, width = lines.shape
    spare = width - int(np.ceil(SIMILAR * width))
    segments = np.array_split(np.flatnonzero((lines != lines[0]).any(axis=0)), spare + 1)
    found: dict[tuple[int, bytes], list[int]] = {}
    templates = np.empty((min(count, 16), width), dtype=lines.dtype)
    used = 0
    out = np.zeros(count, dtype=np.int64)

    def keys(row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(k, row[s].tobytes()) for k, s in enumerate(segments)]

    for i, line in enumerate(lines):
        if used <= SCANNED:
            near = np.arange(used)
        else:
            near = np.array(sorted(set().union(*[found.get(k, ()) for k in keys(line)])), dtype=np.int64)
        if len(near):
            same = (templates[near] == line).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= SIMILAR * width:
                best = int(near[best])
                differs = templates[best] != line
                if differs.any():
                    before = keys(templates[best])
                    templates[best][differs] = WILDCARD
                    for old, new in zip(before, keys(templates[best])):
                        if old != new:
                            found.setdefault(new, []).append(best)
                out[i] = best
                continue
        if used == len(templates):
            templates = np.concatenate([templates, np.empty_like(templates)])
        templates[used] = line
        for key in keys(line):
            found.setdefault(key, []).append(used)
        out[i] = used
        used += 1
    return out


def _grow(batches):
    """line, template of merged lines, from rows (leaf, line, tokens) that come leaf by leaf, lines in order."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    lines: list[int] = []
    templates: list[int] = []
    for _, group in groupby(rows(), key=lambda r: (r[0], len(r[2]))):  # one width, unless two leaves share a number
        own = list(group)
        if len(own) > 1:
            number = grow_leaf(np.stack([np.frombuffer(r[2], dtype="<u4") for r in own]))
            first = np.unique(number, return_index=True)[1]
            size = np.bincount(number)
            for r, k in zip(own, number.tolist()):
                if size[k] > 1:
                    lines.append(r[1])
                    templates.append(own[first[k]][1])
        if len(lines) >= 10_000:
            yield pa.record_batch([pa.array(lines, pa.int64()), pa.array(templates, pa.int64())], names=["line", "template"])
            lines, templates = [], []
    yield pa.record_batch([pa.array(lines, pa.int64()), pa.array(templates, pa.int64())], names=["line", "template"])


def generalised(lines: DataFrame) -> DataFrame:
    """line, template (its first line) of the lines that share a template with another line."""
    known = lines.where("line is not null")
    per_leaf = known.groupBy("line").agg(F.first("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    shipped = known.where("tokens is not null").select("line", "leaf", "tokens").join(per_leaf, "leaf")
    single = shipped.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    ordered = single.select("leaf", "line", "tokens").repartition("leaf").sortWithinPartitions("leaf", F.length("tokens"), "line")
    return ordered.mapInArrow(_grow, "line long, template long")


def recurring_lines(docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers) for every row of ``docs`` (doc_id, text), and its ``_row`` if there is one.

    Lines are parts between line ends; a null or empty text has none; lines without tokens stay.  Repeated
    rows are documents of their own, so their lines recur.  Other columns are not read.
    """
    lines = written(lines_of(docs), "lines")
    merged = written(generalised(lines), "templates")
    known = lines.where("line is not null")
    counts = known.groupBy("line").agg(F.count("*").alias("docs"))
    shared = known.select("row", "line").join(merged, "line").select("row", "template").distinct().groupBy("template").agg(F.count("*").alias("template_docs"))
    general = merged.join(shared, "template").select("line", "template_docs")
    recur = counts.join(general, "line", "left").where(F.coalesce("template_docs", "docs") >= min_docs).select("line")
    # rows that only count lines have no line to join by; kept apart, they don't meet in one task
    dropped = known.select("row", "line", "at").join(recur, "line").groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("dropped"))
    whole = lines.where("line is null").select("row", "doc_id", F.col("n").alias("n_lines"), "_row")
    found = whole.join(dropped, "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", *[c for c in docs.columns if c == "_row"])


def drop_recurring(docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """``docs`` with recurring lines cut out of text, all its rows and other columns as they are.

    Rows are told apart by their place in the table, so repeated identifiers and rows stay rows of their own; null and empty texts stay.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = numbered(docs, names)
    text = F.col(at["text"])
    found = recurring_lines(rows.select(F.col(at["doc_id"]).alias("doc_id"), text.alias("text"), "_row"), min_docs).where("n_dropped > 0").select("_row", F.col("dropped").alias("_dropped"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_dropped", i)), "\n")
    cut = F.when(F.col("_dropped").isNotNull(), kept).otherwise(text)
    return rows.join(found, "_row", "left").select(*[(cut if c == "text" else F.col(n)).alias(c) for c, n in at.items()])
