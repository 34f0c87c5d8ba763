"""Corpus statistics: partial aggregates in each task, one shuffle on the counted key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import _WORD, clean_term, low_words, rule_pos, space_tokens
from glossweave.functions.text import words as words_of


def token_count(documents: DataFrame) -> DataFrame:
    """word, n of cleaned white-space tokens; tokens that clean to nothing count as the empty word."""
    raw = documents.select(F.explode(space_tokens(F.col("text"))).alias("raw"))
    # raw forms are counted first, so that each distinct form is cleaned once
    return raw.groupBy("raw").agg(F.count("*").alias("n")).groupBy(clean_term(F.col("raw")).alias("word")).agg(F.sum("n").alias("n"))


def count_by(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def compound_count(documents: DataFrame, compounds: list[str]) -> DataFrame:
    """word, n of lower-case words, listed compounds of two words or more taken as one; matching is greedy from the left, the longest first.

    A worker passes each document once: of the places where a compound begins, one stands if it begins after the last one that stands
    has ended.  Words in standing matches are taken off the count of all words.
    """
    starts: dict[str, list[list[str]]] = {}
    for c in compounds:
        parts = c.split(" ")
        if len(parts) > 1:
            starts.setdefault(parts[0], []).append(parts)
    for own in starts.values():
        own.sort(key=len, reverse=True)

    def count(text: str, n: Counter) -> None:
        found = [w.lower() for w in _WORD.findall(text)]
        n.update(found)
        free = 0
        for i in [i for i, w in enumerate(found) if w in starts]:
            if i >= free:
                for parts in starts[found[i]]:
                    if found[i : i + len(parts)] == parts:
                        n.subtract(parts)
                        n[" ".join(parts)] += 1
                        free = i + len(parts)
                        break

    return _summed(documents, count).where("n > 0")


def _summed(documents: DataFrame, count: Callable[[str, Counter], None]) -> DataFrame:
    """word, n of what ``count`` adds up of each text: by batches in the workers, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    count(text, n)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def term_document(documents: DataFrame) -> DataFrame:
    """doc_id, word, n, counted in the document's row; only if identifiers are repeated their counts are summed over a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                counts = [Counter(_WORD.findall(text or "")) for text in part.column("text").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["doc_id", "word", "n"])

    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, word string, n long")
    return rows.groupBy("doc_id", "word").agg(F.sum("n").alias("n")) if repeated(documents) else rows


def repeated(documents: DataFrame) -> bool:
    """Whether identifiers occur more than once."""
    return not documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def doc_cooccurrence(documents: DataFrame, listed: list[str]) -> DataFrame:
    """term, other, n over documents: ('', t) for a document's distinct listed words and (t, u) for each ordered pair, t = u too."""
    terms = F.array_distinct(F.filter(low_words(F.col("text")), lambda w: w.isin(listed)))
    rows = documents.select(terms.alias("terms")).where(F.size("terms") > 0).select(F.explode("terms").alias("other"), "terms")
    pairs = rows.select(F.explode(F.concat(F.array(F.lit("")), F.col("terms"))).alias("term"), "other")
    return count_by(pairs, "term", "other")


def window_pairs(documents: DataFrame, listed: list[str], width: int) -> DataFrame:
    """word, pos, other, other_pos, distance of listed words at most ``width`` tokens apart, sentence ends ignored.

    A document's listed tokens stay in one array in the order of their positions, so a word's right
    neighbours are among the next ``width`` elements and no shuffle or join is needed.
    """
    near = F.transform(low_words(F.col("text")), lambda w, i: F.struct(i.alias("gpos"), w.alias("word")))
    rows = documents.select(F.filter(near, lambda t: t["word"].isin(listed)).alias("t")).where(F.size("t") > 1)
    rows = rows.select(F.posexplode("t").alias("i", "f"), "t")
    right = F.filter(F.slice("t", F.col("i") + 2, F.lit(width)), lambda c: c["gpos"] - F.col("f.gpos") <= width)
    rows = rows.select("f", F.explode(right).alias("c"))
    gap = F.col("c.gpos") - F.col("f.gpos")

    def side(a: str, b: str, sign: int) -> Column:
        return F.struct(F.col(f"{a}.word").alias("word"), F.col(f"{b}.word").alias("other"), (gap * sign).alias("distance"))

    rows = rows.select(F.explode(F.array(side("f", "c", 1), side("c", "f", -1))).alias("p")).select("p.*")
    return rows.select("word", rule_pos(F.col("word")).alias("pos"), "other", rule_pos(F.col("other")).alias("other_pos"), "distance")


def window_totals(documents: DataFrame, listed: list[str], width: int) -> DataFrame:
    """word, n: over a listed word's occurrences, the number of tokens of any kind in its window; a worker passes each document once."""
    words_ = set(listed)

    def count(text: str, n: Counter) -> None:
        found = [w.lower() for w in _WORD.findall(text)]
        last = len(found) - 1
        for i, w in enumerate(found):
            if w in words_:
                n[w] += min(i, width) + min(last - i, width)

    return _summed(documents, count)


def window_counts(documents: DataFrame, listed: list[str], width: int) -> DataFrame:
    """word, pos, other, other_pos, distance, n: the pairs of window_pairs(), counted.

    A document's listed tokens are numbers in one array, so those a step apart are met together; workers count them by 512 documents.
    """
    code = {w: k for k, w in enumerate(listed)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(listed, pa.string())
        for texts in (batch.column("text").slice(low, 512) for batch in batches for low in range(0, batch.num_rows, 512)):
            keys = []
            for text in texts.to_pylist():
                found = np.array([code.get(w.lower(), -1) for w in _WORD.findall(text or "")], np.int64)
                for gap in range(1, width + 1):
                    a, b = found[:-gap], found[gap:]
                    met = (a >= 0) & (b >= 0)
                    keys.append((a[met] * len(listed) + b[met]) * (width + 1) + gap)
            key, n = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
            pair, gap = np.divmod(key, width + 1)
            a, b = (names.take(pa.array(x)) for x in np.divmod(pair, max(1, len(listed))))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.array(np.concatenate([gap, -gap])), pa.array(np.concatenate([n, n]))], ["word", "other", "distance", "n"])

    rows = documents.select("text").mapInArrow(run, "word string, other string, distance long, n long").groupBy("word", "other", "distance").agg(F.sum("n").alias("n"))
    return rows.select("word", rule_pos(F.col("word")).alias("pos"), "other", rule_pos(F.col("other")).alias("other_pos"), F.col("distance").cast("int").alias("distance"), "n")


def sum_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def context_vectors(documents: DataFrame, listed: list[str], width: int, by: str = "word") -> DataFrame:
    """doc_id, gpos, word, context: one row for each listed occurrence with the counts of the listed words in its window, ``n,word`` joined by bars.

    ``by`` tells what is counted: the ``word``, the word and its part of speech (``pos``), or the word and its distance (``order``).
    """
    near = F.transform(low_words(F.col("text")), lambda w, i: F.struct(i.alias("gpos"), w.alias("word")))
    rows = documents.select("doc_id", F.filter(near, lambda t: t["word"].isin(listed)).alias("t"))
    rows = rows.select("doc_id", F.posexplode("t").alias("i", "f"), "t")
    left = F.greatest(F.col("i") - width, F.lit(0))
    around = F.filter(F.slice("t", left + 1, F.lit(2 * width + 1)), lambda c: (F.abs(c["gpos"] - F.col("f.gpos")) <= width) & (c["gpos"] != F.col("f.gpos")))

    def counted(c: Column) -> Column:
        mark = {"word": None, "pos": rule_pos(c["word"]), "order": (c["gpos"] - F.col("f.gpos")).cast("string")}[by]
        return c["word"] if mark is None else F.concat(c["word"], F.lit("-"), mark)

    rows = rows.select("doc_id", "f.gpos", "f.word", F.transform(around, counted).alias("w"))
    counts = F.transform(F.array_sort(F.array_distinct("w")), lambda x: F.concat(F.size(F.filter("w", lambda y: y == x)).cast("string"), F.lit(","), x))
    return rows.select("doc_id", "gpos", "word", F.array_join(counts, "|").alias("context"))


def path_contexts(found: DataFrame) -> DataFrame:
    """doc_id, sent, src, word, context of the starts of dependency paths: the words at their ends with the last relation, counted as in context_vectors()."""
    found = found.repartition("doc_id", "sent")  # which serves both groupings
    rows = found.groupBy("doc_id", "sent", "src", F.lower("word_a").alias("word"), F.concat(F.lower("word_b"), F.lit("-"), "last_rel").alias("other")).agg(F.count("*").alias("n"))
    one = F.struct("other", F.concat(F.col("n").cast("string"), F.lit(","), "other").alias("text"))
    rows = rows.groupBy("doc_id", "sent", "src", "word").agg(F.sort_array(F.collect_list(one)).alias("c"))  # a sentence's words at most
    return rows.select("doc_id", "sent", "src", "word", F.array_join(F.col("c.text"), "|").alias("context"))


def tag_occurrence(rows: DataFrame) -> DataFrame:
    return count_by(rows.select(F.explode("categories").alias("tag")), "tag")


def tag_network(rows: DataFrame) -> DataFrame:
    """tag_a < tag_b, n: unordered category pairs of a document; categories are sorted, so a pair is an element and a later one."""
    pairs = rows.select(F.posexplode("categories").alias("i", "tag_a"), "categories").select("tag_a", F.explode(F.slice("categories", F.col("i") + 2, F.size("categories"))).alias("tag_b"))
    return count_by(pairs, "tag_a", "tag_b")


def tag_words(rows: DataFrame) -> DataFrame:
    """tag, word, n: words are counted by document first, then multiplied out to its tags."""
    words = rows.select("categories", F.explode(words_of(F.col("raw_text"))).alias("word"))
    counted = words.groupBy("categories", "word").agg(F.count("*").alias("n"))
    return counted.select(F.explode("categories").alias("tag"), "word", "n").groupBy("tag", "word").agg(F.sum("n").alias("n"))


def frequencies(counts: DataFrame) -> DataFrame:
    """word, n, frequency (n over all n)."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("word", "n", F.round(F.col("n") / F.col("total"), 12).alias("frequency"))  # one row


def top_terms(counts: DataFrame, n: int, most: bool = True) -> DataFrame:
    return counts.orderBy(F.desc("n") if most else F.asc("n"), "word").limit(n)


def basis(counts: DataFrame, key: str, n: int) -> DataFrame:
    """key, n, dim: the ``n`` most frequent keys numbered from 0, ties by key."""
    top = counts.orderBy(F.desc("n"), key).limit(n)
    return top.select(key, "n", (F.row_number().over(Window.orderBy(F.desc("n"), key)) - 1).cast("long").alias("dim"))  # at most n rows


def agreement(votes: DataFrame, models: int) -> DataFrame:
    """Lines that exactly ``models`` models report."""
    return votes.groupBy("line").agg(F.count_distinct("model").alias("models")).where(F.col("models") == models)


def similarity_spread(sims: DataFrame) -> DataFrame:
    """cluster, five points of the sorted similarities by index (0, n/4, n/2, 3n/4, last), total, objective (total over n (n + 1) / 2 items' pairs).

    Ranks come from sorting within clusters, so no cluster is gathered into one value.
    """
    w = Window.partitionBy("cluster")
    ranked = sims.withColumn("i", F.row_number().over(w.orderBy("sim", "item")) - 1).withColumn("n", F.count("*").over(w))
    at = {"low": F.lit(0), "q1": F.floor(F.col("n") / 4), "median": F.floor(F.col("n") / 2), "q3": F.floor(F.col("n") * 3 / 4), "high": F.col("n") - 1}
    picks = [F.max(F.when(F.col("i") == k, F.col("sim"))).alias(name) for name, k in at.items()]
    done = ranked.groupBy("cluster").agg(F.max("n").alias("n"), *picks, F.sum("sim").alias("total"))
    return done.withColumn("objective", F.round(F.col("total") / (F.col("n") * (F.col("n") + 1) / 2), 6)).withColumn("total", F.round("total", 4))
