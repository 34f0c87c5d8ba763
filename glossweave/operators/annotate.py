"""Annotation: sentences and tokens as nested rows, stems, and dependency parses by a pluggable parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.stem import stem_all
from glossweave.functions.text import rule_pos, sentences, spanned_words, words

Heads = Callable[[list[str], list[str]], list[tuple[int, str]]]


def stem_tokens(text: Column) -> Column:
    return stem_all(words(text))


def annotated(documents: DataFrame) -> DataFrame:
    """doc_id, sent, sentence, tokens (word, pos, start, end) of every sentence; spans are relative to it."""
    rows = documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent", "sentence"))
    tagged = F.transform("w", lambda x: F.struct(x["word"].alias("word"), rule_pos(x["word"]).alias("pos"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("w", spanned_words(F.col("sentence"))).select("doc_id", "sent", "sentence", tagged.alias("tokens"))


def chain_heads(forms: list[str], tags: list[str]) -> list[tuple[int, str]]:
    """Each token's head is the one before it (1-based; 0 for the first), its relation its tag in lower case."""
    return [(i, tag.lower()) for i, tag in enumerate(tags)]


def parsed(rows: DataFrame, parser: Heads = chain_heads, longest: int = 100) -> DataFrame:
    """``rows`` (doc_id, sent, tokens) as doc_id, sent, tok, word, pos, head, rel; sentences of no or more than ``longest`` tokens are left out.

    The parser runs in the workers, batch by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, tags = batch.column("forms"), batch.column("tags")
            made = [parser(f, t) for f, t in zip(forms.to_pylist(), tags.to_pylist())]
            row = np.repeat(np.arange(len(made)), pc.list_value_length(forms).to_numpy(zero_copy_only=False))
            tok = np.arange(len(row)) - np.searchsorted(row, row)
            at = pa.array(row)
            head, rel = pa.array([h for heads in made for h, _ in heads], pa.int64()), pa.array([r for heads in made for _, r in heads], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("sent").take(at), pa.array(tok), forms.flatten(), tags.flatten(), head, rel], ["doc_id", "sent", "tok", "word", "pos", "head", "rel"])

    n = F.size("tokens")
    flat = rows.where((n > 0) & (n <= longest)).select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("tokens.word").alias("forms"), F.col("tokens.pos").alias("tags"))
    return flat.mapInArrow(run, "doc_id long, sent long, tok long, word string, pos string, head long, rel string")


def unparsed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Sentences of ``rows`` that ``done`` (doc_id, sent) has no parse of."""
    return rows.join(done.select("doc_id", "sent").distinct(), ["doc_id", "sent"], "left_anti")


def header_contexts(rows: DataFrame) -> DataFrame:
    """header, doc_id, sent, tokens (word, pos) of focus words in context: rows (value) of ``header::start::end::text``.

    The header, blanks as ``_``, stands in the place of the text's characters from start to end as a token tagged NN; the text
    before and after it is split on its own.  Lines of another shape or with a bad span are left out.
    """
    parts = F.split("value", "::", 4)
    spans = rows.where(F.size(parts) == 4).select(F.regexp_replace(parts[0], r"\s+", "_").alias("header"), *[F.expr(f"try_cast(split(value, '::', 4)[{k}] AS int)").alias(c) for k, c in ((1, "begin"), (2, "end"))], parts[3].alias("text"))
    spans = spans.where((F.col("begin") >= 0) & (F.col("end") >= F.col("begin")) & (F.col("end") <= F.char_length("text")))

    def tagged(text: Column) -> Column:
        return F.transform(words(text), lambda w: F.struct(w.alias("word"), rule_pos(w).alias("pos")))

    before = F.substring("text", F.lit(1), F.col("begin"))
    after = F.substring("text", F.col("end") + 2, F.char_length("text"))
    tokens = F.concat(tagged(before), F.array(F.struct(F.col("header").alias("word"), F.lit("NN").alias("pos"))), tagged(after))
    return spans.select("header", F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("sent"), tokens.alias("tokens"))


def header_parses(rows: DataFrame, parser: Heads = chain_heads) -> DataFrame:
    """header, text of header_contexts() parsed: a line of tab-separated columns for each token, between line ends."""
    heads = _heads(parser)
    made = header_contexts(rows).withColumn("h", heads(F.col("tokens.word"), F.col("tokens.pos")))
    return made.select("header", F.concat(F.lit("\n"), _conll(F.col("tokens"), F.col("h")), F.lit("\n")).alias("text"))


def _heads(parser: Heads):
    @F.pandas_udf("array<struct<head:int,rel:string>>")
    def heads(forms: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([[{"head": h, "rel": r} for h, r in parser(list(f), list(t))] for f, t in zip(forms, tags)])

    return heads


def _conll(tokens: Column, heads: Column) -> Column:
    both = F.zip_with(tokens, heads, lambda t, h: F.struct(t["word"].alias("word"), t["pos"].alias("pos"), h["head"].alias("head"), h["rel"].alias("rel")))
    return F.array_join(F.transform(both, lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x["word"], F.lit("_"), x["pos"], x["pos"], F.lit("_"), x["head"].cast("string"), x["rel"])), "\n")


def reparse_marked(rows: DataFrame, parser: Heads = chain_heads) -> DataFrame:
    """key, text of marked-up corpus texts (key, text), parsed anew: lines of markup are copied, the words (first columns) of each ``<s>`` block are parsed."""
    blocks = F.split("text", r"(?<=<s>\n)|(?=</s>)")
    parts = rows.select("key", F.posexplode(blocks).alias("k", "part"))
    inside = F.startswith(F.lead("part").over(Window.partitionBy("key").orderBy("k")), F.lit("</s>")) & F.endswith(F.lag("part").over(Window.partitionBy("key").orderBy("k")), F.lit("<s>\n"))
    parts = parts.withColumn("inside", F.coalesce(inside, F.lit(False)))
    forms = F.transform(F.filter(F.split("part", "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, r"\s+")[0])
    tokens = F.when(F.col("inside"), F.transform(forms, lambda w: F.struct(w.alias("word"), rule_pos(w).alias("pos")))).otherwise(F.array().cast("array<struct<word:string,pos:string>>"))
    parts = parts.withColumn("tokens", tokens).withColumn("h", _heads(parser)(F.col("tokens.word"), F.col("tokens.pos")))
    text = F.when(F.col("inside"), F.concat(_conll(F.col("tokens"), F.col("h")), F.lit("\n"))).otherwise(F.col("part"))
    joined = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", text.alias("text")))).alias("p"))
    return joined.select("key", F.array_join(F.col("p.text"), "").alias("text"))
