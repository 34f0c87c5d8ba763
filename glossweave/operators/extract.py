"""Projections of corpus rows: keys, tags, labels and line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import rule_pos, sentences
from glossweave.functions.text import words as text_words
from glossweave.sources.corpus import token_array


def accept(token_rows: DataFrame, words: DataFrame | None) -> DataFrame:
    """Tokens whose lower-case word is listed; None accepts all. The list is small by definition and checked by Spark's broadcast threshold."""
    if words is None:
        return token_rows
    return token_rows.join(words.select(F.col("word").alias("_listed")), F.lower("word") == F.col("_listed"), "left_semi")


def one_line_per_doc(documents: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """key, line: a document's accepted words, each followed by a space."""
    words = text_words(F.col("text"))
    if listed is not None:
        words = F.filter(words, lambda w: F.lower(w).isin(listed))
    return documents.select(F.col("doc_id").cast("string").alias("key"), F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "))), "").alias("line"))


def _conll(t: Column) -> Column:
    pos = rule_pos(t["word"])
    return F.concat_ws("\t", (t["tok"] + 1).cast("string"), t["word"], F.lit("_"), pos, pos, F.lit("_"), t["tok"].cast("string"), F.lower(pos))


def conll_lines(documents: DataFrame) -> DataFrame:
    """doc_id, sent, lines: tab-separated index, word, _, pos, pos, _, head, relation of each token."""
    rows = documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent", "s"))
    own = F.transform(text_words(F.col("s")), lambda w, j: F.struct(j.alias("tok"), w.alias("word")))
    rows = rows.select("doc_id", "sent", own.alias("own")).where(F.size("own") > 0)
    return rows.select("doc_id", "sent", F.array_join(F.transform("own", _conll), "\n").alias("lines"))


def semeval_lines(documents: DataFrame) -> DataFrame:
    """doc_id, record: CoNLL lines of a whole document with ``||`` between tokens' lines; the token at position doc_id also names title and key."""
    t = token_array(F.col("text"))
    key = F.col("doc_id").cast("string")
    target = F.concat_ws("\t", F.split("text", "\n", 2)[0], key)
    lines = F.transform(t, lambda x, i: F.when(i == F.col("doc_id"), target).otherwise(_conll(x)))
    return documents.select("doc_id", F.array_join(lines, "||").alias("record"))


def tag_lines(rows: DataFrame) -> DataFrame:
    """key, tags: a document's categories, each followed by a bar."""
    return rows.select("key", F.concat(F.array_join("categories", "|"), F.lit("|")).alias("tags"))


def row_keys(rows: DataFrame) -> DataFrame:
    return rows.select("row_key").distinct().select("row_key", F.lit(1).cast("long").alias("n"))


def set_labels(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """key, labels: for each key a map of label names to the value with the highest version, then the greatest."""
    last = updates.groupBy("key", "name").agg(F.max(F.struct("version", "value"))["value"].alias("value"))
    maps = last.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("labels"))
    return rows.join(maps, "key", "left")


def get_label(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("key", F.element_at("labels", name).alias("value"))


def xml_records(pages: DataFrame, text: str, tag: str) -> DataFrame:
    """page_id, rec, record: markup from ``<tag`` (before a space or ``>``) up to ``</tag>``, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?s)<{tag}[ >].*?</{tag}>"), 0)
    return pages.select("page_id", F.posexplode(found).alias("rec", "record"))


def instance_lines(lines: DataFrame) -> DataFrame:
    """Lines in instance form: each is one ``<instance>``, the word after four bars its ``<head>``."""
    head = F.regexp_replace("value", r"\|\|\|\| *(\S+)", "<head> $1 </head>")
    return lines.select(F.concat(F.lit("<instance>"), head, F.lit("</instance>")).alias("value"))


def online_sections(articles: DataFrame) -> DataFrame:
    """key, section of articles that have both."""
    return articles.where(F.col("key").isNotNull() & F.col("section").isNotNull()).select("key", "section")
