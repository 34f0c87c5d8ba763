"""The corpus and token views that most operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.text import low_words, rule_pos, sentences, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(documents: DataFrame, labels: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """row_key, key, id, source_corpus, title, raw_text, mime, categories of documents; ``source`` filters by equality, which reaches the scan."""
    docs = documents if source is None else documents.where(F.col("source") == source)
    tags = [F.col("lang"), F.col("source")]
    if labels is not None:
        docs = docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
        tags += [F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), F.when(F.col("toxic") == 1, "toxic")]
    key = F.col("doc_id").cast("string")
    return docs.select(
        F.sha1(key).alias("row_key"),
        key.alias("key"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_corpus"),
        F.split("text", "\n", 2)[0].alias("title"),
        F.col("text").alias("raw_text"),
        F.lit("text/xml").alias("mime"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*tags)))).alias("categories"),
    )


def token_array(text: Column) -> Column:
    """array<struct<sent, tok, word>> of a text in order; the position in it is the token's place in the document."""
    return F.flatten(F.transform(sentences(text), lambda s, i: F.transform(words(s), lambda w, j: F.struct(i.alias("sent"), j.alias("tok"), w.alias("word")))))


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, source, sent, tok, gpos, word, pos, head, rel: one row for each token, without a shuffle.

    The default parse is a chain: a token's head is the one before it in its sentence (1-based, 0 for the
    first), its relation its part of speech in lower case.  Columns that a query doesn't use cost nothing.
    """
    rows = documents.select("doc_id", "source", F.posexplode(token_array(F.col("text"))).alias("gpos", "t"))
    pos = rule_pos(F.col("t.word"))
    return rows.select("doc_id", "source", "t.sent", "t.tok", "gpos", "t.word", pos.alias("pos"), F.col("t.tok").alias("head"), F.lower(pos).alias("rel"))


def plain_tokens(documents: DataFrame) -> DataFrame:
    """doc_id, source, gpos, word, pos of tokens() without sentences: sentence ends are no part of words, so the words of the whole text are the same."""
    rows = documents.select("doc_id", "source", F.posexplode(words(F.col("text"))).alias("gpos", "word"))
    return rows.withColumn("pos", rule_pos(F.col("word")))


def word_list(documents: DataFrame, n: int) -> DataFrame:
    """The ``n`` lower-case words in most documents, ties by word; a document's words are made distinct in its row."""
    seen = documents.select(F.explode(F.array_distinct(low_words(F.col("text")))).alias("word"))
    return seen.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(n).select("word")


def word_set(documents: DataFrame, n: int) -> list[str]:
    """word_list() as at most ``n`` values, for filters inside a document's arrays."""
    return [r.word for r in word_list(documents, n).collect()]
