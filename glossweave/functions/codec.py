"""The sentence wire format: annotated sentences as two delimited strings, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.functions.text import wire_escape, wire_unescape

TOKEN = "struct<word:string,pos:string,sense:string,dep_rel:string,dep_head:int,start:int,end:int>"
SENTENCES = f"array<struct<start:int,end:int,tokens:array<{TOKEN}>>>"


def write_sentences(sentences: Column) -> Column:
    """``start end tokens`` of each sentence, bars between."""
    return F.array_join(F.transform(sentences, lambda s: F.concat_ws(" ", s["start"].cast("string"), s["end"].cast("string"), F.size(s["tokens"]).cast("string"))), "|")


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}:"), value.cast("string"), F.lit(";"))).otherwise("")


def write_tokens(sentences: Column) -> Column:
    """``sentence token;pos:..;word:..;`` and the other fields a token has, bars between; marks in words are coded."""

    def token(s: Column, t: Column, i: Column, j: Column) -> Column:
        span = F.when(t["start"].isNotNull(), F.concat_ws(",", t["start"].cast("string"), t["end"].cast("string")))
        return F.concat(i.cast("string"), F.lit(" "), j.cast("string"), F.lit(";"), _field("pos", t["pos"]), _field("word", wire_escape(t["word"])), _field("sense", t["sense"]), _field("dep-rel", t["dep_rel"]), _field("dep-index", t["dep_head"]), _field("span", span))

    rows = F.transform(sentences, lambda s, i: F.transform(s["tokens"], lambda t, j: token(s, t, i, j)))
    return F.array_join(F.flatten(rows), "|")


def read_sentences(sentences: Column, tokens: Column) -> Column:
    """Sentences of both strings; null or empty strings give none, absent fields are null."""
    parts = F.transform(F.filter(F.split(tokens, r"\|"), lambda x: x != ""), lambda x: F.split(x, ";"))

    def value(fields: Column, name: str) -> Column:
        return F.get(F.transform(F.filter(fields, lambda f: f.startswith(f"{name}:")), lambda f: F.substring(f, F.lit(len(name) + 2), F.length(f))), F.lit(0))

    def token(fields: Column) -> Column:
        span = F.split(value(fields, "span"), ",")
        return F.struct(
            wire_unescape(value(fields, "word")).alias("word"), value(fields, "pos").alias("pos"), value(fields, "sense").alias("sense"), value(fields, "dep-rel").alias("dep_rel"),
            value(fields, "dep-index").cast("int").alias("dep_head"), F.get(span, F.lit(0)).cast("int").alias("start"), F.get(span, F.lit(1)).cast("int").alias("end"),
        )

    def sentence(line: Column, i: Column) -> Column:
        head = F.split(line, " ")
        own = F.filter(parts, lambda f: F.split(f[0], " ")[0].cast("int") == i)
        return F.struct(head[0].cast("int").alias("start"), head[1].cast("int").alias("end"), F.transform(own, token).alias("tokens"))

    lines = F.filter(F.split(sentences, r"\|"), lambda x: x != "")
    return F.coalesce(F.transform(lines, sentence), F.array().cast(SENTENCES))
