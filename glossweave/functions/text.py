"""Text functions as column expressions; patterns keep to what Java's and RE2's dialects share."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space between tokens, sentence ends, letters and digits of a word.
SPACE = r"[ \t\n\r\f]+"
SENTENCE_END = r"[.!?][ \t]+|\n+"
WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
_WORD = re.compile(WORD)


def clean_term(term: Column) -> Column:
    """Lower-case and trim; numbers become ``<NUM>``, addresses ``<URL>``; edge hyphens and punctuation go."""
    low = F.trim(F.lower(term))
    bare = F.regexp_replace(F.regexp_replace(low, r"^-+", ""), r"-+$", "")
    for drop in (r"[\"'\[\]?*()^+]", r"//", r"[;%,!]"):
        bare = F.regexp_replace(bare, drop, "")
    return F.when(low.rlike(r"^[0-9\-.:]+$"), "<NUM>").when(low.startswith("http:") | low.startswith("ftp:"), "<URL>").otherwise(F.trim(bare))


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Non-empty parts of a text between sentence ends."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def low_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.lower(w))


def spanned_words(sentence: Column) -> Column:
    """(word, start, end) of the words of a sentence in order; a worker passes each sentence once."""
    return F.arrow_udf(_spanned, "array<struct<word:string,start:int,end:int>>")(sentence)


def _spanned(sentence: pa.Array) -> pa.Array:
    words_, at, sizes = [], [], [0]
    for text in sentence.to_pylist():
        for m in _WORD.finditer(text or ""):
            words_.append(m.group())
            at.append(m.start())
        sizes.append(len(words_))
    start = np.array(at, np.int32)
    flat = pa.array(words_, pa.string())
    spans = pa.StructArray.from_arrays([flat, pa.array(start), pa.array(start + pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int32))], ["word", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans, mask=sentence.is_null() if sentence.null_count else None)


def word_spans(sentence: Column) -> Column:
    """(start, end) of each word within its sentence, in the order of words()."""
    return F.transform(spanned_words(sentence), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def rule_pos(word: Column) -> Column:
    """Part of speech by shape and suffix: CD, RB, VB, JJ, else NN."""
    low = F.lower(word)

    def ends(*suffixes: str) -> Column:
        found = [low.endswith(x) for x in suffixes]
        out = found[0]
        for more in found[1:]:
            out = out | more
        return out

    digit = F.substring(word, 1, 1).between("0", "9") & low.rlike("^[0-9]+$")
    return F.when(digit, "CD").when(ends("ly"), "RB").when(ends("ing", "ed"), "VB").when(ends("ous", "ful", "ive"), "JJ").otherwise("NN")


def overlap(a: Column, b: Column) -> Column:
    """Tokens of ``a``, repeats included, that occur in ``b``."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def overlap_exp(a: Column, b: Column) -> Column:
    """Sum over equal positions (i, j) of the squared length of the equal run that starts there.

    Each position's run length is one more than that of the next position on its diagonal, so one pass from
    the end of ``a`` keeps a row of run lengths.
    """
    row0 = F.struct(F.transform(b, lambda _: F.lit(0)).alias("runs"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        runs = F.transform(b, lambda y, j: F.when(y == x, F.coalesce(F.get(acc["runs"], j + 1), F.lit(0)) + 1).otherwise(0))
        return F.transform(F.array(runs), lambda r: F.struct(r.alias("runs"), (acc["total"] + F.aggregate(r, F.lit(0).cast("long"), lambda s, v: s + v * v)).alias("total")))[0]

    return F.aggregate(F.reverse(a), row0, step, lambda acc: acc["total"])


def tuple_text(*parts: Column) -> Column:
    """``{x, y}`` with commas inside parts written as ``&comma;``."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.replace(p, F.lit(","), F.lit("&comma;")) for p in parts]), F.lit("}"))


def tuple_parts(text: Column) -> Column:
    """The parts of tuple_text(), commas restored."""
    return F.transform(F.split(F.substring(text, F.lit(2), F.length(text) - 2), ", "), lambda p: F.replace(p, F.lit("&comma;"), F.lit(",")))


# How marks inside words are written in the sentence wire format.
WIRE = (('"', "&quot,"), ("|", "&pipe,"), (";", "&semi,"))


def wire_escape(word: Column) -> Column:
    for plain, coded in WIRE:
        word = F.replace(word, F.lit(plain), F.lit(coded))
    return word


def wire_unescape(word: Column) -> Column:
    for plain, coded in WIRE:
        word = F.replace(word, F.lit(coded), F.lit(plain))
    return word
