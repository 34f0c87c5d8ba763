import pytest
from pyspark.sql import functions as F

from glossweave.functions import codec, stem, text
from glossweave.operators import annotate


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("term", ["1900", ":123", "1-2", "1.2", "10000:", "125121", ".123", "123."])
def test_numbers_are_one_term(spark, term):
    assert one(spark, text.clean_term(F.col("t")), t=term) == "<NUM>"


@pytest.mark.parametrize("raw,clean", [("HTTP://a.b", "<URL>"), ("--Well,--", "well"), ('"(a)"', "a"), ("!!", ""), ("a//b;", "ab")])
def test_clean_term(spark, raw, clean):
    assert one(spark, text.clean_term(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(
    "a,b,plain,runs",
    [
        ("the cat has a brown bag", "bag dog was the blah bag", 2, None),
        ("the cat has a brown bag", "chicken dog was the blah bag", 2, None),
        ("the cat has a brown bag", "bag dog was cat blah bag", 2, 3),
        ("the cat has chicken bag the", "the dog was blarg chicken bag", None, 7),
    ],
)
def test_overlaps(spark, a, b, plain, runs):
    x, y = F.split("a", " "), F.split("b", " ")
    if plain is not None:
        assert one(spark, text.overlap(x, y), a=a, b=b) == plain
    if runs is not None:
        assert one(spark, text.overlap_exp(x, y), a=a, b=b) == runs


def test_tuple_text_round_trip(spark):
    made = text.tuple_text(F.col("a"), F.col("b"))
    assert one(spark, made, a="c,at", b="dog,") == "{c&comma;at, dog&comma;}"
    assert one(spark, text.tuple_parts(made), a="c,at", b="dog,") == ["c,at", "dog,"]


def test_wire_format(spark):
    tokens = "0 0;word:bo&semi,b;pos:DT;dep-rel:g;dep-index:5;span:0,1|0 1;pos:NN;word:ca&pipe,t|0 2;word:&quot,"
    df = spark.createDataFrame([("0 4 3|", tokens)], ["s", "t"]).select(codec.read_sentences(F.col("s"), F.col("t")).alias("x"))
    (sentence,) = df.first().x
    assert [t.word for t in sentence.tokens] == ["bo;b", "ca|t", '"']
    assert sentence.tokens[0].dep_head == 5 and sentence.tokens[0].end == 1 and sentence.tokens[1].dep_rel is None
    again = df.select(codec.write_sentences(F.col("x")).alias("s"), codec.write_tokens(F.col("x")).alias("t"))
    assert again.select(codec.read_sentences(F.col("s"), F.col("t")).alias("x")).first().x == [sentence]


def test_wire_format_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "s string, t string")
    assert df.select(codec.read_sentences(F.col("s"), F.col("t")).alias("x")).first().x == []


def test_spans_are_inside_the_sentence(spark):
    said = "the quick; brown fox, jumped over."
    got = one(spark, F.arrays_zip(text.words(F.col("s")).alias("w"), text.word_spans(F.col("s")).alias("p")), s=said)
    assert [said[t.p.start : t.p.end] for t in got] == [t.w for t in got] == ["the", "quick", "brown", "fox", "jumped", "over"]


def test_porter_stems():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "generalizations": "gener", "oscillators": "oscil", "happy": "happi", "sky": "sky"}
    assert {w: stem.stem(w) for w in words} == words


def test_parse_leaves_long_and_empty_sentences_out(spark):
    docs = spark.createDataFrame([(1, "A b c. Dd ee."), (2, None), (3, "x " * 150)], "doc_id long, text string")
    rows = annotate.annotated(docs)
    got = annotate.parsed(rows).orderBy("doc_id", "sent", "tok").collect()
    assert [(r.sent, r.tok, r.head) for r in got] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 1)]
    assert annotate.unparsed(rows, annotate.parsed(rows)).select("doc_id").distinct().collect()[0].doc_id == 3
