import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu") for b in ("ran", "sel", "tin", "vor", "wex", "zam", "nid", "pol")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(99, 20_000)
    return [
        (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60).upper(), "en", "a", 1), (3, None, None, None, None), (4, "", "fr", "b", 0), (5, " \n\t ", "en", "b", 4),
        (6, "short one", "en", "b", 9), (7, long, "en", "b", len(long)), (8, prose(1, 60), "en", "c", 1), (8, prose(1, 60), "en", "c", 1), (None, prose(2, 60), "de", "c", 1),
        (9, prose(2, 60), "de", "c", 1), (10, "a\nb\n\n  c  d\te\x00f <|im_end|> ▁x é 日本 🏽", "en", "d", 1), (11, "<0x0A> </s>  two  spaces ", "en", "d", 1), (12, prose(1, 30) + " new " + prose(3, 30), "en", "d", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with columns that operators use names like."""
    from pyspark.sql import functions as F

    extra = ["digest", "keep_id", "kept", "key", "label", "score", "ids", "n", "row", "line", "at", "uid", "_keep", "_leak", "shingles", "hits", "_turn", "_keep_id"]
    return odd.select("*", *[F.lit("x").alias(c) for c in extra])
