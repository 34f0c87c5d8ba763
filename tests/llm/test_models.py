import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossweave.llm import language, quality
from tests.llm.conftest import prose


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50
    y, p = got["quality"].to_numpy(), got["score"].rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    assert (p[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.97
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert ((got["score"] >= 0.3) == got["predicted"].astype(bool)).all()


def test_quality_of_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (9, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_quality(clashing, labels).columns == clashing.columns


def test_held_out_labels_are_not_learned(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    changed = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    assert np.array_equal(quality.fit(odd, labels), quality.fit(odd, changed))


def test_the_leader_separates():
    model = quality.FollowTheLeader(4)
    for _ in range(200):
        model.learn(np.array([0, 2]), np.array([1.0, 1.0]), 1)
        model.learn(np.array([1, 2]), np.array([1.0, 1.0]), 0)
    assert model.weights(0) > 0.5 > -0.5 > model.weights(1)
    assert model.weights(3) == 0


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_language_of_odd_rows(odd, none):
    got = language.identify(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 14 and {by[i].lang_pred for i in (3, 4, 5)} == {"und"} and by[3].score == 0
    assert by[7].lang_pred in {"en", "fr", "de"} and all(0 <= r.score <= 1 for r in got)
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def slow_tree(texts, order):
    """Counts of bytes after each context of up to ``order`` bytes."""
    tree = {}
    for text in texts:
        raw = bytes(order) + language.folded(text)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                own = tree.setdefault(raw[i - k : i], {})
                own[raw[i]] = own.get(raw[i], 0) + 1
    return tree


def slow_distribution(tree, context):
    """Probabilities of all bytes: the context's own counts, an escape for the rest, shared out as the shorter context has it."""
    lower = slow_distribution(tree, context[1:]) if context else [1 / 256] * 256
    seen = tree.get(context)
    if not seen:
        return lower
    rest = sum(p for b, p in enumerate(lower) if b not in seen)
    whole = sum(seen.values()) + (len(seen) if len(seen) < 256 else 0)
    return [seen[b] / whole if b in seen else len(seen) / whole * lower[b] / rest for b in range(256)]


def slow_bits(tree, order, text):
    raw = bytes(order) + language.folded(text)
    return -sum(math.log2(slow_distribution(tree, raw[i - order : i])[raw[i]]) for i in range(order, len(raw)))


def test_code_lengths_against_plain_prediction(spark):
    """Byte by byte, by whole distributions; also bytes and scripts that a language, or no language, has seen."""
    texts = {"en": [prose(k, 30) for k in range(6)], "fr": [prose(k, 20) + " é naïf, ça" for k in range(50, 55)], "ja": ["日本語の文 です", "本の文"]}
    docs = spark.createDataFrame([(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own, 4)], ["doc_id", "text", "lang"]).withColumn("doc_id", F.lit(1))  # one fold, not held out
    model = language.fit(docs)
    assert model.languages == ["en", "fr", "ja"]
    probes = ["x", "Cesel BARAN", prose(77, 6), "日本 é", "\0\0\0a", "🏽 ß", texts["fr"][0]]
    got = model.code_lengths(probes)
    for k, lang in enumerate(model.languages):
        tree = slow_tree(texts[lang], language.ORDER)
        for i, text in enumerate(probes):
            assert got[i, k] == pytest.approx(slow_bits(tree, language.ORDER, text), rel=1e-4), (lang, text)


def test_whole_distributions():
    tree = slow_tree([prose(1, 20)], 2)
    for context in (b"", b"a", b"se", b"zz"):
        assert sum(slow_distribution(tree, context)) == pytest.approx(1)


def test_all_bytes_seen(spark):
    """A context after which all 256 bytes... of UTF-8 text at least those that occur, leaves no escape short."""
    text = "".join(chr(c) for c in range(1, 2000))
    model = language.fit(spark.createDataFrame([(1, text, "x")], ["doc_id", "text", "lang"]))
    assert model.code_lengths([text])[0, 0] == pytest.approx(slow_bits(slow_tree([text], language.ORDER), language.ORDER, text), rel=1e-4)


def test_long_texts_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(k, 40), "en") for k in range(20)], ["doc_id", "text", "lang"])
    model, text = language.fit(docs), prose(5, 3_000)
    whole = model.code_lengths([text, "ab", text])
    monkeypatch.setattr(language, "PIECE", 100)
    assert model.code_lengths([text, "ab", text]) == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("text,known", [("²", False), ("½ ①", False), ("12 _ !?", False), ("a", True), ("１", False), ("ß", True), ("日", True)])
def test_letters(spark, text, known):
    docs = spark.createDataFrame([(1, prose(1, 40), "en")], ["doc_id", "text", "lang"])
    got = language.predict(spark.createDataFrame([(7, text)], ["doc_id", "text"]), language.fit(docs)).first()
    assert got.lang_pred == ("en" if known else "und")


def test_identify_with_clashing_columns(clashing):
    assert language.identify(clashing).count() == clashing.count()
    assert quality.score_quality(clashing, clashing.selectExpr("doc_id", "1 AS quality")).count() == clashing.count()


def slow_weights(rows):
    """Follow-the-regularised-leader updates coordinate by coordinate, in plain numbers."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality.L1 - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for label, features in rows:
        w = {i: weight(i) for i in features}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features.items())))
        for i, x in features.items():
            g = (p - label) * x
            step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
            z[i] = z.get(i, 0.0) + g - step * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_updates_and_scores_against_plain_numbers(spark):
    """The model that fit() learns and the scores that it gives, worked out apart."""
    texts = {k: prose(k, 12) + (" Good, good!" if k % 2 else " bad bad") for k in range(1, 15)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int")
    learned = sorted((k for k in texts if zlib.crc32(str(k).encode()) % 5), key=lambda k: xxhash.xxh3_64_intdigest(str(k)))

    def plain(text):
        at, value = quality.features(text)
        return {**dict(zip(at.tolist(), value.tolist())), 1 << quality.BITS: float(np.float32(0.3))}

    passes = min(quality.PASSES[1], max(quality.PASSES[0], quality.UPDATES // len(learned)))
    want = slow_weights([(k % 2, plain(texts[k])) for _ in range(passes) for k in learned])
    for r in quality.score_quality(docs, labels).collect():
        total = sum(want.get(i, 0.0) * x for i, x in plain(texts[r.doc_id]).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_features_of_a_short_text():
    """Two words: two word and two shape buckets, a pair of each, and whether the words are the same, of unit length."""
    at, value = quality.features("Ba ce")
    assert len(at) == 7 and (value**2).sum() == pytest.approx(1)
    _, twice = quality.features("ba ba")
    assert sorted(round(float(x * x * 7), 5) for x in twice) == [1, 1, 1, 2, 2]
