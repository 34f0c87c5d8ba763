import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossweave.llm import decontaminate as dc
from tests.llm.conftest import WORDS, prose


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items, threshold=0.8):
    """Every window of an item's size."""
    out = {}
    for i, text in docs:
        w = (text or "").lower().split()
        for k, item in items:
            q = item.lower().split()
            a = grams(q)
            for s in range(max(1, len(w) - len(q) + 1)):
                b = grams(w[s : s + len(q)])
                if a and b and sum((a & b).values()) / sum((a | b).values()) >= threshold:
                    out[i, k] = max(out.get((i, k), 0), sum((a & b).values()) / sum((a | b).values()))
    return out


def case():
    rng = random.Random(3)
    items = [(k, prose(100 + k, rng.randint(15, 60))) for k in range(12)]
    docs = []
    for d in range(60):
        w = prose(500 + d, 150).split()
        if d % 3:
            q = items[d % 12][1].split()
            for _ in range(d % 5):
                q[rng.randrange(len(q))] = rng.choice(WORDS)
            if d % 7 == 0:
                q = q[: len(q) - 3]
            at = rng.randrange(len(w))
            w[at:at] = q
        docs.append((d, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("limit", [dc.SET_LIMIT, 10])
def test_against_every_window(spark, monkeypatch, limit):
    """With the benchmark in a set, and joined because it is over the limit."""
    monkeypatch.setattr(dc, "SET_LIMIT", limit)
    docs, items = case()
    want = brute(docs, items)
    got = dc.leaks(spark.createDataFrame(docs, ["doc_id", "text"]), spark.createDataFrame(items, ["item_id", "text"])).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 10


def test_all_items_within_the_radius_are_found(spark):
    """Block keys against all pairs of random fingerprints."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    rows = []
    for k, b in enumerate(base):
        for bits in range(0, 24):
            flip = b
            for at in rng.sample(range(64), bits):
                flip ^= 1 << at
            rows.append((k, bits, dc._signed(flip)))
    w = spark.createDataFrame(rows, "k int, bits int, fp long").withColumn("key", F.explode(dc.window_keys(F.col("fp"))))
    i = spark.createDataFrame([(k, dc._signed(b)) for k, b in enumerate(base)], "k int, item_fp long").withColumn("key", F.explode(dc.item_keys(F.col("item_fp"))))
    found = {(r.k, r.bits) for r in w.join(i, ["k", "key"]).select("k", "bits").distinct().collect()}
    assert {(k, b) for k, b, _ in rows if b <= dc.RADIUS} <= found


def test_simhash(spark):
    values = [(1 << 63) - 1, -1, 5, 5, -(1 << 63), 123456789123456789]
    got = spark.createDataFrame([(values,)], "h array<long>").select(dc.simhash(F.col("h"))).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in values) > len(values))
    assert got == dc._signed(want)


def test_simhash_of_many_elements(spark):
    """40,000 and 70,000 elements whose top bits are set: no sum overflows."""
    for n, high in ((40_000, -1), (70_000, -(1 << 63) + 5)):
        got = spark.range(1).select(dc.simhash(F.array_repeat(F.lit(high).cast("long"), n))).first()[0]
        assert got == high


def test_odd_rows(spark, odd, none, clashing):
    items = spark.createDataFrame([(1, prose(2, 60)), (2, None), (3, ""), (4, "four words are few"), (None, prose(99, 20_000))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(odd, items).collect()}
    assert got == {(None, 1), (9, 1), (7, None)}
    left = dc.decontaminate(clashing, items)
    assert left.columns == clashing.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 5, 6, 8, 8, 10, 11, 12]
    assert dc.leaks(none, items).count() == 0
    assert dc.leaks(odd, items.limit(0)).count() == 0
    assert dc.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_pairs_at_the_threshold_lie_within_the_radius(spark):
    """1500 items, each leaked with its last three words changed: 24 of 30 shingles in common, which is 0.8."""
    items = [(k, [f"i{k}w{j}" for j in range(31)]) for k in range(1500)]
    docs = [(k, " ".join([*w[:28], *[f"d{k}w{j}" for j in range(3)]])) for k, w in items]
    got = dc.leaks(spark.createDataFrame(docs, ["doc_id", "text"]), spark.createDataFrame([(k, " ".join(w)) for k, w in items], ["item_id", "text"])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(1500)}
    assert max(r.hamming for r in got) > 17
