"""Benchmark decontamination in DataFrame expressions: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are lower-case runs of letters and digits; a shingle is the hash of five words in a row.  A window
similar to an item shares a shingle with it, so windows are laid where a document has a shingle of the
benchmark: one of each item's size, aligned on the shingle.  A window's 64-bit SimHash is looked up among those of the
items by BLOCKS bit blocks, each with up to FLIPS bits flipped on the item side: within RADIUS = BLOCKS * (FLIPS + 1) - 1
bits some block differs in at most FLIPS bits, so no item within the radius is missed.  The pairs found are
verified by the weighted Jaccard similarity of their shingles (shared counts over united counts).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import written

SHINGLE = 5
BLOCKS, FLIPS = 6, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Benchmark shingles up to which they are looked up in a set inside the scan; beyond, documents' shingles are joined to them.
SET_LIMIT = 50_000
#: Elements that could fill a lane of 16 bits, the highest of which has the sign.
NARROW = 1 << 15
#: Contaminated identifiers up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text in order; empty for null and shorter texts."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.xxhash64(w))

    def chain(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        return F.when(F.size(h) >= SHINGLE, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])))

    # the words' hashes are bound once, not written out at each use
    bound = F.transform(F.array(words), chain)
    return F.coalesce(F.get(bound, F.lit(0)), F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes, each counted as often as it occurs.

    Every sum adds several bits at a time, in lanes: four of 16 bits, or two of 32 bits for arrays that could fill the former.
    """

    def shifted(x: Column, by: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, by)

    def in_lanes(width: int) -> Column:
        ones, mask = sum(1 << at for at in range(0, 64, width)), (1 << width) - 1
        zero = F.lit(0).cast("long")
        sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(hashes, zero, lambda acc, x: acc + shifted(x, j).bitwiseAND(ones)))

        def bits(s: Column) -> Column:
            def more(acc: Column, b: Column) -> Column:
                count = shifted(F.get(s, b % width), b - b % width).bitwiseAND(mask)
                return acc.bitwiseOR(F.when(count * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero))

            return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, more)

        return F.get(F.transform(F.array(sums), bits), F.lit(0))

    return F.when(F.size(hashes) < NARROW, in_lanes(16)).otherwise(in_lanes(32))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_layout() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    width, more = divmod(64, BLOCKS)
    sizes = [width + (k < more) for k in range(BLOCKS)]
    return [(sum(sizes[:k]), w) for k, w in enumerate(sizes)]


def _block(fingerprint: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, at).bitwiseAND((1 << width) - 1)


def item_keys(fingerprint: Column) -> Column:
    """Array of (block, value) under which an item is found: each block with up to FLIPS of its bits flipped."""

    def keys(k: int, at: int, width: int) -> Column:
        flips = [sum(1 << b for b in some) for n in range(FLIPS + 1) for some in combinations(range(width), n)]
        value = _block(fingerprint, at, width)
        return F.transform(F.expr(f"array({', '.join(f'{x}L' for x in flips)})"), lambda x: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(x).alias("value")))

    return F.flatten(F.array(*[keys(k, at, width) for k, (at, width) in enumerate(block_layout())]))


def window_keys(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), _block(fingerprint, at, width).alias("value")) for k, (at, width) in enumerate(block_layout())])


def weighted_jaccard(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The keys of ``pairs`` and similarity: shared counts over united counts of the elements of two array columns."""
    side = F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = pairs.select(*keys, F.explode(side).alias("e")).groupBy(*keys, "e.x").agg(F.sum("e.a").alias("na"), F.sum("e.b").alias("nb"))
    return counts.groupBy(*keys).agg((F.sum(F.least("na", "nb")) / F.sum(F.greatest("na", "nb"))).alias("similarity"))


def _marked(docs: DataFrame, places: DataFrame) -> DataFrame:
    """uid, doc_id, sh (all shingles), hits (positions and hashes of benchmark shingles) of documents that have any."""
    rows = docs.select("doc_id", shingles(F.col("text")).alias("sh"))
    known = places.select("hash").distinct()
    few = known.limit(SET_LIMIT + 1).collect()  # at most SET_LIMIT + 1 numbers
    if len(few) <= SET_LIMIT:
        values = ", ".join(f"{r.hash}L" if r.hash > -(1 << 63) else "bigint(-9223372036854775808)" for r in few) or "0L"
        found = F.expr(f"filter(transform(sh, (x, i) -> if(x IN ({values}), named_struct('pos', i, 'hash', x), NULL)), s -> s IS NOT NULL)")  # parsed at once
        rows = rows.withColumn("hits", found).where(F.size("hits") > 0)
    else:
        rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "shingles")
        spots = rows.select("uid", F.posexplode("sh").alias("pos", "hash")).join(known, "hash")
        rows = rows.join(spots.groupBy("uid").agg(F.collect_list(F.struct("pos", "hash")).alias("hits")), "uid").drop("uid")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "marked")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, start (word number), n_words, hamming, similarity: the best window of each document for each item it leaks.

    Similarity is at least ``threshold``; of equally similar windows the first counts.  Items and documents of fewer
    than five words, null and empty texts leak nothing; repeated rows of a doc_id give one row for each
    item; null identifiers are grouped as one.  Other columns are not read.
    """
    own = items.select("item_id", shingles(F.col("text")).alias("item_sh")).where(F.size("item_sh") > 0)
    own = written(own.withColumn("item_fp", simhash(F.col("item_sh"))).withColumn("item", F.monotonically_increasing_id()), "items")
    places = own.select(F.size("item_sh").alias("n"), F.posexplode("item_sh").alias("at", "hash")).distinct()
    marked = _marked(docs, places)
    hits = marked.select("uid", F.explode("hits").alias("hit")).select("uid", "hit.pos", "hit.hash")
    spans = hits.join(places, "hash").select("uid", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start"), "n").distinct()
    windows = spans.join(marked.select("uid", "doc_id", "sh"), "uid").select("uid", "doc_id", "start", F.col("n").alias("size"), F.slice("sh", F.col("start") + 1, F.col("n")).alias("win_sh"))
    windows = written(windows.withColumn("fp", simhash(F.col("win_sh"))).withColumn("window", F.monotonically_increasing_id()), "windows")
    # a window has the size of the items that it is looked up among
    keyed = windows.select("window", "size", "fp", F.explode(window_keys(F.col("fp"))).alias("key")).select("window", "size", "fp", "key.block", "key.value")
    index = own.select("item", F.size("item_sh").alias("size"), "item_fp", F.explode(item_keys(F.col("item_fp"))).alias("key")).select("item", "size", "item_fp", "key.block", "key.value")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = keyed.join(index, ["size", "block", "value"]).where(hamming <= RADIUS).select("window", "item", hamming.alias("hamming")).distinct()
    near = written(near, "near")
    near = near.join(windows.select("window", "doc_id", "start", "win_sh"), "window").join(own.select("item", "item_id", "item_sh"), "item")
    scores = weighted_jaccard(near, ["window", "item"], "win_sh", "item_sh").where(F.col("similarity") >= threshold)
    found = near.select("window", "item", "item_id", "doc_id", "start", F.size("win_sh").alias("n"), "hamming").join(scores, ["window", "item"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), F.col("n"), (-F.col("hamming")).alias("close"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.before")).alias("start"), (F.col("b.n") + SHINGLE - 1).alias("n_words"), (-F.col("b.close")).cast("int").alias("hamming"), F.col("b.similarity").alias("similarity")
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that leak no item, all their columns as they are.

    Rows of one doc_id go together, and so do those of null identifiers; null, empty and short texts stay; extra columns may
    have any names; without items all rows stay.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    bad = written(leaks(docs, items, threshold).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    clean = docs.toDF(*names).join(bad, F.col(names[docs.columns.index("doc_id")]).eqNullSafe(F.col("_leak")), "left_anti")
    return clean.toDF(*docs.columns)
