"""Similarity measures over pairs (x, y), from path lengths, common ancestors and information content."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import overlap, overlap_exp

MOST = float(1.7976931348623157e308)


def path(shortest: Column) -> Column:
    return F.when(shortest < 0, 0.0).otherwise(1 / (shortest + 1))


def leacock_chodorow(shortest: Column, same_pos: Column, max_depth: Column) -> Column:
    return F.when((shortest < 0) | ~same_pos, 0.0).otherwise(F.lit(0.0) - F.log((shortest + 1) / (2 * max_depth)))


def leacock_chodorow_scaled(shortest: Column, same_pos: Column, max_depth: Column) -> Column:
    return leacock_chodorow(shortest, same_pos, max_depth) / -F.log(1 / (2 * max_depth))


def wu_palmer(depth: Column, d1: Column, d2: Column, noun: Column) -> Column:
    """From the ancestor's longest depth and the ends' distances to it; 0 without one."""
    d = depth + 1 + F.when(noun, 1).otherwise(0)
    return F.when(depth.isNull(), 0.0).otherwise(2 * d / (d1 + d + d2 + d))


def information_content(counts: DataFrame) -> DataFrame:
    """id, ic: -ln of a synset's share of its part of speech's counts (id, pos, count)."""
    total = counts.groupBy("pos").agg(F.sum("count").alias("total"))
    return counts.join(total, "pos").select("id", (-F.log(F.col("count") / F.col("total"))).alias("ic"))


def resnik(common: DataFrame, ic: DataFrame) -> DataFrame:
    """x, y, resnik: the greatest content of the pair's lowest common ancestors, at least 0."""
    rows = common.join(ic.select(F.col("id").alias("anc"), "ic"), "anc", "left")
    return rows.groupBy("x", "y").agg(F.greatest(F.coalesce(F.max("ic"), F.lit(0.0)), F.lit(0.0)).alias("resnik"))


def jiang_conrath(same: Column, ic1: Column, ic2: Column, res: Column) -> Column:
    gap = ic1 + ic2 - 2 * res
    return F.when(same, MOST).when((ic1 == -1) | (ic2 == -1), 0.0).when(gap == 0, MOST).otherwise(1 / gap)


def lin(ic1: Column, ic2: Column, res: Column) -> Column:
    return F.when((ic1 == -1) | (ic2 == -1) | (ic1 + ic2 == 0), 0.0).otherwise(2 * res / (ic1 + ic2))


def gloss_pairs(glosses: DataFrame, kernel: str) -> DataFrame:
    """x, y, score of the ordered pairs of glosses (id, words) that share a word; of all others the score is 0."""
    words = glosses.select("id", F.explode(F.array_distinct("words")).alias("w"))
    met = words.select(F.col("id").alias("x"), "w").join(words.select(F.col("id").alias("y"), "w"), "w").select("x", "y").distinct()
    a, b = glosses.select(F.col("id").alias("x"), F.col("words").alias("wx")), glosses.select(F.col("id").alias("y"), F.col("words").alias("wy"))
    score = overlap(F.col("wx"), F.col("wy")) if kernel == "lesk" else overlap_exp(F.col("wx"), F.col("wy"))
    return met.join(a, "x").join(b, "y").select("x", "y", score.cast("long").alias("score"))


def extended_lesk(glosses: DataFrame, relation: DataFrame) -> DataFrame:
    """x, y, score: the run-length overlap summed over the pair's own glosses and those of their relations."""
    ids = glosses.select("id")
    near = ids.select("id", F.col("id").alias("of")).unionByName(relation.select(F.col("src").alias("id"), F.col("dst").alias("of"))).distinct()
    kernel = gloss_pairs(glosses, "runs").where("score > 0")
    a, b = near.select(F.col("of").alias("x"), F.col("id").alias("s1")), near.select(F.col("of").alias("y"), F.col("id").alias("s2"))
    return kernel.join(a, "x").join(b, "y").groupBy(F.col("s1").alias("x"), F.col("s2").alias("y")).agg(F.sum("score").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sparse_cosine(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Cosine of long vectors: ``left`` (key columns, dim, value) and ``right`` (id, dim, value), for pairs that share a dimension.

    ``on`` names the key columns of ``left``.
    """
    ln = left.groupBy(*on).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("ln"))
    rn = right.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("rn"))
    dots = left.withColumnRenamed("value", "lv").join(right.withColumnRenamed("value", "rv"), "dim").groupBy(*on, "id").agg(F.sum(F.col("lv") * F.col("rv")).alias("dot"))
    return dots.join(ln, on).join(rn, "id").select(*on, "id", (F.col("dot") / (F.col("ln") * F.col("rn"))).alias("cosine"))


