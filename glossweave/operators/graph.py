"""Hypernym graphs: closure, paths, depths, distances, common ancestors, ranks and network agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.plans.scratch import checkpointed


#: Rows about an ontology's terms and nodes that go to every worker at most.
MOST_PAIRS = 1_000_000


def _level_union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def closure(nodes: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """id, anc, dmin, dmax: ancestors of every node (itself at 0) over child-parent rows (src, dst), at most ``depth`` links away.

    Each level is distinct, so the many paths of a wide graph don't multiply rows; ``depth`` also ends cycles.  Levels
    are checkpointed two by two, so that no plan repeats more than a few steps, and end where no ancestor is left.
    """
    up = checkpointed(parents.select(F.col("src").alias("anc"), F.col("dst").alias("next")).distinct())
    now = checkpointed(nodes.select("id", F.col("id").alias("anc")))
    levels = [now.withColumn("d", F.lit(0).cast("long"))]
    for d in range(1, depth + 1):
        now = now.join(up, "anc").select("id", F.col("next").alias("anc")).distinct()
        if d % 2 == 0:
            now = checkpointed(now)
        levels.append(now.withColumn("d", F.lit(d).cast("long")))
        if d % 2 == 0 and now.isEmpty():
            break
    return checkpointed(_level_union(levels).groupBy("id", "anc").agg(F.min("d").alias("dmin"), F.max("d").alias("dmax")))


def parent_paths(nodes: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """id, path (array from a root to the node) of every simple path to a root; levels are checkpointed as in closure()."""
    now = nodes.select("id", F.array("id").alias("path"))
    up = checkpointed(parents.select(F.col("src").alias("top"), F.col("dst").alias("next")))
    levels = []
    for d in range(depth + 1):
        grown = checkpointed(now.withColumn("top", F.col("path")[0]).join(up, "top", "left"))
        levels.append(grown.where("next is null").select("id", "path"))
        now = grown.where("next is not null").where(~F.array_contains("path", F.col("next"))).select("id", F.concat(F.array("next"), "path").alias("path"))
        if d < depth and now.isEmpty():
            break
    return _level_union(levels)


def depths(close: DataFrame, parents: DataFrame) -> DataFrame:
    """id, max_depth, min_depth: the longest and the shortest chain to a root."""
    top = close.join(parents.select(F.col("src").alias("anc")).distinct(), "anc", "left_anti")
    return top.groupBy("id").agg(F.max("dmax").alias("max_depth"), F.min("dmin").alias("min_depth"))


def shared_ancestors(pairs: DataFrame, close: DataFrame) -> DataFrame:
    """x, y, anc and both ends' distances for every ancestor that a pair shares."""
    a = close.select(F.col("id").alias("x"), "anc", F.col("dmin").alias("xmin"), F.col("dmax").alias("xmax"))
    b = close.select(F.col("id").alias("y"), "anc", F.col("dmin").alias("ymin"), F.col("dmax").alias("ymax"))
    return pairs.join(a, "x").join(b, ["y", "anc"])


def path_lengths(pairs: DataFrame, close: DataFrame) -> DataFrame:
    """x, y, shortest (-1 without a shared ancestor), longest (then 0)."""
    met = shared_ancestors(pairs, close).groupBy("x", "y").agg(F.min(F.col("xmin") + F.col("ymin")).alias("s"), F.max(F.col("xmax") + F.col("ymax")).alias("l"))
    return pairs.join(met, ["x", "y"], "left").select("x", "y", F.coalesce("s", F.lit(-1).cast("long")).alias("shortest"), F.coalesce("l", F.lit(0).cast("long")).alias("longest"))


def with_ancestors(close: DataFrame, values: DataFrame) -> DataFrame:
    """``close`` with the ``values`` (id, ...) of its ancestors.

    Nearly all rows have one of a few ancestors; nodes above others are counted, and go to every worker if they are few.
    """
    above = close.where("id <> anc").select(F.col("anc").alias("id")).distinct()
    above = checkpointed(values.join(above, "id", "left_semi")).withColumnRenamed("id", "anc")
    own = close.where("id = anc").join(values, "id")
    return own.unionByName(close.where("id <> anc").join(F.broadcast(above) if above.count() <= MOST_PAIRS else above, "anc"))


def pair_ancestors(pairs: DataFrame, close: DataFrame, depth: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with ax and ay: arrays of both ends' ancestors (anc, dmin, dmax, depth and what else ``depth`` has).

    A pair stays one row, and is shuffled once for each end.
    """
    values = depth.select("id", F.col("max_depth").alias("depth"), *[c for c in depth.columns if c not in ("id", "max_depth", "min_depth")])
    one = F.struct("anc", "dmin", "dmax", *values.columns[1:])
    up = checkpointed(with_ancestors(close, values).groupBy("id").agg(F.collect_list(one).alias("up")))
    return pairs.join(up.toDF("x", "ax"), "x", "left").join(up.toDF("y", "ay"), "y", "left").select("x", "y", "ax", "ay")


def lowest_common(a: Column, b: Column, *more: str) -> Column:
    """Of pair_ancestors()'s arrays the shared ancestors of greatest depth: array<struct<anc, depth, xmin, xmax, ymin, ymax, more>>; null if an end has none."""

    def met(p: Column) -> Column:
        same = F.filter(b, lambda q: q["anc"] == p["anc"])
        return F.transform(same, lambda q: F.struct(p["anc"].alias("anc"), p["depth"].alias("depth"), p["dmin"].alias("xmin"), p["dmax"].alias("xmax"), q["dmin"].alias("ymin"), q["dmax"].alias("ymax"), *[p[c].alias(c) for c in more]))

    def deepest(common: Column) -> Column:
        return F.aggregate(common, F.slice(common, 1, 0), lambda acc, c: F.when((F.size(acc) == 0) | (c["depth"] > F.get(acc, F.lit(0))["depth"]), F.array(c)).when(c["depth"] == F.get(acc, F.lit(0))["depth"], F.concat(acc, F.array(c))).otherwise(acc))

    return F.get(F.transform(F.array(F.flatten(F.transform(a, met))), deepest), F.lit(0))  # made once


def lcs(pairs: DataFrame, close: DataFrame, depth: DataFrame) -> DataFrame:
    """x, y, anc, depth: the shared ancestors of greatest longest depth, with their distances."""
    rows = pair_ancestors(pairs, close, depth)
    return rows.select("x", "y", F.explode(lowest_common(F.col("ax"), F.col("ay"))).alias("m")).select("x", "y", "m.*")


def one_lcs(common: DataFrame) -> DataFrame:
    """The smallest id of each pair's lowest common ancestors."""
    return common.groupBy("x", "y").agg(F.min(F.struct("anc", "depth", "xmin", "ymin", "xmax", "ymax")).alias("m")).select("x", "y", "m.*")


def cousins(term_pairs: DataFrame, senses: DataFrame, close: DataFrame, limit: int) -> DataFrame:
    """a, b, m, n: over sense pairs and shared ancestors within ``limit`` links, the distances of the smallest sum, then the smallest m."""
    ends = term_pairs.join(senses.select(F.col("lemma").alias("a"), F.col("id").alias("x")), "a").join(senses.select(F.col("lemma").alias("b"), F.col("id").alias("y")), "b")
    met = shared_ancestors(ends, close).where((F.col("xmin") <= limit) & (F.col("ymin") <= limit))
    best = met.groupBy("a", "b").agg(F.min(F.struct((F.col("xmin") + F.col("ymin")).alias("s"), F.col("xmin").alias("m"), F.col("ymin").alias("n"))).alias("t"))
    return best.select("a", "b", "t.m", "t.n")


def term_ancestors(senses: DataFrame, close: DataFrame) -> DataFrame:
    """a, b of terms and the terms above them; a term's own synsets are not its ancestors.  Counted, and marked for broadcast if they are few."""
    ids = senses.select("lemma", "id").distinct()
    up = ids.join(close.select("id", "anc"), "id").select(F.col("lemma").alias("a"), F.col("anc")).distinct()
    own = ids.select(F.col("lemma").alias("a"), F.col("id").alias("anc"))
    above = checkpointed(up.join(own, ["a", "anc"], "left_anti").join(ids.select(F.col("lemma").alias("b"), F.col("id").alias("anc")), "anc").select("a", "b").distinct())
    return F.broadcast(above) if above.count() <= MOST_PAIRS else above


def hypernym_status(term_pairs: DataFrame, senses: DataFrame, close: DataFrame, lemmas: list[str]) -> DataFrame:
    """a, b, status of a child and an ancestor term; ``lemmas`` are those of the senses, so that pairs of frequent words need no join to be known."""
    ka, kb = F.col("a").isin(lemmas), F.col("b").isin(lemmas)
    rows = term_pairs.join(term_ancestors(senses, close).withColumn("is", F.lit(True)), ["a", "b"], "left")
    status = F.when(~ka & ~kb, "TERMS_MISSING").when(~ka, "NOVEL_HYPERNYM").when(~kb, "NOVEL_HYPONYM").when(F.col("is"), "KNOWN_HYPERNYM").otherwise("KNOWN_NON_HYPERNYM")
    return rows.select("a", "b", status.alias("status"))


# Links that lead up, down and sideways for the medium-strong relation measure.
UP, DOWN, SIDE = ("@", "%m", "%s", "%p"), ("~", "#m", "#s", "#p", ">", "*"), ("^", "=", "!", "&")
# State, direction: next state and turns; state 0 is the start.
MOVES = [(0, "u", 1, 0), (0, "d", 3, 0), (0, "s", 2, 0), (1, "u", 1, 0), (1, "d", 4, 1), (1, "s", 2, 1), (2, "s", 2, 0), (2, "d", 4, 1), (3, "d", 4, 0), (3, "s", 5, 1), (4, "d", 4, 0), (5, "s", 5, 0)]


def hirst_st_onge(starts: DataFrame, relation: DataFrame, depth: int = 5) -> DataFrame:
    """x, y, score: the best (8 - links - turns) / 8 over walks of at most ``depth`` links that the state table allows."""
    spark = relation.sparkSession
    way = F.when(F.col("rel").isin(*UP), "u").when(F.col("rel").isin(*DOWN), "d").when(F.col("rel").isin(*SIDE), "s")
    steps = relation.select(F.col("src").alias("y"), way.alias("way"), F.col("dst").alias("next")).where("way is not null").distinct()
    moves = spark.createDataFrame(MOVES, "state int, way string, to int, cost int")
    steps = steps.join(moves, "way").select("y", "state", "next", "to", "cost")
    now = starts.select("x", F.col("x").alias("y"), F.lit(0).alias("state"), F.lit(0).alias("turns"))
    levels = []
    for d in range(1, depth + 1):
        now = now.join(steps, ["y", "state"]).select("x", F.col("next").alias("y"), F.col("to").alias("state"), (F.col("turns") + F.col("cost")).alias("turns")).distinct()
        levels.append(now.select("x", "y", (8 - d - F.col("turns")).alias("score")))
    return _level_union(levels).groupBy("x", "y").agg((F.greatest(F.max("score"), F.lit(0)) / 8).alias("score"))


def pair_hirst_st_onge(pairs: DataFrame, relation: DataFrame, depth: int = 5) -> DataFrame:
    """x, y, score of hirst_st_onge() for every pair (x, y), 0 without a walk.

    A walk is cut where its last run of links down begins: the first part leads from x, the run is climbed from y
    against its links, so that no part spreads over all nodes below a common one.
    """
    spark = relation.sparkSession
    pairs = checkpointed(pairs.select("x", "y"))
    way = F.when(F.col("rel").isin(*UP), "u").when(F.col("rel").isin(*DOWN), "d").when(F.col("rel").isin(*SIDE), "s")
    links = checkpointed(relation.select("src", way.alias("way"), "dst").where("way is not null").distinct())
    moves = spark.createDataFrame([m for m in MOVES if m[2] != 4], "state int, way string, to int, cost int")
    # a first link down leads on sideways only; a run of links down from x begins at x itself
    steps = links.join(moves, "way").select(F.col("src").alias("at"), "state", F.col("dst").alias("next"), "to", "cost")
    now = pairs.select("x", F.col("x").alias("at"), F.lit(0).alias("state"), F.lit(0).alias("turns")).distinct()
    first = [now.withColumn("i", F.lit(0))]
    for i in range(1, depth + 1):
        now = checkpointed(now.join(steps, ["at", "state"]).select("x", F.col("next").alias("at"), F.col("to").alias("state"), (F.col("turns") + F.col("cost")).alias("turns")).distinct())
        first.append(now.withColumn("i", F.lit(i)))
    up = links.where("way = 'd'").select(F.col("dst").alias("at"), F.col("src").alias("next"))
    now = pairs.select("y", F.col("y").alias("at")).distinct()
    last = [now.withColumn("j", F.lit(0))]
    for j in range(1, depth + 1):
        now = checkpointed(now.join(up, "at").select("y", F.col("next").alias("at")).distinct())
        last.append(now.withColumn("j", F.lit(j)))
    head = _level_union(first).groupBy("x", "at", "state", "turns").agg(F.min("i").alias("i"))
    tail = _level_union(last).groupBy("y", "at", (F.col("j") > 0).alias("down")).agg(F.min("j").alias("j"))
    heads = head.groupBy("x").agg(F.collect_list(F.struct("at", "state", "turns", "i")).alias("heads"))
    tails = tail.groupBy("y").agg(F.collect_list(F.struct("at", "down", "j")).alias("tails"))

    def score(p: Column, q: Column) -> Column:
        links = p["i"] + q["j"]
        fits = (p["at"] == q["at"]) & (links >= 1) & (links <= depth) & (~q["down"] | (p["state"] <= 2))
        return F.when(fits, 8 - links - p["turns"] - F.when(q["down"] & (p["state"] > 0), 1).otherwise(0)).otherwise(0)

    # a pair stays one row: both ends' walks are met in it
    met = pairs.join(heads, "x", "left").join(tails, "y", "left")
    best = F.array_max(F.flatten(F.transform("heads", lambda p: F.transform("tails", lambda q: score(p, q)))))
    return met.select("x", "y", (F.greatest(F.coalesce(best, F.lit(0)), F.lit(0)) / 8).alias("score"))


def pagerank(nodes: DataFrame, relation: DataFrame, weight: float, rounds: int, checkpoint_every: int = 3, teleport: str = "sparse") -> DataFrame:
    """id, rank after ``rounds`` rounds from a uniform source of mass.

    A link passes on rank over the number of all relation rows of its source, to distinct targets; with
    ``sparse`` teleport only nodes that got rank get (1 - weight) of the source mass, with ``standard`` all.
    """
    nodes, relation = checkpointed(nodes), checkpointed(relation.select("src", "dst"))
    source = 1.0 / max(1, nodes.count())
    out = relation.groupBy("src").agg(F.count("*").alias("deg")).join(relation.distinct(), "src").select("src", "dst", "deg")
    out = checkpointed(out.repartition("src"))
    rank = nodes.select("id", F.lit(source).alias("rank"))
    for k in range(rounds):
        got = rank.withColumnRenamed("id", "src").join(out, "src").groupBy("dst").agg((F.sum(F.col("rank") / F.col("deg")) * weight).alias("got"))
        if teleport == "sparse":
            rank = got.select(F.col("dst").alias("id"), (F.col("got") + (1 - weight) * source).alias("rank"))
        else:
            rank = nodes.join(got, nodes["id"] == got["dst"], "left").select("id", (F.coalesce("got", F.lit(0.0)) + (1 - weight) * source).alias("rank"))
        if k % checkpoint_every == checkpoint_every - 1:
            rank = checkpointed(rank)
    return nodes.join(rank, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def kappa(e1: DataFrame, e2: DataFrame, n: Column) -> DataFrame:
    """One row: both, only_one, kappa of two edge sets (src, dst) over n nodes."""
    a, b = e1.select("src", "dst", F.lit(1).alias("a")), e2.select("src", "dst", F.lit(1).alias("b"))
    c = a.join(b, ["src", "dst"], "full").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("both"))
    cells = (n * n).cast("double")
    p0 = (cells - (F.col("na") + F.col("nb") - 2 * F.col("both"))) / cells
    pe = (F.col("na") * F.col("nb") + (cells - F.col("na")) * (cells - F.col("nb"))) / (cells * cells)
    return c.select("na", "nb", "both", F.when(pe != 1, F.round((p0 - pe) / (1 - pe), 9)).alias("kappa"))


def confluent(own: DataFrame, other: DataFrame) -> DataFrame:
    """``own`` (src, dst, weight) edges and those of ``other`` that two own steps reach with more than the source's share of links."""
    reach = own.select("src", F.col("dst").alias("mid"), F.col("weight").alias("w1")).join(own.select(F.col("src").alias("mid"), "dst", F.col("weight").alias("w2")), "mid").groupBy("src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).alias("two"))
    deg = own.groupBy("src").agg(F.count("*").alias("deg"))
    total = deg.agg(F.sum("deg").alias("total"))
    new = other.select("src", "dst").join(own.select("src", "dst"), ["src", "dst"], "left_anti").join(reach, ["src", "dst"]).join(deg, "src").join(F.broadcast(total))  # one row
    return own.select("src", "dst").unionByName(new.where(F.round("two", 9) > F.round(F.col("deg") / F.col("total"), 9)).select("src", "dst"))


def normalised(edges: DataFrame) -> DataFrame:
    """src, dst, weight: each row's links share 1."""
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    return edges.join(deg, "src").select("src", "dst", (1 / F.col("deg")).alias("weight"))
