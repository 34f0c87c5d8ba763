"""Procedures that go step by step: searches, label spreading, condensing and building ontologies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.plans.scratch import checkpointed


def greedy_search(starts: DataFrame, edges: DataFrame, distances: DataFrame, limit: int) -> DataFrame:
    """search, at, steps, found of walks (search, at, goal rows) that go to the neighbour nearest to any of their goals, at most ``limit`` steps.

    ``distances`` (a, b, n) are of tag pairs; unknown ones are farthest; ties go to the smaller name.
    """
    goals = starts.select("search", "goal").distinct()
    far = 1 << 30
    now = starts.groupBy("search").agg(F.min("at").alias("at")).withColumn("steps", F.lit(0))
    hit = goals.withColumnRenamed("goal", "at").withColumn("found", F.lit(True))
    now = now.join(hit, ["search", "at"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    near = checkpointed(distances.select(F.col("a").alias("next"), F.col("b").alias("goal"), "n").join(goals.select("goal").distinct(), "goal", "left_semi"))
    links = checkpointed(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    now = checkpointed(now)
    for _ in range(limit):
        going = now.where("not found").select("search", "at").join(goals, "search")
        moves = going.select("at", "goal").distinct().join(links, "at").join(near, ["next", "goal"], "left")
        gap = F.when(F.col("next") == F.col("goal"), 0).otherwise(F.coalesce("n", F.lit(far)))
        move = moves.groupBy("at", "goal").agg(F.min(F.struct(gap.alias("gap"), "next")).alias("m"))  # once for all searches that stand there
        best = going.join(move, ["at", "goal"]).groupBy("search").agg(F.min("m").alias("m")).select("search", F.col("m.next").alias("next"), (F.col("m.gap") == 0).alias("hit"))
        now = checkpointed(now.join(best, "search", "left").select("search", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.col("next").isNotNull().cast("int")).alias("steps"), (F.col("found") | F.coalesce("hit", F.lit(False))).alias("found")))
    return now


def spread_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """id, label after ``rounds`` in which every node takes the label of greatest weight around it, ties to the smallest."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = checkpointed(both)
    labels = both.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        order = Window.partitionBy("src").orderBy(F.desc("w"), "label")
        labels = votes.withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("src").alias("id"), "label")
        if k % 2 == 1:
            labels = checkpointed(labels)
    return labels


def condense(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """x, y of synsets merged: again and again the best pair of different synsets scoring over ``least``, ties by names.

    ``pairs`` (x, y, score) are the ontology's; those over ``least`` pass the driver one by one in order, since each merge
    changes the next; it holds the merges only.
    """
    rows = pairs.where(F.col("score") > least).select("score", "x", "y").orderBy(F.desc("score"), "x", "y").toLocalIterator()
    gone: dict[str, str] = {}

    def now(x: str) -> str:
        while x in gone:
            x = gone[x]
        return x

    for _, x, y in rows:
        a, b = now(x), now(y)
        if a != b:
            gone[b] = a
    return pairs.sparkSession.createDataFrame(sorted((now(b), b) for b in gone), "x string, y string")


def attachment_error(candidate: str, q: dict[str, float], above: dict[str, list[str]], decay: float) -> float:
    """Log error of a candidate: evidence along its ancestors, each link farther decayed."""
    error, seen, level, d = 0.0, {candidate}, [candidate], 0
    while level:
        for node in level:
            if node in q:
                p = decay**d * q[node]
                error -= math.log(p / (1.000001 - p))
        level = sorted({u for node in level for u in above.get(node, []) if u not in seen})
        seen.update(level)
        d += 1
    return error


def _attach(hints: list[tuple[str, float]], name: dict[str, str], above: dict[str, list[str]], decay: float) -> tuple[float, str] | None:
    """The least error and its candidate, of equal ones the last by name."""
    q = {name[p]: s for p, s in hints if p in name}
    best = None
    for candidate in sorted(q):
        error = attachment_error(candidate, q, above, decay)
        if best is None or error <= best[0]:
            best = (error, candidate)
    return best


def _ontology(parents: DataFrame, known: DataFrame) -> tuple[dict[str, list[str]], dict[str, str]]:
    above: dict[str, list[str]] = {}
    for r in parents.select("src", "dst").collect():
        above.setdefault(r.src, []).append(r.dst)
    return above, {r.lemma: r.id for r in known.select("lemma", "id").orderBy("lemma", F.desc("id")).collect()}


def build(order: DataFrame, evidence: DataFrame, parents: DataFrame, known: DataFrame, decay: float = 0.95) -> DataFrame:
    """term, parent: terms (term, place) attached one after the other where the attachment error is least, later ones also below earlier ones.

    ``evidence`` is (term, parent, q) between terms, ``known`` (lemma, id) names synsets, ``parents`` (src, dst) links them.
    Terms without a usable parent are left out.  The ontology goes to the driver, since each step changes it; the evidence
    passes it term by term.
    """
    above, name = _ontology(parents, known)
    out = []
    hints = evidence.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("parent", "q"))).alias("hints"))
    for row in order.join(hints, "term").orderBy("place").select("term", "hints").toLocalIterator():
        best = _attach([(h.parent, h.q) for h in row.hints], name, above, decay)
        if best:
            new = f"new:{row.term}"
            above[new] = [best[1]]
            name.setdefault(row.term, new)
            out.append((row.term, best[1]))
    return order.sparkSession.createDataFrame(out, "term string, parent string")


def build_branch_and_bound(order: DataFrame, evidence: DataFrame, parents: DataFrame, known: DataFrame, decay: float = 0.95, most: int = 12) -> DataFrame:
    """term, parent of the order of attachments whose summed error is least, searched depth first with the best sum so far as the bound.

    ``order`` is that of term_order() (term, in_ontology, in_list, place): terms after the first without any parent in the ontology or
    the list are left out.  The search is factorial in the terms, so more than ``most`` are refused; see build() for large lists.
    """
    above, name = _ontology(parents, known)
    rows = order.orderBy("place").limit(most + 1).collect()
    cut = next((k + 1 for k, r in enumerate(rows) if r.in_ontology + r.in_list == 0), len(rows))
    terms = [r.term for r in rows[:cut]]
    if len(terms) > most:
        raise ValueError(f"more than {most} terms to order")
    hints: dict[str, list[tuple[str, float]]] = {t: [] for t in terms}
    for r in evidence.where(F.col("term").isin(terms)).select("term", "parent", "q").orderBy("term", "parent").collect():  # of at most ``most`` terms
        hints[r.term].append((r.parent, r.q))
    best: tuple[float, list[tuple[str, str]]] = (math.inf, [])

    def search(left: list[str], added: list[tuple[str, str]], cost: float) -> None:
        nonlocal best
        tried = False
        for term in left:
            got = _attach(hints[term], name, above, decay)
            if got is None:
                continue
            tried = True
            if cost + got[0] > best[0]:
                continue
            new, had = f"new:{term}", term in name
            above[new] = [got[1]]
            name.setdefault(term, new)
            search([t for t in left if t != term], [*added, (term, got[1])], cost + got[0])
            del above[new]
            if not had:
                del name[term]
        if not tried and (len(added), -cost) > (len(best[1]), -best[0]):
            best = (cost, added)

    search(terms, [], 0.0)
    return order.sparkSession.createDataFrame(best[1], "term string, parent string")


def link_pages(pages: DataFrame, senses: DataFrame) -> DataFrame:
    """term, id, score: each page's sense (term, context words on both sides), the one of most shared context words plus one; a term's only sense is taken as it is."""
    n = senses.groupBy("term").agg(F.count("*").alias("n"))
    rows = pages.select("term", F.col("context").alias("a")).join(senses.select("term", "id", F.col("context").alias("b")), "term").join(n, "term")
    score = F.size(F.array_intersect("a", "b")) + 1
    return rows.groupBy("term").agg(F.max(F.struct((F.col("n") == 1).alias("single"), score.alias("score"), "id")).alias("m")).select("term", "m.id", "m.score")


def page_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """src, dst, n: links between pages (source, target titles) as links between the synsets that pages (title, id) are linked to.

    Pages without a synset and links of a synset to itself are left out; ``n`` counts the page links.
    """
    a, b = (pages.select(F.col("title").alias(t), F.col("id").alias(i)) for t, i in (("source", "src"), ("target", "dst")))
    return links.join(a, "source").join(b, "target").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def instance_clusters(keys: DataFrame, senses: DataFrame, clusters: DataFrame) -> DataFrame:
    """instance, id, cluster: instances' sense labels (instance, label) as synsets (label, id, several of a label) with their clusters (instance, cluster).

    The labels NM and NP name no sense.
    """
    return keys.where(~F.col("label").isin("NM", "NP")).join(senses, "label").join(clusters, "instance").select("instance", "id", "cluster").distinct()


def sample_pairs(ids: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """a, b: ``n`` pairs of different identifiers at most, by two seeded orders of MD5 digests."""

    def pick(name: str, salt: int) -> DataFrame:
        top = ids.select(F.col("id").alias(name), F.md5(F.concat_ws(" ", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(salt)))).alias("h")).distinct().orderBy("h", name).limit(n)
        return top.select(name, F.row_number().over(Window.orderBy("h", name)).alias("k"))  # n rows

    return pick("a", 1).join(pick("b", 2), "k").where("a <> b").select("a", "b")
