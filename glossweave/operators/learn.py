"""Ontology learning: evidence to labels, a linear model, attachment points, orders and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.operators.ontology import remove_relations, remove_synsets
from glossweave.plans.scratch import checkpointed


def _ratio(q: Column, d: Column, decay: float) -> Column:
    p = F.pow(F.lit(decay), d - 1) * q
    return p / (1.000001 - p)


def attachments(evidence: DataFrame, paths: DataFrame, decay: float = 0.95, cousins: DataFrame | None = None) -> DataFrame:
    """term, id, score of every candidate synset of a term's evidence (term, id, q).

    The score is the candidate's own ratio at distance 1, times the ratios of the evidence along its root
    paths (id, path; the candidate itself is at distance 0), times those of its cousins (id, cousin) without decay.
    """
    own = evidence.select("term", "id", F.log(_ratio(F.col("q"), F.lit(1), decay)).alias("own"))
    steps = paths.select("id", F.posexplode(F.reverse("path")).alias("d", "anc"))
    along = evidence.select("term", "id").join(steps, "id").join(evidence.select("term", F.col("id").alias("anc"), F.col("q").alias("p")), ["term", "anc"])
    total = along.groupBy("term", "id").agg(F.sum(F.log(_ratio(F.col("p"), F.col("d"), decay))).alias("along"))
    rows = own.join(total, ["term", "id"])
    score = F.col("own") + F.col("along")
    if cousins is not None:
        near = evidence.select("term", "id").join(cousins, "id").join(evidence.select("term", F.col("id").alias("cousin"), F.col("q").alias("p")), ["term", "cousin"])
        side = near.groupBy("term", "id").agg(F.sum(F.log(_ratio(F.col("p"), F.lit(1), 1.0))).alias("side"))
        rows = rows.join(side, ["term", "id"], "left")
        score = score + F.coalesce("side", F.lit(0.0))
    return rows.select("term", "id", F.exp(score).alias("score"))


def attachment_errors(evidence: DataFrame, paths: DataFrame, decay: float = 0.95) -> DataFrame:
    """term, id, score: the inverse ratios along the root paths, each one link farther, multiplied."""
    steps = paths.select("id", F.posexplode(F.reverse("path")).alias("d", "anc"))
    along = evidence.select("term", "id").join(steps, "id").join(evidence.select("term", F.col("id").alias("anc"), F.col("q").alias("p")), ["term", "anc"])
    return along.groupBy("term", "id").agg(F.exp(-F.sum(F.log(_ratio(F.col("p"), F.col("d") + 1, decay)))).alias("score"))


def best(scores: DataFrame, most: bool = True) -> DataFrame:
    """term, id, score of the best candidate, by the score to nine digits, then the largest id."""
    mark = F.round("score", 9)
    top = F.max(F.struct((mark if most else -mark).alias("s"), "id")).alias("t")
    return scores.groupBy("term").agg(top).select("term", "t.id", (F.col("t.s") if most else -F.col("t.s")).alias("score"))


def term_order(parents: DataFrame, known: DataFrame, listed: DataFrame, in_ontology: bool = True) -> DataFrame:
    """term, in_ontology, in_list, place: the order in which terms are added.

    ``parents`` (term, parent) are compared with the ontology's terms (known.lemma) and the terms to add
    (listed.term); ties by term.
    """
    rows = parents.join(known.select(F.col("lemma").alias("parent"), F.lit(1).alias("k")).distinct(), "parent", "left").join(listed.select(F.col("term").alias("parent"), F.lit(1).alias("l")).distinct(), "parent", "left")
    counts = rows.groupBy("term").agg(F.count("k").alias("in_ontology"), F.count("l").alias("in_list"))
    return placed(counts, in_ontology)


def placed(counts: DataFrame, in_ontology: bool = True) -> DataFrame:
    """The order of term_order() from its counts (term, in_ontology, in_list); terms are as many as the corpus has, so no task numbers them all."""
    order = [F.desc("in_ontology"), F.desc("in_list"), "term"] if in_ontology else [F.asc("in_list"), F.desc("in_ontology"), "term"]
    return in_turn(counts, "place", *order)


def in_turn(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows`` with their places from 1 in an order: sorted by ranges, numbered within each, ranges after one another by their sizes."""
    at = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r.k: r.n for r in at.groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect()}  # as many as partitions
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    place = F.get(F.lit(before), part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1 if before else F.lit(0)
    return at.select(*rows.columns, place.cast("long").alias(name))


def builder_score(assigned: DataFrame, truth: DataFrame, sims: DataFrame) -> DataFrame:
    """answered, total, average: over the assigned terms, the greatest similarity (x, y, sim) of a true and an assigned parent, 0 without any."""
    rows = assigned.select("term", F.col("id").alias("y")).join(truth.select("term", F.col("id").alias("x")), "term", "left").join(sims, ["x", "y"], "left")
    each = rows.groupBy("term").agg(F.coalesce(F.max("sim"), F.lit(0.0)).alias("sim"))
    return each.agg(F.count("*").alias("answered"), F.round(F.sum("sim"), 6).alias("total"), F.round(F.avg("sim"), 6).alias("average"))


def sense_pairs(senses: DataFrame) -> DataFrame:
    """lemma, pos, x, y: senses of one lemma, the earlier first; the senses of a lemma are few and known to the ontology."""
    a, b = senses.toDF("lemma", "pos", "x", "i"), senses.toDF("lemma", "pos", "y", "j")
    return a.join(b, ["lemma", "pos"]).where("i < j").select("lemma", "pos", "x", "y")


def train(features: DataFrame, label: str, columns: list[str], l1: float = 0.001, passes: int = 100):
    """L1 logistic regression of a 0/1 label on numeric columns: the batch optimum, on executors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features).select("features", F.col(label).cast("double").alias("label"))
    return LogisticRegression(elasticNetParam=1.0, regParam=l1, maxIter=passes).fit(rows)


def classify(model, features: DataFrame, columns: list[str]) -> DataFrame:
    """``features`` with ``p``, the probability of label 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(features))
    return rows.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def propagate(vectors: DataFrame, parents: DataFrame, levels: int, least: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """id, dim, value: leaf vectors and, level by level, those of parents: dimensions in at least min(least, children) children, summed.

    With ``weights`` (id, weight) of leaves, values are summed times their child's weight, and a parent weighs what its children weigh together.
    """
    sizes = parents.groupBy("dst").agg(F.count("*").alias("children"))
    links = parents.select(F.col("src").alias("id"), "dst")
    out = now = vectors.select("id", "dim", "value")
    heavy = weights.select("id", "weight") if weights is not None else vectors.select("id").distinct().withColumn("weight", F.lit(1.0))
    for _ in range(levels):
        now = checkpointed(now)
        share = F.col("value") * (F.col("weight") if weights is not None else F.lit(1.0))
        up = now.join(heavy, "id").join(links, "id").groupBy("dst", "dim").agg(F.sum(share).alias("value"), F.count("*").alias("n"))
        had = now.select("id").distinct()  # only children with a vector weigh
        heavy = checkpointed(heavy.join(had, "id").join(links, "id").groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("weight")))
        now = up.join(sizes, "dst").where(F.col("n") >= F.least(F.lit(least), F.col("children"))).select(F.col("dst").alias("id"), "dim", "value")
        out = out.unionByName(now)
    return out.groupBy("id", "dim").agg(F.sum("value").alias("value"))


def zero_alternatives(vectors: DataFrame, leaves: DataFrame, parents: DataFrame, senses: DataFrame) -> DataFrame:
    """``vectors`` (id, dim, value) without those dimensions of leaves (id) that belong to other senses of their words.

    A dimension goes if a parent of another sense (lemma, id) of one of the leaf's lemmas has it and no parent of the leaf does.
    """
    up = parents.select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    held = vectors.select(F.col("id").alias("parent"), "dim").distinct()
    own = leaves.select("id").join(up, "id").join(held, "parent").select("id", "dim").distinct()
    same = senses.select("lemma", "id").distinct()
    other = leaves.select("id").join(same, "id").join(same.select("lemma", F.col("id").alias("rival")), "lemma").where("id <> rival").select("id", "rival").distinct()
    strange = other.join(up.select(F.col("id").alias("rival"), "parent"), "rival").join(held, "parent").select("id", "dim").distinct()
    return vectors.join(strange.join(own, ["id", "dim"], "left_anti"), ["id", "dim"], "left_anti")


def attribute_features(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """``pairs`` (x, y, ...) with a column for each attribute name: the cosine of both ends' vectors (id, name, dim, value), 0 where one has none.

    Names are those of the ontology's attributes, a few.
    """
    sizes = attributes.groupBy("id", "name").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    a = attributes.select(F.col("id").alias("x"), "name", "dim", F.col("value").alias("u"))
    b = attributes.select(F.col("id").alias("y"), "name", "dim", F.col("value").alias("w"))
    ends = pairs.select("x", "y").distinct()
    dots = ends.join(a, "x").join(b, ["y", "name", "dim"]).groupBy("x", "y", "name").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    dots = dots.join(sizes.toDF("x", "name", "nx"), ["x", "name"]).join(sizes.toDF("y", "name", "ny"), ["y", "name"])
    names = sorted(r.name for r in attributes.select("name").distinct().collect())
    wide = dots.groupBy("x", "y").pivot("name", names).agg(F.first(F.col("dot") / (F.col("nx") * F.col("ny"))))
    return pairs.join(wide, ["x", "y"], "left").fillna(0.0, names)


def sparse_vectors(rows: DataFrame, size: int) -> DataFrame:
    """id, features: long vectors (id, dim from 0, value) as the sparse vectors that the model library takes."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    made = F.udf(lambda entries: SparseVector(size, [(e.dim, e.value) for e in entries]), VectorUDT())
    summed = rows.groupBy("id", "dim").agg(F.sum("value").alias("value"))
    return summed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("e")).select("id", made("e").alias("features"))


def held_out(senses: DataFrame, relation: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an ontology knew of test nouns (lemma, parent of their synsets), and senses and relations without those synsets."""
    gone = senses.where("pos = 'n'").join(terms.select("lemma").distinct(), "lemma", "left_semi").select("lemma", "id").distinct()
    truth = gone.join(relation.where("rel = '@'").select(F.col("src").alias("id"), F.col("dst").alias("parent")), "id").select("lemma", "parent").distinct()
    ids = gone.select("id").distinct()
    return truth, remove_synsets(senses, ids), remove_relations(relation, ids)


def save_model(model, path: str) -> None:
    """Write a model of train(); load_model() reads it."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml.classification import LogisticRegressionModel

    return LogisticRegressionModel.load(path)
