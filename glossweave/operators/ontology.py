"""Ontology tables: lookup with morphology, terms, senses, relations and changes to them.

Tables: ``synset`` (id, pos, definition), ``lemma`` (id, lemma, rank), ``sense`` (lemma, pos, id, number),
``relation`` (src, rel, dst).  They are as large as the ontology, not as the corpus, and join without hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.plans.scratch import checkpointed

# Endings of inflected forms and what replaces them, by part of speech, in order.
SUFFIXES = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}
# Symbols of links and of their inverses.
INVERSE = {"@": "~", "@i": "~i", "#m": "%m", "#s": "%s", "#p": "%p", "~": "@", "~i": "@i", "%m": "#m", "%s": "#s", "%p": "#p"}
SYMMETRIC = ("!", "&", "+", "$")


def tag_pos(tag: Column) -> Column:
    """n, v, a or r by a Penn tag's first letter; other tags have none."""
    first = F.substring(tag, 1, 1)
    return F.when(first == "N", "n").when(first == "V", "v").when(first == "J", "a").when(first == "R", "r")


def rule_forms(form: Column, pos: str) -> Column:
    """array<struct<ord, form>> of what the suffix rules make of a form; nouns in ``ful`` are reduced before it and keep it."""
    rules = SUFFIXES.get(pos, [])
    full = form.endswith("ful") if pos == "n" else F.lit(False)
    stem = F.when(full, F.left(form, F.length(form) - 3)).otherwise(form)
    post = F.when(full, F.lit("ful")).otherwise(F.lit(""))
    made = [
        F.when(stem.endswith(old), F.struct(F.lit(k + 1).alias("ord"), F.concat(F.left(stem, F.length(stem) - len(old)), F.lit(new), post).alias("form")))
        for k, (old, new) in enumerate(rules)
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<ord:int,form:string>>")


def morphy(words: DataFrame, exceptions: DataFrame, pos: str) -> DataFrame:
    """word, ord, form: the exception form of each word (ord 0), then every rule's form in the rules' order."""
    stem = F.when(F.col("word").endswith("ful"), F.left("word", F.length("word") - 3)).otherwise(F.col("word")) if pos == "n" else F.col("word")
    post = F.when(F.col("word").endswith("ful"), F.lit("ful")).otherwise(F.lit("")) if pos == "n" else F.lit("")
    rows = words.select("word", F.explode(rule_forms(F.col("word"), pos)).alias("f")).select("word", "f.ord", "f.form")
    known = exceptions.where(F.col("pos") == pos).select(F.col("inflected").alias("_stem"), "base")
    odd = words.select("word", stem.alias("_stem"), post.alias("_post")).join(known, "_stem").select("word", F.lit(0).alias("ord"), F.concat("base", "_post").alias("form"))
    return odd.unionByName(rows)


def lookup(words: DataFrame, senses: DataFrame, exceptions: DataFrame, pos: str) -> DataFrame:
    """word, form, id, number of the senses found at the first step that finds any.

    Steps: the form with ``_`` for spaces, its morphological forms, those of its first part, then the same with
    hyphens for spaces, and without hyphens.
    """
    base = words.select("word", F.regexp_replace("word", r"\s+", "_").alias("fixed"), F.regexp_replace("word", r"\s+", "-").alias("hyphen"))
    base = base.withColumn("bare", F.replace("hyphen", F.lit("-"), F.lit("")))

    def forms(rows: DataFrame, column: str, step: int, post: Column) -> DataFrame:
        unique = rows.select(F.col(column).alias("word")).distinct()
        made = morphy(unique, exceptions, pos).select(F.col("word").alias(column), "ord", "form")
        return rows.join(made, column).select("word", F.lit(step).alias("step"), "ord", F.concat("form", post).alias("form"))

    def exact(rows: DataFrame, column: str, step: int) -> DataFrame:
        return rows.select("word", F.lit(step).alias("step"), F.lit(0).alias("ord"), F.col(column).alias("form"))

    spaced, hyphened = base.where(F.col("word").contains(" ")), base.where(F.col("hyphen").contains("-"))
    parted = base.where(F.col("fixed").contains("_")).withColumn("head", F.split("fixed", "_", 2)[0])
    rest = F.substring("fixed", F.length("head") + 1, F.length("fixed"))
    steps = [
        exact(base, "fixed", 0), forms(base, "fixed", 1, F.lit("")), forms(parted, "head", 2, rest),
        exact(spaced, "hyphen", 3), forms(spaced, "hyphen", 4, F.lit("")), exact(hyphened, "bare", 5), forms(hyphened, "bare", 6, F.lit("")),
    ]
    tried = steps[0]
    for more in steps[1:]:
        tried = tried.unionByName(more)
    hits = tried.join(senses.where(F.col("pos") == pos).select(F.col("lemma").alias("form"), "id", "number"), "form")
    first = hits.groupBy("word").agg(F.min("step").alias("step"))
    return hits.join(first, ["word", "step"]).select("word", "form", "id", F.col("number").cast("long").alias("number"))


def get_synset(names: DataFrame, senses: DataFrame) -> DataFrame:
    """name, id of synset names ``lemma.pos.number``; null where there is none."""
    parts = names.select("name", F.regexp_extract("name", r"^(.*)\.([a-z])\.([0-9]+)$", 1).alias("lemma"), F.regexp_extract("name", r"\.([a-z])\.[0-9]+$", 1).alias("pos"), F.regexp_extract("name", r"\.([0-9]+)$", 1).cast("long").alias("number"))
    return parts.join(senses, ["lemma", "pos", "number"], "left").select("name", "id")


def terms(senses: DataFrame) -> DataFrame:
    return senses.select("lemma", "pos").distinct()


def numbered(pairs: DataFrame, order: str) -> DataFrame:
    """lemma, pos, id, number: senses of (lemma, pos) numbered from 1 in the order of ``order``."""
    turn = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy(order)).cast("long")
    return pairs.select("lemma", "pos", "id", turn.alias("number"))


def with_inverse(relation: DataFrame) -> DataFrame:
    """Relations in both directions, each once."""
    pairs = [x for k, v in INVERSE.items() for x in (F.lit(k), F.lit(v))] + [F.lit(x) for s in SYMMETRIC for x in (s, s)]
    back = relation.select(F.col("dst").alias("src"), F.element_at(F.create_map(*pairs), F.col("rel")).alias("rel"), F.col("src").alias("dst")).where("rel is not null")
    return relation.select("src", "rel", "dst").unionByName(back).distinct()


def relation_counts(relation: DataFrame) -> DataFrame:
    return relation.groupBy("src", "rel").agg(F.count("*").alias("n"))


def remove_synsets(senses: DataFrame, gone: DataFrame) -> DataFrame:
    """Senses without the synsets in ``gone`` (id), numbered anew in their order."""
    return numbered(senses.join(gone, "id", "left_anti"), "number")


def remove_relations(relation: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations that touch no removed synset, on either end."""
    return relation.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def add_synsets(senses: DataFrame, new: DataFrame) -> DataFrame:
    """Senses with those of ``new`` (lemma, pos, id) after the known ones of their lemma."""
    rows = senses.select("lemma", "pos", "id", "number").unionByName(new.select("lemma", "pos", "id", F.lit(1 << 40).cast("long").alias("number")))
    turn = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("number", "id")).cast("long")
    return rows.withColumn("number", turn)


def merge_targets(pairs: DataFrame, rounds: int = 32) -> DataFrame:
    """id, to: where each merged synset ends up, over chains of merges (keep, gone) and several into one.

    Of several targets of one synset the smallest counts; a merge that would close a circle is left out where its
    kept synset is the smallest of the circle.
    """
    hop = checkpointed(pairs.where("keep <> gone").groupBy(F.col("gone").alias("id")).agg(F.min("keep").alias("to")))
    for _ in range(rounds):  # each round doubles the links that a target is ahead
        step = hop.join(hop.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
        moved = checkpointed(step.select("id", F.coalesce("next", "to").alias("to"), (F.col("next").isNotNull() & (F.col("id") != F.col("to"))).alias("on")))
        hop = moved.where("id <> to").select("id", "to")
        if moved.where("on").isEmpty():
            break
    return hop


def merge_synsets(synset: DataFrame, relation: DataFrame, pairs: DataFrame, lemma: DataFrame | None = None, attributes: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Synsets and relations after each (keep, gone) pair is merged, and with them lemmas (id, lemma, rank) and attributes (id, name, value).

    Both of a pair must have one part of speech.  Chains end at their last synset, several may go into one: one row stays.
    Links between the merged go, all others move to the kept one; definitions, and examples if there is such a
    column, are joined by ``; ``, the kept one's first and then by id.  Lemmas follow in the order of the merged synsets, each once;
    of attributes of one name the kept synset's counts, then that of the smallest id.
    """
    pos = synset.select("id", "pos")
    pairs = pairs.join(pos.toDF("keep", "_a"), "keep").join(pos.toDF("gone", "_b"), "gone").where("_a = _b").select("keep", "gone")
    to = merge_targets(pairs)

    def target(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(to.select(F.col("id").alias(column), F.col("to").alias("_to")), column, "left")

    moved = relation
    for end in ("src", "dst"):
        moved = target(moved, end).withColumn(end, F.coalesce("_to", end)).drop("_to")
    moved = moved.select("src", "rel", "dst").where("src <> dst").distinct()
    texts = [c for c in ("definition", "examples") if c in synset.columns]
    rows = target(synset.select("id", "pos", *texts), "id").select(F.coalesce("_to", "id").alias("into"), F.col("_to").isNotNull().alias("gone"), "id", "pos", *texts)
    joined = [F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("gone", "id", F.col(c).alias("text")))), lambda x: x["text"].isNotNull()), lambda x: x["text"]), "; ").alias(c) for c in texts]
    kept = rows.groupBy(F.col("into").alias("id")).agg(F.first("pos").alias("pos"), *joined)
    out: list[DataFrame] = [kept, moved]
    if lemma is not None:
        rows = target(lemma.select("id", "lemma", "rank"), "id").select(F.coalesce("_to", "id").alias("into"), F.struct(F.col("_to").isNotNull().alias("gone"), "id", "rank").alias("place"), "lemma")
        rows = rows.groupBy("into", "lemma").agg(F.min("place").alias("place"))
        turn = F.row_number().over(Window.partitionBy("into").orderBy("place", "lemma")) - 1
        out.append(rows.select(F.col("into").alias("id"), "lemma", turn.alias("rank")))
    if attributes is not None:
        rows = target(attributes.select("id", "name", "value"), "id").select(F.coalesce("_to", "id").alias("into"), "name", F.struct(F.col("_to").isNotNull().alias("gone"), "id", "value").alias("v"))
        out.append(rows.groupBy(F.col("into").alias("id"), "name").agg(F.min("v")["value"].alias("value")))
    return tuple(out)


def replace_synset(senses: DataFrame, relation: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Senses and relations with synset ``new`` in the place of ``old``: its senses keep their numbers, its links lead to the new one."""

    def swap(column: str) -> Column:
        return F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)).alias(column)

    return senses.select("lemma", "pos", swap("id"), "number"), relation.select(swap("src"), "rel", swap("dst")).distinct()


def external_relations(lines: DataFrame, sense_keys: DataFrame, relation: DataFrame) -> DataFrame:
    """``relation`` with links between sense keys that a file adds: rows (value) of ``key rel key``, the keys named by (key, id).

    Lines of other shapes, unknown keys and links of a synset to itself add nothing.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(parts) == 3).select(parts[0].alias("a"), parts[1].alias("rel"), parts[2].alias("b"))
    new = rows.join(sense_keys.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(sense_keys.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b")
    return relation.select("src", "rel", "dst").unionByName(new.where("src <> dst").select("src", "rel", "dst")).distinct()


def sense_key_for(forms: DataFrame, keys: DataFrame) -> DataFrame:
    """id, form, key: a synset's only key, else its first key that begins with the form, else nothing (empty)."""
    rows = forms.join(keys, "id", "left")
    fits = F.min(F.when(F.startswith(F.col("key"), F.col("form")), F.struct("rank", "key")))
    one = rows.groupBy("id", "form").agg(F.count("key").alias("n"), F.min("key").alias("only"), fits.alias("first"))
    return one.select("id", "form", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("first.key", F.lit(""))).alias("key"))


def affinity(relation: DataFrame) -> DataFrame:
    """i, j, value 1 of related synsets, numbered from 1 in the order of their ids."""
    ids = relation.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    number = ids.select("id", F.dense_rank().over(Window.orderBy("id")).cast("long").alias("k"))  # as many rows as the ontology has synsets
    a, b = number.select(F.col("id").alias("src"), F.col("k").alias("i")), number.select(F.col("id").alias("dst"), F.col("k").alias("j"))
    return relation.join(a, "src").join(b, "dst").select("i", "j", F.lit(1).cast("long").alias("value")).distinct()


def gloss_lexicon(spark: SparkSession, glosses: DataFrame) -> dict[str, DataFrame]:
    """A lexicon of (item_id, words) glosses: lemmas are the first three words and the first two joined; every third synset is a verb; the parent of item k is item k / 3."""
    base = glosses.select("item_id", F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.when(F.col("item_id") % 3 == 1, "v").otherwise("n").alias("pos"), "words")
    spots = F.concat(F.slice("words", 1, 3), F.array(F.concat_ws("_", F.slice("words", 1, 2))))
    lemma = base.select("item_id", "id", "pos", F.posexplode(spots).alias("rank", "lemma")).groupBy("item_id", "id", "pos", "lemma").agg(F.min("rank").alias("rank"))
    sense = numbered(lemma, "item_id")
    relation = base.where("item_id > 0").select(F.col("id").alias("src"), F.lit("@").alias("rel"), F.concat(F.lit("b"), F.floor(F.col("item_id") / 3).cast("string")).alias("dst"))
    exceptions = lemma.where("rank = 0").select(F.concat("lemma", F.lit("en")).alias("inflected"), "pos", F.col("lemma").alias("base")).distinct()
    synset = base.select("id", "pos", F.concat_ws(" ", "words").alias("definition"), "words", "item_id")
    return {"synset": synset, "lemma": lemma, "sense": sense, "relation": relation, "exceptions": exceptions}
