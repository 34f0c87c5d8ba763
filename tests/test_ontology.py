import math

import pytest
from pyspark.sql import functions as F

from glossweave.operators import graph, learn, similarity, wsd
from glossweave.operators import ontology as onto


@pytest.fixture(scope="module")
def two_paths(spark):
    return spark.createDataFrame([("synset", "parent1"), ("parent1", "parent11"), ("parent11", "root"), ("synset", "parent2"), ("parent2", "root")], ["src", "dst"])


def ids(rel):
    return rel.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def test_two_root_paths(two_paths):
    paths = graph.parent_paths(ids(two_paths), two_paths, 5).where("id = 'synset'").collect()
    assert sorted(len(r.path) for r in paths) == [3, 4]
    depth = graph.depths(graph.closure(ids(two_paths), two_paths, 5), two_paths).where("id = 'synset'").first()
    assert (depth.min_depth, depth.max_depth) == (2, 3)


def test_cycles_end(spark):
    rel = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], ["src", "dst"])
    got = {(r.id, r.anc): r.dmin for r in graph.closure(ids(rel), rel, 4).collect()}
    assert got["a", "c"] == 2 and got["a", "a"] == 0
    assert sorted(r.path for r in graph.parent_paths(ids(rel), rel, 6).where("id = 'a'").collect()) == [["c", "b", "a"]]


def chains(spark, a, b):
    """Chains of a and b nodes under one subsumer, s1 and s2 below them."""
    rel = []
    for name, n in (("s1", a), ("s2", b)):
        walk = [name, *(f"{name}_{k}" for k in range(n)), "sub"]
        rel += list(zip(walk, walk[1:]))
    return spark.createDataFrame(rel, ["src", "dst"])


def pair(spark):
    return spark.createDataFrame([("s1", "s2")], ["x", "y"])


@pytest.mark.parametrize("noun,score", [(True, 4 / 12), (False, 2 / 10)])
def test_wu_palmer(spark, noun, score):
    rel = chains(spark, 4, 2)
    close = graph.closure(ids(rel), rel, 8)
    one = graph.one_lcs(graph.lcs(pair(spark), close, graph.depths(close, rel)))
    got = one.select(similarity.wu_palmer(F.col("depth"), F.col("xmin"), F.col("ymin"), F.lit(noun)).alias("s")).first().s
    assert got == pytest.approx(score)


@pytest.mark.parametrize("deep", [1, 2])
def test_leacock_chodorow(spark, deep):
    rel = chains(spark, 3, 1)
    d = graph.path_lengths(pair(spark), graph.closure(ids(rel), rel, 8))
    got = d.select(similarity.leacock_chodorow(F.col("shortest"), F.lit(True), F.lit(deep)).alias("a"), similarity.leacock_chodorow_scaled(F.col("shortest"), F.lit(True), F.lit(deep)).alias("b")).first()
    assert got.a == pytest.approx(-math.log(7 / (2 * deep)))
    assert got.b == pytest.approx(-math.log(7 / (2 * deep)) / -math.log(1 / (2 * deep)))


def test_unrelated_pairs(spark):
    rel = spark.createDataFrame([("a", "r1"), ("b", "r2")], ["src", "dst"])
    got = graph.path_lengths(spark.createDataFrame([("a", "b")], ["x", "y"]), graph.closure(ids(rel), rel, 3)).first()
    assert (got.shortest, got.longest) == (-1, 0)
    assert spark.range(1).select(similarity.path(F.lit(-1))).first()[0] == 0


def test_content_measures(spark):
    common = spark.createDataFrame([("s1", "s2", "a"), ("s1", "s2", "b"), ("s1", "s2", "c")], ["x", "y", "anc"])
    ic = spark.createDataFrame([("b", 10.0), ("c", 5.0)], ["id", "ic"])
    assert similarity.resnik(common, ic).first().resnik == 10
    row = spark.range(1).select(
        similarity.lin(F.lit(2.0), F.lit(3.0), F.lit(10.0)).alias("lin"), similarity.jiang_conrath(F.lit(False), F.lit(10.0), F.lit(11.0), F.lit(10.0)).alias("jcn"),
        similarity.jiang_conrath(F.lit(True), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("same"), similarity.lin(F.lit(-1.0), F.lit(3.0), F.lit(1.0)).alias("missing"),
    ).first()
    assert (row.lin, row.jcn, row.same, row.missing) == (4, 1, similarity.MOST, 0)


def test_lesk_measures(spark):
    glosses = spark.createDataFrame([("s1", "how now brown cow".split()), ("s2", "how now sad meow".split()), ("h", "cow sad sad".split())], ["id", "words"])
    score = {(r.x, r.y): r.score for r in similarity.gloss_pairs(glosses, "lesk").collect()}
    assert score["s1", "s2"] == 2
    rel = spark.createDataFrame([("s2", "@", "h")], ["src", "rel", "dst"])
    ext = {(r.x, r.y): r.score for r in similarity.extended_lesk(glosses, rel).collect()}
    assert ext["s1", "s2"] == 6


def test_hirst_st_onge(spark):
    rel = onto.with_inverse(spark.createDataFrame([("a", "@", "r"), ("b", "@", "r"), ("c", "@", "b")], ["src", "rel", "dst"]))
    got = {(r.x, r.y): r.score for r in graph.hirst_st_onge(spark.createDataFrame([("a",)], ["x"]), rel).collect()}
    assert got["a", "r"] == 7 / 8 and got["a", "b"] == 5 / 8 and got["a", "c"] == 4 / 8


def test_morphology(spark):
    words = spark.createDataFrame([("churches",), ("handsful",), ("geese",)], ["word"])
    exc = spark.createDataFrame([("geese", "n", "goose")], ["inflected", "pos", "base"])
    got = {}
    for r in onto.morphy(words, exc, "n").orderBy("ord").collect():
        got.setdefault(r.word, []).append(r.form)
    assert got == {"churches": ["churche", "church"], "handsful": ["handful"], "geese": ["goose"]}


def test_lookup_steps(spark):
    sense = spark.createDataFrame([("guest_room", "n", "g", 1), ("dog", "n", "d", 1), ("hotdog", "n", "h", 1)], ["lemma", "pos", "id", "number"])
    exc = spark.createDataFrame([], "inflected string, pos string, base string")
    words = spark.createDataFrame([("guest room",), ("guests room",), ("dogs",), ("hot dog",), ("hot-dogs",), ("none",)], ["word"])
    assert {r.word: r.id for r in onto.lookup(words, sense, exc, "n").collect()} == {"guest room": "g", "guests room": "g", "dogs": "d", "hot dog": "h", "hot-dogs": "h"}


def test_merge_keeps_other_links_and_parts_of_speech_apart(spark):
    synset = spark.createDataFrame([("a", "n", "x"), ("b", "n", "y"), ("v", "v", "z"), ("p", "n", "q")], ["id", "pos", "definition"])
    rel = spark.createDataFrame([("a", "@", "b"), ("b", "@", "p"), ("v", "@", "b")], ["src", "rel", "dst"])
    kept, moved = onto.merge_synsets(synset, rel, spark.createDataFrame([("a", "b"), ("p", "v")], ["keep", "gone"]))
    assert {r.id: r.definition for r in kept.collect()} == {"a": "x; y", "v": "z", "p": "q"}
    assert {tuple(r) for r in moved.collect()} == {("a", "@", "p"), ("v", "@", "a")}


def test_added_and_removed_senses_are_renumbered(spark):
    sense = spark.createDataFrame([("w", "n", "a", 1), ("w", "n", "b", 2)], ["lemma", "pos", "id", "number"])
    more = onto.add_synsets(sense, spark.createDataFrame([("w", "n", "c")], ["lemma", "pos", "id"]))
    less = onto.remove_synsets(more, spark.createDataFrame([("a",)], ["id"]))
    assert [(r.id, r.number) for r in less.orderBy("number").collect()] == [("b", 1), ("c", 2)]


SENSES = [("cat", 1, "cat.n.1", "fluffy cute pet"), ("cat", 2, "cat.n.2", "fluffy machine pet that is not cute"), ("cat", 3, "cat.n.3", "cute lady"), ("brown", 1, "brown.n.1", "a color"), ("brown", 2, "brown.n.2", "cut but ugly pet"), ("chicken", 1, "chicken.n.1", "fluffy cute beast"), ("like", 1, "like.n.1", "fluffy machine pet that is not cute")]


def test_lesk_picks_the_sense_of_its_neighbours(spark):
    docs = spark.createDataFrame([(1, "the cat is brown and chicken like")], ["doc_id", "text"])
    senses = spark.createDataFrame([(w, "n", i, k) for w, k, i, _ in SENSES], "lemma string, pos string, id string, number int")
    glosses = spark.createDataFrame([(i, g.split()) for _, _, i, g in SENSES], ["id", "words"])
    got = wsd.window_lesk(docs, senses, similarity.gloss_pairs(glosses, "lesk"), ["cat", "brown", "chicken", "like"])
    assert {r.gpos: r.id for r in got.collect()}[1] == "cat.n.2"


@pytest.mark.parametrize("method", ["degree", "pagerank", "personal"])
def test_graph_methods(method):
    near = {}
    for a, b in [("cat.n.1", "brown.n.1"), ("cat.n.1", "brown.n.2"), ("cat.n.1", "chicken.n.1"), ("cat.n.1", "chicken.n.2"), ("cat.n.2", "chicken.n.2"), ("cat.n.3", "brown.n.2")]:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    words = [(1, ["cat.n.2", "cat.n.3", "cat.n.1"]), (3, ["brown.n.1", "brown.n.2"]), (5, ["chicken.n.1", "chicken.n.2"]), (6, ["like.n.1"])]
    assert wsd.disambiguate_sentence(words, near, method)[1] == "cat.n.1"


def test_graph_senses_as_a_plan(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "Cat", "NN"), (1, 0, 1, "runs", "VB"), (2, 0, 0, "dog", "NN")], "doc_id long, sent int, tok int, word string, pos string")
    senses = spark.createDataFrame([("cat", "n", "c1", 1), ("cat", "n", "c2", 2), ("runs", "v", "r1", 1)], "lemma string, pos string, id string, number int")
    rel = spark.createDataFrame([("c1", "@", "r1"), ("r1", "~", "c1")], ["src", "rel", "dst"])
    assert {(r.tok, r.id) for r in wsd.graph_senses(tokens, senses, rel, "degree").collect()} == {(0, "c1"), (1, "r1")}


def test_kappa(spark):
    a = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], ["src", "dst"])
    b = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], ["src", "dst"])
    p0, pe = 34 / 36, (9 + 33 * 33) / 36**2
    assert graph.kappa(a, b, F.lit(6)).first().kappa == pytest.approx((p0 - pe) / (1 - pe), abs=1e-6)
    assert graph.kappa(a, a, F.lit(6)).first().kappa == 1


def test_confluence_raises_agreement(spark):
    a = spark.createDataFrame([(0, 1), (1, 2), (0, 3)], ["src", "dst"])
    b = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], ["src", "dst"])
    grown = graph.confluent(graph.normalised(a), b)
    assert graph.kappa(grown, b, F.lit(6)).first().kappa >= graph.kappa(a, b, F.lit(6)).first().kappa


def test_pagerank_keeps_mass_with_standard_teleport(spark):
    rel = spark.createDataFrame([("a", "x", "b"), ("b", "x", "a"), ("a", "y", "b")], ["src", "rel", "dst"])
    nodes = spark.createDataFrame([("a",), ("b",)], ["id"])
    got = {r.id: r.rank for r in graph.pagerank(nodes, rel, 0.85, 12, teleport="standard").collect()}
    assert got["b"] < got["a"]  # two relations to one target pass on half


def test_attachment_prefers_consistent_evidence(spark):
    paths = spark.createDataFrame([("dog", ["root", "animal", "dog"]), ("car", ["root", "car"])], ["id", "path"])
    evidence = spark.createDataFrame([("pug", "dog", 0.6), ("pug", "animal", 0.6), ("pug", "car", 0.6)], ["term", "id", "q"])
    assert learn.best(learn.attachments(evidence, spark.createDataFrame([("animal", ["root", "animal"])], ["id", "path"]).unionByName(paths))).first().id == "dog"
    assert learn.best(learn.attachment_errors(evidence, paths), most=False).first().id == "dog"


def test_model_separates_classes(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), int(i > 10)) for i in range(20)], ["a", "b", "y"])
    scored = learn.classify(learn.train(rows, "y", ["a", "b"]), rows, ["a", "b"])
    assert scored.where("(p > 0.5) = (y = 1)").count() == 20


def test_vectors_climb_with_enough_children(spark):
    vec = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("a", "z", 1.0)], ["id", "dim", "value"])
    up = spark.createDataFrame([("a", "p"), ("b", "p")], ["src", "dst"])
    got = {(r.id, r.dim): r.value for r in learn.propagate(vec, up, 1).collect()}
    assert got["p", "x"] == 3 and ("p", "z") not in got
