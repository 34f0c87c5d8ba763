"""Small cases of operators that have no test table."""

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from glossweave.operators import annotate, depend, iterative, learn, stats
from glossweave.operators import ontology as onto
from glossweave.sources import dictionary, readers


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merges_of_several_and_in_chains(spark):
    synset = spark.createDataFrame([(x, "n", f"d{x}", None if x == "k" else f"e{x}") for x in ("k", "g1", "g2", "g3", "z")], "id string, pos string, definition string, examples string")
    rel = spark.createDataFrame([("g1", "@", "y"), ("g2", "@", "g1"), ("x", "@", "g3"), ("k", "@", "z")], ["src", "rel", "dst"])
    pairs = spark.createDataFrame([("k", "g1"), ("g1", "g2"), ("k", "g3")], ["keep", "gone"])
    lemma = spark.createDataFrame([("k", "a", 0), ("g1", "b", 0), ("g1", "a", 1), ("g2", "c", 0), ("z", "q", 0)], ["id", "lemma", "rank"])
    attributes = spark.createDataFrame([("k", "w", "1"), ("g1", "w", "2"), ("g2", "v", "3"), ("g1", "v", "4")], ["id", "name", "value"])
    kept, moved, lemmas, values = onto.merge_synsets(synset, rel, pairs, lemma, attributes)
    assert rows_of(kept) == [("k", "n", "dk; dg1; dg2; dg3", "eg1; eg2; eg3"), ("z", "n", "dz", "ez")]
    assert rows_of(moved) == [("k", "@", "y"), ("k", "@", "z"), ("x", "@", "k")]
    assert rows_of(lemmas) == [("k", "a", 0), ("k", "b", 1), ("k", "c", 2), ("z", "q", 0)]
    assert rows_of(values) == [("k", "v", "4"), ("k", "w", "1")]


def test_replaced_synset_and_external_relations(spark):
    sense = spark.createDataFrame([("w", "n", "a", 1), ("w", "n", "b", 2)], ["lemma", "pos", "id", "number"])
    rel = spark.createDataFrame([("a", "@", "b"), ("c", "@", "a")], ["src", "rel", "dst"])
    senses, moved = onto.replace_synset(sense, rel, "a", "n")
    assert rows_of(senses) == [("w", "n", "b", 2), ("w", "n", "n", 1)] and rows_of(moved) == [("c", "@", "n"), ("n", "@", "b")]
    lines = spark.createDataFrame([("k1 & k2",), ("k1 & none",), ("odd line",), ("k1 & k1",)], ["value"])
    keys = spark.createDataFrame([("k1", "a"), ("k2", "c")], ["key", "id"])
    assert rows_of(onto.external_relations(lines, keys, rel)) == [("a", "&", "c"), ("a", "@", "b"), ("c", "@", "a")]


def test_paths_in_any_tree(spark):
    """A root with two children, one of which has a child, against the join-free walk's results worked out by hand."""
    tokens = [(0, "saw", "V", 0, "root"), (1, "cat", "N", 1, "obj"), (2, "dog", "N", 1, "sub"), (3, "big", "J", 3, "mod")]
    rows = spark.createDataFrame([(1, 0, "s", *t) for t in tokens], "doc_id long, sent int, source string, tok int, word string, pos string, head int, rel string")
    found = depend.word_paths(depend.trees_of(rows), lambda x: x["pos"] == "N", 3)
    assert rows_of(found.select("word_a", "word_b", "path", "last_rel", "hops")) == [
        ("cat", "big", "obj:sub:mod:", "mod", 3), ("cat", "dog", "obj:sub:", "sub", 2), ("cat", "saw", "obj:", "obj", 1),
        ("dog", "big", "mod:", "mod", 1), ("dog", "cat", "sub:obj:", "obj", 2), ("dog", "saw", "sub:", "sub", 1),
    ]
    got = depend.relation_tuples(depend.trees_of(rows), lambda x: F.lit(True))
    assert rows_of(got) == [("dog", "mod", "big", 1), ("saw", "obj", "cat", 1), ("saw", "sub", "dog", 1)]


def test_longer_compounds(spark):
    docs = spark.createDataFrame([("new york city hall new york",), ("new york city new york city hall",)], ["text"])
    got = dict(rows_of(stats.compound_count(docs, ["new york", "new york city", "city hall"])))
    assert got == {"new york city": 3, "hall": 2, "new york": 1}


def test_headers_stand_as_nouns(spark):
    rows = spark.createDataFrame([("hot dog::4::11::eat hot-dogs gladly",), ("bad line",), ("x::9::2::short",)], ["value"])
    made = annotate.header_contexts(rows).collect()
    assert [[(t.word, t.pos) for t in r.tokens] for r in made] == [[("eat", "NN"), ("hot_dog", "NN"), ("gladly", "RB")]]
    assert annotate.header_parses(rows).first().text == "\n1\teat\t_\tNN\tNN\t_\t0\tnn\n2\thot_dog\t_\tNN\tNN\t_\t1\tnn\n3\tgladly\t_\tRB\tRB\t_\t2\trb\n"


def test_marked_texts_are_parsed_anew(spark):
    text = '<text id="a">\n<s>\nThe\tDT\nsang\tVB\n</s>\n<s>\nx\tNN\n</s>\n</text>\n'
    got = annotate.reparse_marked(spark.createDataFrame([("k", text)], ["key", "text"])).first().text
    assert got == '<text id="a">\n<s>\n1\tThe\t_\tNN\tNN\t_\t0\tnn\n2\tsang\t_\tNN\tNN\t_\t1\tnn\n</s>\n<s>\n1\tx\t_\tNN\tNN\t_\t0\tnn\n</s>\n</text>\n'


def test_page_and_instance_joins(spark):
    links = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "C"), ("B", "B")], ["source", "target"])
    pages = spark.createDataFrame([("A", "a"), ("B", "b")], ["title", "id"])
    assert rows_of(iterative.page_links(links, pages)) == [("a", "b", 2)]
    keys = spark.createDataFrame([("i1", "1"), ("i2", "NM"), ("i3", "1")], ["instance", "label"])
    senses = spark.createDataFrame([("1", "x"), ("1", "y")], ["label", "id"])
    clusters = spark.createDataFrame([("i1", 4), ("i2", 4)], ["instance", "cluster"])
    assert rows_of(iterative.instance_clusters(keys, senses, clusters)) == [("i1", "x", 4), ("i1", "y", 4)]


def test_weighted_propagation_and_alternative_senses(spark):
    vec = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("a", "z", 1.0)], ["id", "dim", "value"])
    up = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "q")], ["src", "dst"])
    weights = spark.createDataFrame([("a", 2.0), ("b", 10.0)], ["id", "weight"])
    got = {(r.id, r.dim): r.value for r in learn.propagate(vec, up, 2, weights=weights).collect()}
    assert got["p", "x"] == 22 and got["q", "x"] == 22 * 12 and ("p", "z") not in got
    senses = spark.createDataFrame([("w", "a"), ("w", "r")], ["lemma", "id"])
    parents = spark.createDataFrame([("a", "p"), ("r", "s")], ["src", "dst"])
    full = spark.createDataFrame([("a", "own", 1.0), ("a", "both", 1.0), ("a", "strange", 1.0), ("p", "own", 1.0), ("p", "both", 1.0), ("s", "both", 1.0), ("s", "strange", 1.0)], ["id", "dim", "value"])
    left = learn.zero_alternatives(full, spark.createDataFrame([("a",)], ["id"]), parents, senses)
    assert {(r.id, r.dim) for r in left.collect()} == {(r.id, r.dim) for r in full.collect()} - {("a", "strange")}


def test_attribute_cosines_and_vectors(spark):
    att = spark.createDataFrame([("a", "sem", 0, 3.0), ("a", "sem", 1, 4.0), ("b", "sem", 0, 1.0), ("a", "tag", 0, 1.0)], ["id", "name", "dim", "value"])
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], ["x", "y", "k"])
    assert rows_of(learn.attribute_features(pairs, att).select("x", "y", "k", "sem", "tag")) == [("a", "b", 1, pytest.approx(0.6), 0.0), ("a", "c", 2, 0.0, 0.0)]
    got = {r.id: r.features for r in learn.sparse_vectors(att.where("name = 'sem'"), 5).collect()}
    assert got == {"a": SparseVector(5, {0: 3.0, 1: 4.0}), "b": SparseVector(5, {0: 1.0})}


def test_branch_and_bound_orders_terms(spark):
    """The new noun that another depends on goes first, whatever the list's order."""
    order = spark.createDataFrame([("puppy", 1, 1, 1), ("pug", 2, 0, 2), ("lost", 0, 0, 3), ("never", 1, 0, 4)], ["term", "in_ontology", "in_list", "place"])
    evidence = spark.createDataFrame([("pug", "dog", 0.8), ("puppy", "pug", 0.99), ("puppy", "car", 0.3)], ["term", "parent", "q"])
    parents = spark.createDataFrame([("d", "animal"), ("c", "thing")], ["src", "dst"])
    known = spark.createDataFrame([("dog", "d"), ("car", "c")], ["lemma", "id"])
    got = {r.term: r.parent for r in iterative.build_branch_and_bound(order, evidence, parents, known).collect()}
    assert got == {"pug": "d", "puppy": "new:pug"}
    with pytest.raises(ValueError, match="more than 1"):
        iterative.build_branch_and_bound(order, evidence, parents, known, most=1)


def test_models_and_bases_are_saved(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), int(i > 10)) for i in range(20)], ["a", "y"])
    model = learn.train(rows, "y", ["a"])
    learn.save_model(model, f"{tmp_path}/m")
    assert learn.load_model(f"{tmp_path}/m").coefficients == model.coefficients
    basis = spark.createDataFrame([("nn:", 0), ("vb:", 1)], ["path", "dim"])
    dictionary.save_basis(basis, f"{tmp_path}/b")
    assert rows_of(dictionary.read_basis(spark, f"{tmp_path}/b")) == rows_of(basis)


def test_vector_files_and_sense_maps(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\ncat|1.0 2 3\ndog|0.5,0.25,0\nbad|x y z\n")
    assert rows_of(readers.word_vectors(spark, f"{tmp_path}/v.txt")) == [("cat", [1.0, 2.0, 3.0]), ("dog", [0.5, 0.25, 0.0])]
    old = spark.createDataFrame([("dog", "n", "d", 1, 10), ("big", "a", "b", 1, 5)], ["lemma", "pos", "id", "number", "offset"])
    new = spark.createDataFrame([("dog", "n", "d", 2, 30), ("big", "a", "b", 1, 9)], ["lemma", "pos", "id", "number", "offset"])
    assert rows_of(dictionary.sense_map_lines(old, new)) == [("n", "dog%1:00:00::;1;10 dog%1:00:00::;2;30")]


def test_breadth_first_layout(spark):
    synset = spark.createDataFrame([(x, "n", [x], "") for x in ("a", "b", "c", "d", "loop1", "loop2")], "id string, pos string, lemmas array<string>, definition string")
    rel = spark.createDataFrame([("a", "@", "d"), ("b", "@", "c"), ("c", "@", "d"), ("loop1", "@", "loop2"), ("loop2", "@", "loop1")], ["src", "rel", "dst"])
    place = dictionary.breadth_first(synset, rel)
    assert [r.id for r in place.orderBy("place").collect()] == ["d", "a", "c", "b", "loop1", "loop2"]
    lines = dictionary.data_lines(synset.join(place, "id"), rel).orderBy("offset").collect()
    assert [x.line.split(" ")[4] for x in lines] == ["d", "a", "c", "b", "loop1", "loop2"] and lines[0].offset == 0


def test_hash_of_characters_beyond_the_basic_plane(spark):
    """Two code units of a character above U+FFFF, as the published polynomial takes them."""

    def want(text):
        h = 0
        raw = text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "a", "doc-17", "é日", "🏽x🏽", "a long identifier of a document"]
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", readers.java_hash(F.col("t")).alias("h")).collect()}
    assert got == {t: want(t) for t in texts}


def test_held_out_nouns(spark):
    sense = spark.createDataFrame([("w", "n", "a", 1), ("w", "v", "v", 1), ("p", "n", "b", 1), ("o", "n", "a", 1)], ["lemma", "pos", "id", "number"])
    rel = spark.createDataFrame([("a", "@", "b"), ("c", "@", "b")], ["src", "rel", "dst"])
    truth, senses, relation = learn.held_out(sense, rel, spark.createDataFrame([("w",)], ["lemma"]))
    assert rows_of(truth) == [("w", "b")] and rows_of(relation.select("src", "rel", "dst")) == [("c", "@", "b")]
    assert rows_of(senses.select("lemma", "pos", "id")) == [("p", "n", "b"), ("w", "v", "v")]
