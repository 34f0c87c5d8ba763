from glossweave.operators import iterative
from glossweave.plans import shell


def test_greedy_search(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("x", "y")], ["src", "dst"])
    near = spark.createDataFrame([("b", "d", 1), ("c", "d", 5)], ["a", "b", "n"])
    starts = spark.createDataFrame([(1, "a", "d"), (2, "x", "d"), (3, "d", "d")], ["search", "at", "goal"])
    got = {r.search: (r.at, r.steps, r.found) for r in iterative.greedy_search(starts, edges, near, 4).collect()}
    assert got == {1: ("d", 2, True), 2: ("y", 1, False), 3: ("d", 0, True)}


def test_labels_settle_in_groups(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)], ["src", "dst", "weight"])
    got = {r.id: r.label for r in iterative.spread_labels(edges, 6).collect()}
    assert {got[i] for i in (0, 1, 2)}.isdisjoint({got[i] for i in (3, 4, 5)})


def test_condense(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.4)], ["x", "y", "score"])
    assert [tuple(r) for r in iterative.condense(pairs).collect()] == [("a", "b"), ("a", "c")]


def test_build_attaches_below_new_terms(spark):
    order = spark.createDataFrame([("puppy", 2), ("pug", 1), ("lost", 3)], ["term", "place"])
    evidence = spark.createDataFrame([("pug", "dog", 0.8), ("pug", "car", 0.3), ("puppy", "pug", 0.8), ("puppy", "dog", 0.7)], ["term", "parent", "q"])
    parents = spark.createDataFrame([("d", "animal"), ("c", "thing")], ["src", "dst"])
    known = spark.createDataFrame([("dog", "d"), ("car", "c")], ["lemma", "id"])
    assert {r.term: r.parent for r in iterative.build(order, evidence, parents, known).collect()} == {"pug": "d", "puppy": "new:pug"}


def test_links_and_samples(spark):
    pages = spark.createDataFrame([("cat", ["pet", "fur"]), ("java", ["island"])], ["term", "context"])
    senses = spark.createDataFrame([("cat", "c1", ["jazz"]), ("cat", "c2", ["pet"]), ("java", "j", ["code"])], ["term", "id", "context"])
    assert {r.term: (r.id, r.score) for r in iterative.link_pages(pages, senses).collect()} == {"cat": ("c2", 2), "java": ("j", 1)}
    ids = spark.range(50)
    one, two = (sorted(tuple(r) for r in iterative.sample_pairs(ids, 10).collect()) for _ in range(2))
    assert one == two and 5 <= len(one) <= 10 and all(a != b for a, b in one)


def test_shell(spark):
    senses = spark.createDataFrame([("cat", "n", "c1", 1)], "lemma string, pos string, id string, number long")
    rel = spark.createDataFrame([("c1", "@", "animal")], ["src", "rel", "dst"])
    said = []
    lines = iter(["gs cat.n.1", "gr cat.n.1", "gs dog.n.1", "help", "quit"])
    shell.run(senses, rel, lambda _: next(lines), said.append)
    assert said == ["c1", "@ animal", "no synset dog.n.1", shell.HELP]
