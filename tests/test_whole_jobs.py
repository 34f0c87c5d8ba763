"""Queries do the operator's whole job: rare words, pairs below the top of the taxonomy."""

import random
from collections import Counter

import pytest

from glossweave.operators import graph
from glossweave.plans import corpus_queries, ontology_queries

TEXTS = [(1, "ann sees wood. rarely the tree burned", "a"), (2, "wood and stone\nstone", "b")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    filler = [(9 + k, " ".join(f"w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(210)), "c") for k in range(3)]  # 210 words in more documents
    spark.createDataFrame(TEXTS + filler, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pairs_of_rare_nouns(spark, small):
    want = Counter()
    for _, text, source in TEXTS:
        for sentence in text.replace(". ", "\n").split("\n"):
            tagged = [(w, "rb" if w.endswith("ly") else "vb" if w.endswith("ed") else "nn") for w in sentence.split()]
            for i, (a, tag_a) in enumerate(tagged):
                for j, (b, tag_b) in enumerate(tagged):
                    if tag_a == tag_b == "nn" and 0 < abs(i - j) <= 3:  # the link between two neighbours is named for the later one
                        rels = [tagged[k][1] for k in (range(i + 1, j + 1) if i < j else range(i, j, -1))]
                        want[a, b, source, "".join(r + ":" for r in rels)] += 1
    got = {(r.noun1, r.noun2, r.source, r.path): r.cnt for r in corpus_queries.noun_pairs(spark, small).where("source <> 'c'").collect()}
    assert got == want


def test_cooccurrence_of_rare_words(spark, small):
    got = {(r.word, r.other): r.n for r in corpus_queries.dep_cooc(spark, small).collect()}
    assert got["ann", "wood-nn"] == 1 and got["rarely", "tree-nn"] == 1 and got["burned", "the-nn"] == 1


def test_hirst_st_onge_of_stated_pairs(spark):
    """The same scores as walks to everywhere, on a graph with links of all ways."""
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(14)]
    rel = spark.createDataFrame([(rng.choice(nodes), rng.choice("@@~^"), rng.choice(nodes)) for _ in range(26)], ["src", "rel", "dst"])
    want = {(r.x, r.y): r.score for r in graph.hirst_st_onge(spark.createDataFrame([(n,) for n in nodes], ["x"]), rel).collect()}
    pairs = [(a, b) for a in nodes for b in nodes]
    got = {(r.x, r.y): r.score for r in graph.pair_hirst_st_onge(spark.createDataFrame(pairs, ["x", "y"]), rel).collect()}
    assert got == {p: want.get(p, 0.0) for p in pairs}
    assert len(set(got.values())) > 4


def test_sim_hso_scores_traded_pairs(spark, sf_dir):
    rows = ontology_queries.sim_hso(spark, sf_dir).toPandas()
    leaf = rows.x.str[0].isin(["c", "s"]) | rows.y.str[0].isin(["c", "s"])
    pairs = ontology_queries.traded(spark, sf_dir).toPandas()
    got = dict(zip(zip(rows[leaf].x, rows[leaf].y), rows[leaf].score))
    assert len(got) == leaf.sum() and set(got) == set(zip(pairs.x, pairs.y))
    rel = ontology_queries.taxonomy(spark, sf_dir).toPandas()
    parents = rel.groupby("src").dst.apply(set).to_dict()

    def above(node):
        out, level = {node: 0}, {node}
        for d in range(1, 5):
            level = {p for n in level for p in parents.get(n, ())}
            out = {**{n: d for n in level}, **out}
        return out

    for (x, y), score in got.items():
        a, b = above(x), above(y)
        assert score == max([7 - a[n] - b[n] for n in a if n in b and a[n] + b[n] <= 5], default=0) / 8
