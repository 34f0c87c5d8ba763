"""Every registered query with a DuckDB statement gives the same rows."""

import duckdb
import pandas as pd
import pytest

from glossweave.operators import wsd
from glossweave.plans import corpus_queries, ontology_queries, procedure_queries

ORACLES = {**corpus_queries.ORACLES, **ontology_queries.ORACLES, **procedure_queries.ORACLES}
ALL = {**corpus_queries.QUERIES, **ontology_queries.QUERIES, **procedure_queries.QUERIES}
QUERIES = {name: query for name, query in ALL.items() if name in ORACLES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_each_has_a_statement():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) == 94
    assert set(ALL) - set(ORACLES) == {"ontology_built", "model_scores", "wsd_degree", "wsd_pagerank", "wsd_personal"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    assert a.equals(b)


def test_graph_disambiguation_sentence_by_sentence(spark, sf_dir):
    """Every sentence of the table against the plain function, on a graph gathered apart."""
    lex = {k: v.toPandas() for k, v in ontology_queries.lexicon(spark, sf_dir).items()}
    sense, synset, rel = lex["sense"], lex["synset"], lex["relation"]
    single = {lemma: ids.iloc[0] for lemma, ids in sense.groupby("lemma")["id"].unique().apply(lambda x: x if len(x) == 1 else None).dropna().apply(pd.Series).iterrows()}
    links = sorted({(a, b) for a, b in zip(rel.src, rel.dst)} | {(b, a) for a, b in zip(rel.src, rel.dst)})
    links += sorted({(r.id, single[w]) for r in synset.itertuples() for w in r.definition.lower().split() if w in single and single[w] != r.id})
    near = {}
    for a, b in sorted(links):
        near.setdefault(a, []).append(b)
    place = {p: k for k, p in enumerate("nvars")}
    by_lemma = {lemma: sorted(part.itertuples(), key=lambda r: (place[r.pos], r.number)) for lemma, part in sense.groupby("lemma")}
    want = {m: set() for m in ("degree", "pagerank", "personal")}
    tokens = corpus_queries._tokens(spark, sf_dir).where("doc_id < 12").toPandas()
    for (doc, sent), part in tokens.groupby(["doc_id", "sent"]):
        words = []
        for t in part.sort_values("tok").itertuples():
            tag = {"N": "n", "V": "v", "J": "a", "R": "r"}.get(t.pos[0], "x")
            found = by_lemma.get(t.word.lower(), [])
            own = [r.id for r in found if r.pos == tag] or [r.id for r in found]
            if own:
                words.append((t.tok, own))
        for method, rows in want.items():
            rows |= {(doc, sent, tok, s) for tok, s in wsd.disambiguate_sentence(words, near, method).items()}
    for method, rows in want.items():
        got = procedure_queries.QUERIES[f"wsd_{method}"](spark, sf_dir).where("doc_id < 12").collect()
        assert {tuple(r) for r in got} == rows, method


def test_built_ontology_step_by_step(spark, sf_dir):
    order = ontology_queries.term_order(spark, sf_dir).orderBy("place").limit(60).collect()
    got = {r.term: r.parent for r in procedure_queries.ontology_built(spark, sf_dir).collect()}
    ids = {r.id for r in ontology_queries.lexicon(spark, sf_dir)["synset"].collect()}
    assert all(parent in ids or parent.startswith("new:") for parent in got.values()) and len(got) > 20
    assert all(got[r.term][4:] in got for r in order if got.get(r.term, "").startswith("new:"))


def test_model_scores_every_pair(spark, sf_dir):
    rows = procedure_queries.model_scores(spark, sf_dir).toPandas()
    assert rows.p.between(0, 1).all() and not rows.held_out.all()
    assert len(rows) == ontology_queries.snow_features(spark, sf_dir).count()
