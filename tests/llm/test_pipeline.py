
import corpus_pipeline
from glossweave.llm import decontaminate, lsh_forest, quality, queries
from tests.llm.test_lsh_forest import brute as near_brute
from tests.llm.test_lsm_dedup import LOWER


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for i, t in rows.items():
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), i))
    rows = {i: rows[i] for i in last.values()}
    _, root = near_brute(sorted(rows.items()))
    rows = {i: t for i, t in rows.items() if root[i] == i}
    items = [(r.item_id, decontaminate_words(r.text)) for r in bench.collect()]
    want = {i for i, t in rows.items() if not any(f" {q} " in f" {decontaminate_words(t)} " for _, q in items)}
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in got.collect()} == want
    assert got.columns == ["doc_id", "ids"]


def decontaminate_words(text):
    import re

    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def test_stages_on_odd_rows(spark, odd, clashing, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, sf_dir)
        assert got.columns == clashing.columns, name
        assert got.count() <= clashing.count(), name
        assert stage(spark, clashing.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == odd.count()


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert len(corpus_pipeline.STAGES) == 5
    assert lsh_forest.SHINGLE == decontaminate.SHINGLE == 5
