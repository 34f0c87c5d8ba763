"""Step-by-step procedures: searches, spreading labels, building, models, parses and graph disambiguation."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import annotate, depend, iterative, learn, wsd
from glossweave.operators import ontology as onto
from glossweave.plans.corpus_queries import TOK, _docs
from glossweave.plans.ontology_queries import _TAX, evidence, lex_links, lexicon, snow_features, tax, taxonomy, term_order
from glossweave.plans.scratch import checkpointed
from glossweave.sources.corpus import table


def greedy_search(spark, sf):
    """From every supplier to the first region, over hypernym links in both directions."""
    rel, close, _ = tax(spark, sf)
    links = onto.with_inverse(rel.select("src", F.lit("@").alias("rel"), "dst")).select("src", "dst")
    near = close.select(F.col("id").alias("a"), F.col("anc").alias("b"), F.col("dmin").alias("n"))
    starts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("search"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("at"), F.lit("r0").alias("goal"))
    return iterative.greedy_search(starts, links, near, 4)


def label_spreading(spark, sf):
    return iterative.spread_labels(taxonomy(spark, sf).where("dst <> 'entity'").withColumn("weight", F.lit(1.0)), 5)


def ontology_built(spark, sf):
    """Nouns outside the lexicon attached to it one after the other."""
    lex = lexicon(spark, sf)
    first = lex["sense"].where("pos = 'n' and number = 1").select("lemma", "id")
    by_term = evidence(spark, sf).join(first, "id").groupBy("term", "id").agg(F.min("lemma").alias("parent"), F.max("q").alias("q"))
    return iterative.build(term_order(spark, sf).select("term", "place"), by_term.select("term", "parent", "q"), lex["relation"], first)


FEATURES = ["hso", "lch", "wup", "path", "mn", "maxmn", "sensecount"]


def model_scores(spark, sf):
    """Pairs of senses of one lemma: the chance that a coarser lexicon joins them, learned from their distances.

    The label (class) is no feature; pairs whose first synset's crc32 modulo 4 is 0 are held out.
    """
    rows = checkpointed(snow_features(spark, sf).withColumn("held_out", F.crc32(F.col("x").cast("binary")) % 4 == 0))
    columns = [f"f_{c}" for c in FEATURES]
    rows = rows.select("*", *[F.col(c).cast("double").alias(f"f_{c}") for c in FEATURES])
    model = learn.train(rows.where("not held_out"), "class", columns)
    return learn.classify(model, rows, columns).select("x", "y", "held_out", F.col("class"), F.round("p", 6).alias("p"))


def graph_wsd(method):
    def query(spark, sf):
        lex = lexicon(spark, sf)
        return wsd.graph_senses(depend.trees(_docs(spark, sf)), lex["sense"], lex_links(lex), method, lex["synset"])

    return query


QUERIES = {
    "greedy_search": greedy_search,
    "label_spreading": label_spreading,
    "ontology_built": ontology_built,
    "model_scores": model_scores,
    "random_doc_pairs": lambda s, d: iterative.sample_pairs(_docs(s, d).select(F.col("doc_id").alias("id")), 100),
    "parse": lambda s, d: annotate.parsed(annotate.annotated(_docs(s, d))),
    **{f"wsd_{m}": graph_wsd(m) for m in ("degree", "pagerank", "personal")},
}


def _search_step(k: int) -> str:
    """The neighbour of least distance to the goal of each search that goes on, and where all searches are then."""
    return f"""m{k} AS (SELECT DISTINCT ON (search) search, next, gap FROM (SELECT w.search, l.dst AS next, CASE WHEN l.dst = 'r0' THEN 0 ELSE coalesce(c.dmin, 1073741824) END AS gap
        FROM w{k - 1} w JOIN way l ON l.src = w."at" LEFT JOIN clos c ON c.id = l.dst AND c.anc = 'r0' WHERE NOT w.found) ORDER BY search, gap, next),
      w{k} AS (SELECT w.search, coalesce(m.next, w."at") AS "at", w.steps + (m.next IS NOT NULL)::INT AS steps, w.found OR coalesce(m.gap = 0, false) AS found FROM w{k - 1} w LEFT JOIN m{k} m USING (search))"""


def _spread(k: int) -> str:
    return f"lb{k} AS (SELECT id, label FROM (SELECT e.src AS id, l.label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, l.label) AS r FROM ways e JOIN lb{k - 1} l ON l.id = e.dst GROUP BY e.src, l.label) WHERE r = 1)"


#: Disambiguation in graphs, the builder and the model have no SQL form; tests hold them against plain versions.
ORACLES = {
    "greedy_search": f"""WITH RECURSIVE {_TAX}, way AS (SELECT src, dst FROM rel UNION SELECT dst, src FROM rel),
      w0 AS (SELECT s_suppkey AS search, 's' || s_suppkey AS "at", 0 AS steps, false AS found FROM supplier), {", ".join(map(_search_step, range(1, 5)))} SELECT search, "at", steps, found FROM w4""",
    "label_spreading": f"""WITH RECURSIVE {_TAX}, lower_links AS (SELECT src, dst FROM rel WHERE dst <> 'entity'), ways AS (SELECT src, dst FROM lower_links UNION ALL SELECT dst, src FROM lower_links),
      lb0 AS (SELECT DISTINCT src AS id, src AS label FROM ways), {", ".join(map(_spread, range(1, 6)))} SELECT id, label FROM lb5""",
    "random_doc_pairs": """WITH ids AS (SELECT DISTINCT doc_id AS id FROM documents), a AS (SELECT id AS a, row_number() OVER (ORDER BY h, id) AS k FROM (SELECT id, md5(concat_ws(' ', id, '7', '1')) AS h FROM ids ORDER BY h, id LIMIT 100)),
      b AS (SELECT id AS b, row_number() OVER (ORDER BY h, id) AS k FROM (SELECT id, md5(concat_ws(' ', id, '7', '2')) AS h FROM ids ORDER BY h, id LIMIT 100)) SELECT a, b FROM a JOIN b USING (k) WHERE a <> b""",
    "parse": f"WITH {TOK}, n AS (SELECT doc_id, sent FROM toks GROUP BY ALL HAVING count(*) <= 100) SELECT doc_id, sent, tok, word, pos, tok AS head, lower(pos) AS rel FROM toks JOIN n USING (doc_id, sent)",
}
