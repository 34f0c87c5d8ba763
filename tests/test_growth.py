"""Steps that grow with their input and not with its square."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import depend, graph, iterative, learn, stats, wsd


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths_of_a_long_sentence(spark):
    """Once each token's row held its whole sentence: 400 million tokens here."""
    n = 20_000
    docs = spark.createDataFrame([(1, "s", " ".join(f"w{i % 7}" for i in range(n)))], ["doc_id", "source", "text"])
    got = depend.path_counts(depend.trees(docs), lambda x: F.lit(True), 3, by=("path",))
    assert rows_of(got) == [("nn:", 2 * n - 2), ("nn:nn:", 2 * n - 4), ("nn:nn:nn:", 2 * n - 6)]


def test_counts_are_those_of_the_paths(spark):
    """Any heads, circles too, against walks written out; first paths are the shortest, then the smallest."""
    deal = random.Random(5)
    tokens = [(d, s, None if d == 2 else f"s{d}", k, f"W{deal.randrange(4)}", deal.choice("NV"), deal.randrange(7), deal.choice(["x", "y"])) for d in range(3) for s in range(3) for k in range(6)]
    trees = depend.trees_of(spark.createDataFrame(tokens, "doc_id long, sent int, source string, tok int, word string, pos string, head int, rel string"))
    want, firsts = Counter(), Counter()
    for d in range(3):
        for s in range(3):
            own = [t for t in tokens if t[:2] == (d, s)]
            edges = [e for t in own if t[6] > 0 for e in ((t[3], t[6] - 1, t[7]), (t[6] - 1, t[3], t[7]))]
            first = {}
            walks = [([t[3]], "", "") for t in own if t[5] == "N"]
            for hops in (1, 2, 3):
                walks = [([*seen, b], path + r + ":", r) for seen, path, _ in walks for a, b, r in edges if a == seen[-1] and b not in seen]
                for seen, path, last in walks:
                    a, b = own[seen[0]], own[seen[-1]]
                    want[a[4].lower(), b[4].lower(), a[2], path, last] += 1
                    first[seen[0], seen[-1]] = min(first.get((seen[0], seen[-1]), (9, "")), (hops, path))
            for (a, b), (_, path) in first.items():
                firsts[own[a][4].lower(), own[b][4].lower(), path] += 1
    got = depend.path_counts(trees, lambda x: x["pos"] == "N", 3, by=("word_a", "word_b", "source", "path", "last_rel"))
    assert {tuple(r)[:5]: r.n for r in got.collect()} == want
    got = depend.path_counts(trees, lambda x: x["pos"] == "N", 3, by=("word_a", "word_b", "path"), first=True)
    assert {tuple(r)[:3]: r.n for r in got.collect()} == firsts


def test_terms_are_placed_by_ranges(spark):
    rows = spark.createDataFrame([(f"t{k:04}", k % 5, k % 3) for k in range(1000)], ["term", "in_ontology", "in_list"]).repartition(8)
    got = learn.placed(rows)
    want = sorted(rows.collect(), key=lambda r: (-r.in_ontology, -r.in_list, r.term))
    assert [(r.term, r.place) for r in got.orderBy("place").collect()] == [(r.term, k + 1) for k, r in enumerate(want)]
    assert "Window" not in got._jdf.queryExecution().toString() and learn.placed(rows.where("false")).count() == 0


def test_spans_of_a_long_sentence(spark):
    """Once the gaps were split again for each word."""
    said = "  ".join(f"é{k}" for k in range(20_000))
    got = spark.createDataFrame([(said,), (None,), ("",)], ["s"]).select(text.word_spans(F.col("s")).alias("p")).collect()
    assert [(x.start, x.end) for x in got[0].p] == [m.span() for m in re.finditer(r"\S+", said)] and got[1].p is None and got[2].p == []


def test_searches_at_one_place_move_once(spark):
    """3,000 searches at a node with 3,000 links: once nine million moves."""
    n = 3000
    starts = spark.createDataFrame([(k, "hub", "goal") for k in range(n)], ["search", "at", "goal"])
    edges = spark.createDataFrame([("hub", f"n{k}") for k in range(n)] + [("n7", "goal")], ["src", "dst"])
    near = spark.createDataFrame([("n7", "goal", 1)], ["a", "b", "n"])
    rows = []
    old = iterative.checkpointed
    try:
        iterative.checkpointed = lambda df: rows.append(old(df)) or rows[-1]
        got = iterative.greedy_search(starts, edges, near, 2).collect()
    finally:
        iterative.checkpointed = old
    assert {tuple(r)[1:] for r in got} == {("goal", 2, True)} and len(got) == n and max(df.count() for df in rows) <= n + 1


def test_common_ancestors_below_a_hub(spark):
    """Pairs stay one row each, whatever their ancestors; a root of all, two lines and a tie of two lowest ones."""
    rel = spark.createDataFrame([(f"x{k}", f"m{k % 3}") for k in range(30)] + [(f"x{k}", f"l{k % 2}") for k in range(30)] + [(m, "root") for m in ("m0", "m1", "m2", "l0", "l1")], ["src", "dst"])
    ids = rel.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    close = graph.closure(ids, rel, 4)
    pairs = spark.createDataFrame([(f"x{a}", f"x{b}") for a in range(30) for b in range(30)], ["x", "y"])
    got = {}
    for r in graph.lcs(pairs, close, graph.depths(close, rel)).collect():
        got.setdefault((r.x, r.y), set()).add((r.anc, r.depth, r.xmin, r.ymax))
    for a in range(30):
        for b in range(30):
            shared = {f"{s}{a % m}" for s, m in (("m", 3), ("l", 2)) if a % m == b % m}
            want = {(f"x{a}", 2, 0, 0)} if a == b else {(s, 1, 1, 1) for s in shared} or {("root", 0, 2, 2)}
            assert got[f"x{a}", f"x{b}"] == want


def test_windows_scored_in_workers(spark, monkeypatch):
    """The same senses as by joins, which remain for lexicons too large to hand out, and no shuffle of tokens."""
    deal = random.Random(3)
    sense = spark.createDataFrame([(f"w{k}", "n", f"s{k}{j}", j + 1) for k in range(6) for j in range(3)] + [("w1", "v", "v1", 1)], "lemma string, pos string, id string, number long")
    ids = [r.id for r in sense.collect()]
    scores = spark.createDataFrame([(a, b, deal.randrange(4)) for a in ids for b in ids], "x string, y string, score long")
    docs = spark.createDataFrame([(d, " ".join(deal.choice(["w0", "w1", "w2", "w3", "w4", "w5", "no"]) for _ in range(40))) for d in range(8)] + [(99, ""), (100, "w1")], ["doc_id", "text"])
    lemmas = [f"w{k}" for k in range(6)]
    monkeypatch.setattr(wsd, "SLICE", 16)
    got = wsd.window_lesk(docs, sense, scores, lemmas)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = rows_of(got)
    monkeypatch.setattr(wsd, "MOST_CELLS", 0)
    assert rows == rows_of(wsd.window_lesk(docs, sense, scores, lemmas)) and len(rows) > 200


def test_kept_walks_and_ranks_choose_the_same_senses():
    """Against searches and rank rounds for each sentence alone, on graphs with circles, lone senses and repeated candidates."""
    deal = random.Random(9)
    for _ in range(12):
        names = [f"s{k}" for k in range(14)]
        links = sorted({(deal.choice(names), deal.choice(names)) for _ in range(40)})
        net, plain = wsd.Net(links, kept=True), wsd.Net(links)
        for _ in range(12):
            words = [(3 * k, deal.sample([*names, "lone"], deal.randrange(1, 4))) for k in range(deal.randrange(1, 6))]
            for method in ("degree", "pagerank", "personal"):
                want = wsd.disambiguate_sentence(words, plain, method)
                assert wsd.disambiguate_sentence(words, net, method) == want == wsd.disambiguate_sentence(words, net, method)
        assert net.walks and net.pulses and net.done


def test_counts_of_repeated_and_long_documents(spark):
    """Windows, compounds and terms counted in the workers, against plain loops; identifiers may be repeated."""
    deal = random.Random(4)
    said = [" ".join(deal.choice(["A", "b", "c", "x"]) for _ in range(n)) for n in (0, 1, 7, 300, 2000)] + [None]
    docs = spark.createDataFrame([(k % 4, x) for k, x in enumerate(said)], "doc_id long, text string")
    tokens = [(x or "").lower().split() for x in said]
    want, totals = Counter(), Counter()
    for t in tokens:
        for i, a in enumerate(t):
            totals.update({a: min(i, 5) + min(len(t) - 1 - i, 5)} if a in "abc" else {})
            want.update((a, t[j], j - i) for j in range(max(0, i - 5), min(len(t), i + 6)) if j != i and a in "abc" and t[j] in "abc")
    assert {(r.word, r.other, r.distance): r.n for r in stats.window_counts(docs, ["a", "b", "c"], 5).collect()} == want
    assert {r.word: r.n for r in stats.window_totals(docs, ["a", "b", "c"], 5).collect()} == {w: n for w, n in totals.items() if n}
    want = Counter((k % 4, w) for k, x in enumerate(said) for w in (x or "").split())
    assert {(r.doc_id, r.word): r.n for r in stats.term_document(docs).collect()} == want
    once = stats.term_document(docs.where("doc_id > 1"))
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == len([k for k in want if k[0] > 1])
