import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import lsh_forest
from tests.llm.conftest import WORDS, prose


def words(text):
    return lsh_forest._WORD.findall((text or "").lower())


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_rows():
    rng = random.Random(5)
    rows, k = [], 0
    for base in range(12):
        text = prose(base, 120).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def brute(rows, threshold=0.8):
    sets = {i: plain_set(t) for i, t in rows}
    links = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return links, root


def test_against_brute_force(spark):
    rows = near_rows()
    links, root = brute(rows)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, ["doc_id", "text"])).collect()}
    assert len(got) == len(rows) and len(links) > 50
    assert {i: got[i].class_id for i in root} == root
    assert {i: got[i].n_links for i in root} == {i: sum(i in x for x in links) for i in root}


def test_small_blocks_and_large_graphs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 2)
    monkeypatch.setattr(lsh_forest, "FEW_EDGES", 0)
    rows = near_rows()
    links, root = brute(rows)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, ["doc_id", "text"])).collect()}
    assert {i: got[i].class_id for i in root} == root
    assert {i: got[i].n_links for i in root} == {i: sum(i in x for x in links) for i in root}


def test_all_pairs_on_demand(spark):
    rows = [(i, t) for i, t in near_rows()[:30]]
    links, _ = brute(rows)
    members, _, found = lsh_forest.similarity_join(spark.createDataFrame(rows, ["doc_id", "text"]), pairs=True)
    doc = {}
    for r in members.collect():
        doc.setdefault(bytes(r.key), []).append(r.doc_id)
    got = {tuple(sorted((x, y))) for r in found.collect() for x in doc[bytes(r.a)] for y in doc[bytes(r.b)]}
    same = {(x, y) for v in doc.values() for x, y in combinations(sorted(v), 2)}
    assert got | same == links


def test_odd_rows(odd, clashing):
    got = lsh_forest.near_duplicates(odd).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].n_links == by[4][0].n_links == by[5][0].n_links == 0 and by[3][0].class_id == 3
    assert {r.n_links for r in by[8]} == {3} and {r.class_id for r in by[8]} == {1}  # case doesn't tell texts apart
    assert by[9][0].class_id == by[None][0].class_id == 9
    kept = lsh_forest.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12]


def test_repeated_identifiers(spark):
    """Classes are told apart by texts: repeated identifiers neither save a near copy nor take a class away."""
    a, b, c = (prose(k, 60) for k in (21, 22, 23))
    rows = [(0, a), (1, b), (1, a + " w"), (5, c), (5, b + " w"), (6, c + " w"), (7, "x y"), (7, "x y"), (None, "z y")]
    want = [(0, a), (1, b), (5, c), (7, "x y"), (None, "z y")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        assert sorted((tuple(r) for r in lsh_forest.one_of_each(df).collect()), key=str) == sorted(want, key=str)


def test_rows_grow_with_a_group_and_not_with_its_pairs(spark, monkeypatch):
    """Links and counts that leave the tasks, for one group of 512, 1024 and 2048 near copies in blocks of 128."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 128)
    text = prose(31, 60).split()
    copies = [" ".join([*text, *(WORDS[(k >> s) % 2 + 2 * s] for s in range(11))]) for k in range(2048)]
    counts = []
    for n in (512, 1024, 2048):
        classes = [(f"{k:05d}".encode(), 1, lsh_forest.shingle_set(t).tobytes()) for k, t in enumerate(copies[:n])]
        sets = spark.createDataFrame(classes, "key binary, n_docs long, shingles binary")
        kept = {}
        plain = lsh_forest.written

        def seen(df, name):
            out = plain(df, name)
            kept[name] = out.count()
            return out

        monkeypatch.setattr(lsh_forest, "written", seen)
        found, _ = lsh_forest.verify(sets.select("key", F.lit(b"r").alias("root")), sets, 0.8)
        assert found.count() == n and found.select("root").distinct().count() == 1
        monkeypatch.setattr(lsh_forest, "written", plain)
        counts.append(kept["within"] + kept["across"])
    assert counts[1] <= 2.1 * counts[0] and counts[2] <= 2.1 * counts[1]


@pytest.mark.parametrize("few", [0, 500_000])
def test_rounds_of_components_shrink(spark, monkeypatch, few):
    """Roots as by hand, and tables of all rounds together no larger than a few times the links: a path, a star around its largest key, doubled and looped links."""
    monkeypatch.setattr(lsh_forest, "FEW_EDGES", few)
    rng = random.Random(8)
    keys = [rng.randbytes(16) for _ in range(300)]
    star = sorted(rng.randbytes(16) for _ in range(80))
    links = [*zip(keys, keys[1:]), *((x, star[-1]) for x in star[:-1]), (keys[1], keys[0]), (keys[0], keys[1]), (keys[5], keys[5])]
    plain, made = lsh_forest.written, []

    def seen(df, name):
        out = plain(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(lsh_forest, "written", seen)
    got = {bytes(r.key): bytes(r.root) for r in lsh_forest.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {**dict.fromkeys(keys, min(keys)), **dict.fromkeys(star, star[0])}
    assert sum(made) <= 6 * len(links)


def test_no_links_have_no_components(spark):
    got = lsh_forest.components(spark.createDataFrame([], "a binary, b binary"))
    assert got.columns == ["key", "root"] and got.count() == 0


def test_empty_table(none):
    assert lsh_forest.near_duplicates(none).count() == 0


def test_depth_meets_the_recall():
    depth = lsh_forest.prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** lsh_forest.TREES >= lsh_forest.TARGET_RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** lsh_forest.TREES
    assert lsh_forest.prefix_depth(0.05) == 1


def test_shared_counts():
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(n)] for n in (4, 5))
    got = lsh_forest._shared(x, y)
    assert [[len(np.intersect1d(a, b)) for b in y] for a in x] == got.tolist()


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("a b", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a a", 1)])
def test_shingles(text, n):
    assert len(lsh_forest.shingle_set(text)) == n
