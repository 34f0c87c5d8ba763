from collections import defaultdict

import pytest

from glossweave.llm import lsm_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, pick):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest_bytes,memtable", [(32, 1 << 20), (1, 1 << 20), (32, 100)])
def test_against_brute_force(odd, keep, pick, digest_bytes, memtable):
    """Also with digests of one byte, which collide, and memtables of a row each."""
    rows = [tuple(r) for r in odd.collect()]
    got = lsm_dedup.exact_groups(odd.repartition(3), keep, digest_bytes, memtable).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == brute(rows, pick)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r[1] or "").translate(LOWER) for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_a_to_z_only(spark):
    docs = spark.createDataFrame([(1, "É a"), (2, "é a"), (3, "É A")], ["doc_id", "text"])
    assert {r.doc_id: r.keep_id for r in lsm_dedup.exact_groups(docs, "largest").collect()} == {1: 3, 2: 2, 3: 3}


def test_empty_table(none):
    assert lsm_dedup.exact_groups(none).count() == 0
    assert lsm_dedup.exact_dedup(none).columns == none.columns


def test_rows_keep_their_columns(clashing):
    got = lsm_dedup.exact_dedup(clashing, "largest")
    assert got.columns == clashing.columns
    ids = sorted([r.doc_id for r in got.collect()], key=str)
    assert ids == sorted([4, 5, 6, 7, 8, 9, 10, 11, 12], key=str)


def test_repeated_identifiers(spark):
    """One row for each text, whatever identifiers repeat."""
    rows = [(5, "a"), (5, "b"), (9, "b"), (6, "A x"), (6, "a x"), (6, "a x"), (None, "n"), (None, "N")]
    got = [tuple(r) for r in lsm_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted((i, t.translate(LOWER)) for i, t in got if i) == [(5, "a"), (6, "a x"), (9, "b")] and len(got) == 4


def test_filters_hold_what_they_were_made_of():
    digests = [lsm_dedup.digest_of(str(k).encode(), 32) for k in range(600)]
    for n in (1, 3, 200):
        flags = lsm_dedup.run_filter(digests[:n])
        assert all(lsm_dedup.may_hold(flags, d) for d in digests[:n])
        assert sum(lsm_dedup.may_hold(flags, d) for d in digests[n:]) < 40
    assert not lsm_dedup.may_hold(None, digests[0])


def test_a_text_in_every_run(spark):
    """A third of all rows share one text: its identifiers stay with their runs, one row an entry."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('own ', id)) AS text").repartition(6)
    runs = lsm_dedup.written(lsm_dedup.flush_runs(docs, True, 32, 4000), "runs")
    hits = lsm_dedup.compact(runs, True).where("run is not null")
    assert hits.count() == runs.select("run").distinct().count() > 30
    got = lsm_dedup.exact_groups(docs, "largest", memtable_bytes=4000)
    assert {tuple(r) for r in got.where("kept").groupBy("group_size").count().collect()} == {(1000, 1), (1, 2000)}
