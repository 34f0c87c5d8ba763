import random
from collections import defaultdict

import numpy as np
import pytest

from glossweave.llm import log_templates as lt

LOG = ["user 17 logged in from 10.0.0.1 today ok", "user 99 logged in from 10.9.9.9 today ok", "job alpha finished with state done after a while", "job alpha finished with state lost after a while", "job beta finished with state done after a while", "alone in the world"]


def brute(docs, min_docs=2):
    leaves, docs_of, where = defaultdict(dict), defaultdict(set), defaultdict(list)
    for row, (_, text) in enumerate(docs):
        for k, line in enumerate(text.split("\n") if text else []):
            t = lt.line_tokens(line)
            if len(t):
                h = lt.line_hash(t)
                leaves[lt.leaf_of(t)][h] = t
                docs_of[h].add(row)
                where[row].append((k, h))
    template = {}
    for leaf in leaves.values():
        grown = []
        for h in sorted(leaf):
            t, best = leaf[h], None
            for k, (pattern, _) in enumerate(grown):
                same = sum(a == b for a, b in zip(pattern, t))
                if same >= lt.SIMILAR * len(t) and (best is None or same > best[0]):
                    best = (same, k)
            if best:
                pattern, members = grown[best[1]]
                grown[best[1]] = ([a if a == b else 0 for a, b in zip(pattern, t)], [*members, h])
            else:
                grown.append((list(t), [h]))
        for _, members in grown:
            for h in members:
                template[h] = members[0]
    spread = defaultdict(set)
    for h, t in template.items():
        spread[t] |= docs_of[h]
    return [(docs[r][0], len(docs[r][1].split("\n")) if docs[r][1] else 0, sorted(k for k, h in where[r] if len(spread[template[h]]) >= min_docs)) for r in range(len(docs))]


def check(df, docs, min_docs=2):
    got = [(r.doc_id, r.n_lines, r.dropped) for r in lt.recurring_lines(df, min_docs).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, min_docs), key=str)


def test_variable_fields(spark):
    docs = [(1, "\n".join([LOG[0], LOG[5], LOG[2]])), (2, "\n".join([LOG[1], LOG[3]])), (3, LOG[4] + "\n\nown text here")]
    df = spark.createDataFrame(docs, ["doc_id", "text"])
    check(df, docs)
    got = {r.doc_id: r.dropped for r in lt.recurring_lines(df).collect()}
    assert got == {1: [0, 2], 2: [0, 1], 3: []}
    assert {r.doc_id: r.text for r in lt.drop_recurring(df).collect()}[1] == LOG[5]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_test_tables(spark, sf_dir, min_docs):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(df.repartition(5), [tuple(r) for r in df.collect()], min_docs)


@pytest.mark.parametrize("others", [10, 4100])
def test_template_of_two_lines_in_a_leaf_of_any_size(spark, others):
    rng = random.Random(others)
    filler = "\n".join("same first four words " + " ".join(f"{''.join(rng.choices('abcdefgh', k=8))}" for _ in range(7)) for _ in range(others))
    lines = [f"same first four words the user {name} has gone home again" for name in ("ann", "bob")]
    df = spark.createDataFrame([(0, filler), (1, lines[0]), (2, lines[1])], ["doc_id", "text"])
    assert {r.doc_id: r.n_dropped for r in lt.recurring_lines(df).collect()} == {0: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("width", [5, 6, 10, 17, 40])
def test_segments_find_what_a_scan_finds(monkeypatch, width):
    rng = np.random.default_rng(width)
    base = rng.integers(1, 9, (40, width))
    lines = base[rng.integers(0, 40, 1500)]
    lines = np.where(rng.random(lines.shape) < 0.12, rng.integers(0, 9, lines.shape), lines).astype("<u4")
    lines[:, :4] = 1
    monkeypatch.setattr(lt, "SCANNED", 10**9)
    scan = lt.grow_leaf(lines)
    monkeypatch.setattr(lt, "SCANNED", 0)
    assert (lt.grow_leaf(lines) == scan).all()


def test_odd_rows(odd, none, clashing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check(odd, docs)
    assert lt.recurring_lines(none).count() == 0
    assert lt.drop_recurring(clashing).columns == clashing.columns
    assert lt.drop_recurring(clashing).count() == clashing.count()


def test_repeated_identifiers_stay_rows_of_their_own(spark):
    rows = [(1, "same line here\nown one"), (1, "same line here\nown two"), (None, "same line here"), (None, None)]
    got = [tuple(r) for r in lt.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "own one"), (1, "own two"), (None, ""), (None, None)], key=str)
