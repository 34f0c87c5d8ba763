"""Word sense disambiguation of token rows against a lexicon."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import _WORD, low_words, rule_pos
from glossweave.operators.ontology import tag_pos
from glossweave.plans.scratch import checkpointed


def candidates(senses: DataFrame) -> DataFrame:
    """lemma, tag, id, rank: the senses a word with a tag may have, in order: those of the tag's part of speech, else those of all.

    The tag of words without a part of speech is ``x``.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in ["n", "v", "a", "r", "s"]]), F.col("pos"))
    rows = senses.select("lemma", "pos", "id", "number", place.alias("place"), F.explode(F.array(*[F.lit(t) for t in ("n", "v", "a", "r", "x")])).alias("tag"))
    own = F.max(F.col("pos") == F.col("tag")).over(Window.partitionBy("lemma", "tag"))
    rows = rows.withColumn("own", own).where(~F.col("own") | (F.col("pos") == F.col("tag")))
    turn = F.row_number().over(Window.partitionBy("lemma", "tag").orderBy("place", "number"))
    return rows.select("lemma", "tag", "id", turn.alias("rank"))


def tagged(token_rows: DataFrame) -> DataFrame:
    return token_rows.select("doc_id", F.col("gpos").cast("long").alias("gpos"), F.lower("word").alias("lemma"), F.coalesce(tag_pos(F.col("pos")), F.lit("x")).alias("tag"))


def most_frequent(token_rows: DataFrame, senses: DataFrame) -> DataFrame:
    """doc_id, gpos, id of every token that the lexicon knows: its first sense."""
    return tagged(token_rows).join(candidates(senses).where("rank = 1"), ["lemma", "tag"]).select("doc_id", "gpos", "id")


def known_tokens(documents: DataFrame, lemmas: list[str]) -> DataFrame:
    """doc_id, t: a document's tokens that the lexicon knows, as (gpos, lemma, tag), in one array."""
    near = F.filter(F.transform(low_words(F.col("text")), lambda w, i: F.struct(i.cast("long").alias("gpos"), w.alias("lemma"))), lambda t: t["lemma"].isin(lemmas))
    return documents.select("doc_id", F.transform(near, lambda t: F.struct(t["gpos"].alias("gpos"), t["lemma"].alias("lemma"), F.coalesce(tag_pos(rule_pos(t["lemma"])), F.lit("x")).alias("tag"))).alias("t"))


def window_lesk(documents: DataFrame, senses: DataFrame, scores: DataFrame, lemmas: list[str], width: int = 5) -> DataFrame:
    """doc_id, gpos, id: of each known token the sense whose scores with the senses of the tokens around it sum highest, ties to the first.

    ``scores`` (x, y, score) compares senses.  Scores are first summed by word: a focus sense against all
    senses of a context word, so each pair of neighbouring tokens joins once.
    """
    cand = candidates(senses).where(F.col("tag") == F.coalesce(tag_pos(rule_pos(F.col("lemma"))), F.lit("x")))  # as known_tokens() tags them
    focus = cand.select(F.col("lemma").alias("f"), F.col("tag").alias("ft"), F.col("id").alias("x"), "rank")
    context = cand.select(F.col("lemma").alias("c"), F.col("tag").alias("ct"), F.col("id").alias("y"))
    summed = focus.join(scores.where("score <> 0"), "x").join(context, "y").groupBy("f", "ft", "x", "c", "ct").agg(F.sum("score").alias("score"))
    summed = checkpointed(summed)
    senses_of = {k: [x for _, x in sorted(v)] for k, v in _grouped(focus.collect())}  # as large as ``lemmas``
    if len(senses_of) * sum(map(len, senses_of.values())) <= MOST_CELLS:
        return _window_scores(known_tokens(documents, lemmas), senses_of, summed, width)
    rows = known_tokens(documents, lemmas).select("doc_id", F.posexplode("t").alias("i", "w"), "t")
    left = F.greatest(F.col("i") - width, F.lit(0))
    around = F.filter(F.slice("t", left + 1, F.lit(2 * width + 1)), lambda c: (F.abs(c["gpos"] - F.col("w.gpos")) <= width) & (c["gpos"] != F.col("w.gpos")))
    pairs = rows.select("doc_id", F.col("w.gpos").alias("gpos"), F.col("w.lemma").alias("f"), F.col("w.tag").alias("ft"), F.explode(around).alias("o"))
    pairs = pairs.select("doc_id", "gpos", "f", "ft", F.col("o.lemma").alias("c"), F.col("o.tag").alias("ct"))
    got = pairs.join(summed, ["f", "ft", "c", "ct"]).groupBy("doc_id", "gpos", "x").agg(F.sum("score").alias("score"))
    tokens = rows.select("doc_id", F.col("w.gpos").alias("gpos"), F.col("w.lemma").alias("f"), F.col("w.tag").alias("ft")).join(focus, ["f", "ft"])
    scored = tokens.join(got, ["doc_id", "gpos", "x"], "left")
    best = F.max(F.struct(F.coalesce("score", F.lit(0).cast("long")).alias("score"), (-F.col("rank")).alias("order"), F.col("x"))).alias("b")
    return scored.groupBy("doc_id", "gpos").agg(best).select("doc_id", "gpos", F.col("b.x").alias("id"))


#: Cells of a table of scores, senses by context words, that goes to every worker at most (eight bytes each).
MOST_CELLS = 1 << 24
#: Known tokens that are scored at once.
SLICE = 1 << 16


def _grouped(rows: list) -> list[tuple[tuple[str, str], list[tuple[int, str]]]]:
    out: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for r in rows:
        out.setdefault((r.f, r.ft), []).append((r.rank, r.x))
    return sorted(out.items())


def _window_scores(known: DataFrame, senses_of: dict[tuple[str, str], list[str]], summed: DataFrame, width: int) -> DataFrame:
    """window_lesk() of known_tokens() in the workers: the neighbours of all tokens of a slice at a distance are looked up together, so nothing is shuffled."""
    place = {k: i for i, k in enumerate(senses_of)}
    first = np.cumsum([0, *map(len, senses_of.values())])
    spot = {(k, x): int(first[i]) + j for k, i in place.items() for j, x in enumerate(senses_of[k])}
    table = np.zeros((int(first[-1]), len(place)), np.int64)
    columns = summed.select("f", "ft", "x", "c", "ct", "score").toArrow()  # of MOST_CELLS at most
    for f, ft, x, c, ct, score in zip(*(col.to_pylist() for col in columns.columns)):
        table[spot[(f, ft), x], place[c, ct]] = score
    shared = known.sparkSession.sparkContext.broadcast((place, first, pa.array([x for v in senses_of.values() for x in v], pa.string()), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, ids, table = shared.value
        most = int(np.diff(first).max(initial=0))
        for batch in batches:
            sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)
            flat = batch.column("t").flatten()
            gpos = flat.field("gpos").to_numpy(zero_copy_only=False)
            own = np.array([place.get(k, -1) for k in zip(flat.field("lemma").to_pylist(), flat.field("tag").to_pylist())], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            for low in range(0, len(own), SLICE):
                high = min(low + SLICE, len(own))
                at = np.arange(low, high)
                begin = first[own[low:high]]
                many = np.where(own[low:high] >= 0, first[own[low:high] + 1] - begin, 0)
                score = np.zeros((most, high - low), np.int64)
                for step in (*range(-width, 0), *range(1, width + 1)):
                    to = np.clip(at + step, 0, len(own) - 1)
                    near = (to == at + step) & (row[to] == row[at]) & (np.abs(gpos[to] - gpos[at]) <= width) & (gpos[to] != gpos[at]) & (own[to] >= 0)
                    for k in range(most):
                        here = np.flatnonzero(near & (many > k))
                        score[k, here] += table[begin[here] + k, own[to[here]]]
                score[np.arange(most)[:, None] >= many] = np.iinfo(np.int64).min
                has = np.flatnonzero(many > 0)
                if len(has):
                    got = begin[has] + np.argmax(score[:, has], axis=0)  # the first of equal ones
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[low + has])), pa.array(gpos[low + has]), ids.take(pa.array(got))], ["doc_id", "gpos", "id"])

    return known.mapInArrow(run, "doc_id long, gpos long, id string")


#: Walks, or numbers of rank vectors, that a worker keeps at most (some 12 bytes each), and sentences.
MOST_WALKS, MOST_SENTENCES = 12_000_000, 100_000


class Net:
    """An ontology's directed links as arrays: built once, used for every sentence.

    With ``kept``, what sentences ask for again is kept: walks from senses, ranks that a sense passes on, and sentences of the
    same candidates; each within a bound.
    """

    def __init__(self, links: list[tuple[str, str]], kept: bool = False):
        self.kept = kept
        self.walks: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None] = {}
        self.room, self.pulses, self.done = MOST_WALKS, {}, {}
        self.names = list(dict.fromkeys(x for link in links for x in link))
        self.ids = {s: k for k, s in enumerate(self.names)}
        self.src, self.dst = (np.array([self.ids[link[k]] for link in links], dtype=np.int64) for k in (0, 1))
        self.near: dict[str, list[str]] = {}
        self.back: dict[str, list[str]] = {}
        for a, b in dict.fromkeys(links):
            self.near.setdefault(a, []).append(b)
            self.back.setdefault(b, []).append(a)
        self.links = list(dict.fromkeys(links))
        self.link_src, self.link_dst = (np.array([self.ids[link[k]] for link in self.links], dtype=np.int32) for k in (0, 1))
        self.order = np.argsort(self.link_src, kind="stable").astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.link_src, minlength=len(self.names)))])

    def walks_from(self, start: str, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """Level by level the ends, the walks they go on from and the last links of all simple walks from a node; None if they are too many to keep."""
        if (start, depth) in self.walks:
            return self.walks[start, depth]
        seen = [np.array([self.ids[start]], np.int32)] if start in self.ids else [np.zeros(0, np.int32)]
        levels, size = [], 0
        for _ in range(depth):
            low = self.begin[seen[-1]]
            many = self.begin[seen[-1] + 1] - low
            size += int(many.sum())
            if size > MOST_WALKS // 8:
                levels = None
                break
            back = np.repeat(np.arange(len(many), dtype=np.int32), many)
            link = self.order[np.arange(len(back)) + np.repeat(low - np.cumsum(many) + many, many)]
            new = np.ones(len(back), bool)
            for nodes in seen:
                new &= nodes[back] != self.link_dst[link]
            back, link = back[new], link[new]
            seen = [*(nodes[back] for nodes in seen), self.link_dst[link]]
            levels.append((self.link_dst[link], back, link))
        if size > self.room:
            self.walks, self.room = {}, MOST_WALKS
        self.walks[start, depth] = levels
        self.room -= size if levels else 0
        return levels

    def pulse(self, sense: str) -> np.ndarray | None:
        """What rank a mass of 1 at a sense leaves everywhere after 29 rounds; None if such vectors are too many to keep."""
        if len(self.names) ** 2 > MOST_WALKS:
            return None
        if sense not in self.pulses:
            mass = np.zeros(len(self.names))
            mass[self.ids[sense]] = 1
            degree = np.bincount(self.src, minlength=len(mass))
            for _ in range(29):
                mass = np.bincount(self.link_dst, weights=0.85 * mass[self.link_src] / degree[self.link_src], minlength=len(mass))
            self.pulses[sense] = mass
        return self.pulses[sense]


def rank_vector(src: np.ndarray, dst: np.ndarray, source: np.ndarray, weight: float, rounds: int = 30) -> np.ndarray:
    """Ranks after ``rounds`` rounds: links pass rank over the count of all links of their start to distinct ends; nodes that got some get their share of the source."""
    n = len(source)
    degree = np.bincount(src, minlength=n)
    a, b = np.unique(np.stack([src, dst]), axis=1) if len(src) else (src, dst)
    rank = source.copy()
    for _ in range(rounds):
        new = np.bincount(b, weights=weight * rank[a] / degree[a], minlength=n)
        rank = np.where(new != 0, new + (1 - weight) * source, 0.0)
    return rank


def search_paths(start: str, goals: set[str], net: Net, far: dict[str, int], depth: int) -> list[list[str]]:
    """Simple paths of at most ``depth`` links from a start to a goal, by depth-first search that stops at goals.

    ``far`` tells how many links a node is from its nearest goal; walks that can't end in time are not followed.
    """
    found, stack = [], [[start]]
    while stack:
        walk = stack.pop()
        for nxt in net.near.get(walk[-1], []):
            if nxt in walk:
                continue
            if nxt in goals:
                found.append([*walk, nxt])
            elif len(walk) + far.get(nxt, depth) <= depth:
                stack.append([*walk, nxt])
    return found


def goal_distances(goals: set[str], net: Net, depth: int) -> dict[str, int]:
    far, level = dict.fromkeys(goals, 0), goals
    for d in range(1, depth + 1):
        level = {x for s in level for x in net.back.get(s, []) if x not in far}
        far.update(dict.fromkeys(level, d))
    return far


def connected_senses(words: list[tuple[int, list[str]]], net: Net, depth: int = 5) -> set[tuple[str, str]]:
    """Directed links of the subgraph on paths between the candidate senses of different words."""
    owner = {s: i for i, senses in words for s in senses}
    links: set[tuple[str, str]] = set()
    marked = np.zeros(len(net.links), bool)
    for i, senses in words:
        goals = {g for g, j in owner.items() if j != i}
        goal = np.zeros(len(net.names), bool)
        goal[[net.ids[g] for g in goals if g in net.ids]] = True
        far = None
        for s in senses:
            levels = net.walks_from(s, depth) if net.kept else None
            if levels is not None:
                _mark(levels, goal, marked)
                continue
            far = goal_distances(goals, net, depth) if far is None else far
            for walk in search_paths(s, goals, net, far, depth):
                links.update(zip(walk, walk[1:]))
    links.update(net.links[k] for k in np.flatnonzero(marked))
    return links


def _mark(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], goal: np.ndarray, marked: np.ndarray) -> None:
    """Mark the links of those walks that end at their first goal."""
    alive, hits = np.ones(1, bool), []
    for k, (end, back, _) in enumerate(levels):
        at = np.flatnonzero(goal[end])
        hits.append(at[alive[back[at]]])
        if k + 1 < len(levels):
            alive = alive[back] & ~goal[end]
    on = np.zeros(0, np.int64)
    for (_, back, link), hit in zip(reversed(levels), reversed(hits)):
        on = np.union1d(on, hit)
        marked[link[on]] = True
        on = back[on]


def disambiguate_sentence(words: list[tuple[int, list[str]]], near: Net | dict[str, list[str]], method: str) -> dict[int, str]:
    """Sense of each word (position, candidates) of a sentence; equal scores go to the later candidate.

    ``degree``: links in and out within the connecting subgraph; ``pagerank``: rank in that subgraph without
    directions; ``personal``: rank over the whole graph with the mass on the sentence's words.
    """
    net = near if isinstance(near, Net) else Net([(a, b) for a, v in near.items() for b in v])
    if net.kept:
        key = (method, tuple(tuple(senses) for _, senses in words))
        if key not in net.done:
            if len(net.done) >= MOST_SENTENCES:
                net.done.clear()
            net.done[key] = list(_picked(words, net, method).items())
        return {words[k][0]: s for k, s in net.done[key]}
    return {words[k][0]: s for k, s in _picked(words, net, method).items()}


def _picked(words: list[tuple[int, list[str]]], net: Net, method: str) -> dict[int, str]:
    """disambiguate_sentence() by the words' places in the list."""
    words = [(k, senses) for k, (_, senses) in enumerate(words)]
    if method == "personal" and net.kept and (not net.names or net.pulse(net.names[0]) is not None):
        # links of the words' own nodes pass their mass on once; all else is the sum of what their senses pass on
        score = {s: 0.0 for _, senses in words for s in senses}
        total = np.zeros(len(net.names))
        for _, senses in words:
            for s in dict.fromkeys(senses):
                if s in net.ids:
                    total += 0.85 / (len(words) * len(senses)) * net.pulse(s)
        score.update({s: total[net.ids[s]] for s in score if s in net.ids})
    elif method == "personal":
        lone = list(dict.fromkeys(s for _, senses in words for s in senses if s not in net.ids))
        ids = {**{s: net.ids[s] for _, senses in words for s in senses if s in net.ids}, **{s: len(net.names) + k for k, s in enumerate(lone)}}
        first = len(net.names) + len(lone)
        more = [(first + k, ids[s]) for k, (_, senses) in enumerate(words) for s in senses]
        src, dst = (np.concatenate([x, np.array([link[k] for link in more], dtype=np.int64)]) for k, x in enumerate((net.src, net.dst)))
        source = np.zeros(first + len(words))
        source[first:] = 1 / max(1, len(words))
        rank = rank_vector(src, dst, source, 0.85)
        score = {s: rank[k] for s, k in ids.items()}
    else:
        graph = connected_senses(words, net)
        nodes = sorted({x for e in graph for x in e} | {x for _, v in words for x in v})
        ids = {s: k for k, s in enumerate(nodes)}
        if method == "degree":
            score = dict.fromkeys(nodes, 0.0)
            for a, b in graph:
                score[a] += 1
                score[b] += 1
        else:
            links = sorted({(ids[a], ids[b]) for a, b in graph} | {(ids[b], ids[a]) for a, b in graph})
            src, dst = (np.array([x[k] for x in links], dtype=np.int64) for k in (0, 1))
            rank = rank_vector(src, dst, np.full(len(nodes), 1 / max(1, len(nodes))), 0.15)
            score = {s: rank[k] for s, k in ids.items()}
    out = {}
    for i, senses in words:
        best = None
        for s in senses:
            # ranks that differ by rounding alone are equal
            if best is None or score.get(s, 0.0) >= score.get(best, 0.0) * (1 - 1e-9):
                best = s
        if best is not None:
            out[i] = best
    return out


def nearest_senses(documents: DataFrame, vectors: DataFrame, senses: DataFrame) -> DataFrame:
    """doc_id, tag, only, found (cosine, id) of documents with words, their first one being the tag.

    ``only`` is the synset of a tag that has one.  Of other tags ``found`` has the synsets nearest to the document's words, and those
    within 2e-9 of it, among the tag's or, if it has none, among all of ``vectors`` (id, dim, value), which go to every worker.
    """
    rows = vectors.collect()
    ids = sorted({r.id for r in rows})
    place = {x: k for k, x in enumerate(ids)}
    by_dim: dict[str, list[tuple[int, float]]] = {}
    size = np.zeros(len(ids))
    for r in rows:
        by_dim.setdefault(r.dim, []).append((place[r.id], r.value))
        size[place[r.id]] += r.value * r.value
    dims = {d: (np.array([k for k, _ in v], np.int64), np.array([x for _, x in v])) for d, v in by_dim.items()}
    known: dict[str, list[str]] = {}
    for r in senses.select("lemma", "id").distinct().collect():
        known.setdefault(r.lemma, []).append(r.id)
    shared = documents.sparkSession.sparkContext.broadcast((ids, place, np.sqrt(size), dims, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, size, dims, known = shared.value
        for batch in batches:
            row, tags, only, found = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = [w.lower() for w in _WORD.findall(text or "")]
                if not words:
                    continue
                own, near = known.get(words[0]), []
                if own is None or len(own) > 1:
                    n = Counter(words)
                    met = [(*dims[w], c) for w, c in n.items() if w in dims]
                    if met:
                        dot = np.bincount(np.concatenate([at for at, _, _ in met]), weights=np.concatenate([x * c for _, x, c in met]), minlength=len(ids))
                        if own is not None:
                            mine = np.zeros(len(ids), bool)
                            mine[[place[x] for x in own if x in place]] = True
                            dot[~mine] = 0
                        at = np.flatnonzero(dot > 0)
                        cosine = dot[at] / (np.sqrt(float(sum(c * c for c in n.values()))) * size[at])
                        near = [{"cosine": float(cosine[j]), "id": ids[at[j]]} for j in np.flatnonzero(cosine >= cosine.max(initial=0) - 2e-9)]
                row.append(k)
                tags.append(words[0])
                only.append(own[0] if own is not None and len(own) == 1 else None)
                found.append(near)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(tags, pa.string()), pa.array(only, pa.string()), pa.array(found, pa.list_(pa.struct([("cosine", pa.float64()), ("id", pa.string())])))], ["doc_id", "tag", "only", "found"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tag string, only string, found array<struct<cosine:double,id:string>>")


def gloss_links(synset: DataFrame, senses: DataFrame) -> DataFrame:
    """src, dst: from each synset (id, definition) to the senses of those of its definition's words that have one sense only."""
    single = senses.groupBy("lemma").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1")
    words = synset.select(F.col("id").alias("src"), F.explode(F.split(F.lower("definition"), r"\s+")).alias("lemma"))
    return words.join(single, "lemma").where("src <> dst").select("src", "dst").distinct()


#: Links of an ontology that go to every worker at most (some 100 bytes each).
MOST_LINKS = 5_000_000


def graph_senses(rows: DataFrame, senses: DataFrame, relation: DataFrame, method: str, synset: DataFrame | None = None) -> DataFrame:
    """doc_id, sent, tok, id by a graph method, sentence by sentence; the ontology's links and senses go to every worker once.

    ``rows`` are sentences (doc_id, sent, t), whose tokens are not shuffled, or tokens (doc_id, sent, tok, word, pos), which are gathered.

    With ``synset`` (id, definition) the graph also has gloss_links().  The links are counted first: an ontology of more than
    MOST_LINKS is refused, since each worker needs the graph whole.
    """
    links = relation.select("src", "dst")
    if synset is not None:
        links = links.unionByName(gloss_links(synset, senses))
    links = checkpointed(links)
    if links.count() > MOST_LINKS:
        raise ValueError(f"the graph has more than {MOST_LINKS} links")
    found: dict[tuple[str, str], list[str]] = {}
    for r in candidates(senses).orderBy("lemma", "tag", "rank").collect():
        found.setdefault((r.lemma, r.tag), []).append(r.id)
    lemmas = sorted({lemma for lemma, _ in found})
    shared = relation.sparkSession.sparkContext.broadcast((sorted((r.src, r.dst) for r in links.collect()), found))

    def token(tok: Column, word: Column, pos: Column) -> Column:
        return F.struct(tok.cast("long").alias("tok"), F.lower(word).alias("lemma"), F.coalesce(tag_pos(pos), F.lit("x")).alias("tag"))

    if "t" in rows.columns:
        known = F.filter(F.transform("t", lambda x, i: token(i, x["word"], x["pos"])), lambda x: x["lemma"].isin(lemmas))
        rows = rows.select("doc_id", F.col("sent").cast("long").alias("sent"), known.alias("c")).where(F.size("c") > 0)
    else:
        rows = rows.where(F.lower("word").isin(lemmas)).groupBy("doc_id", F.col("sent").cast("long").alias("sent")).agg(F.sort_array(F.collect_list(token(F.col("tok"), F.col("word"), F.col("pos")))).alias("c"))  # a sentence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, found = shared.value
        net = Net(pairs, kept=True)
        for batch in batches:
            row, tok, ids = [], [], []
            for k, c in enumerate(batch.column("c").to_pylist()):
                for t, s in disambiguate_sentence([(x["tok"], found[x["lemma"], x["tag"]]) for x in c if (x["lemma"], x["tag"]) in found], net, method).items():
                    row.append(k)
                    tok.append(t)
                    ids.append(s)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("sent").take(at), pa.array(tok, pa.int64()), pa.array(ids, pa.string())], ["doc_id", "sent", "tok", "id"])

    return rows.mapInArrow(run, "doc_id long, sent long, tok long, id string")


def all_words_lines(token_rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, line: ``id sense`` of every token, ``U`` where there is none; runs of one identifier make one line."""
    rows = token_rows.select("doc_id", F.col("gpos").cast("long").alias("gpos")).join(found, ["doc_id", "gpos"], "left")
    rows = rows.select("doc_id", "gpos", F.coalesce("id", F.lit("U")).alias("id"))
    order = Window.partitionBy("doc_id").orderBy("gpos")
    first = rows.withColumn("before", F.lag("id").over(order)).where("before is null or before <> id")
    return first.select("doc_id", F.concat_ws(" ", F.concat_ws(".", "doc_id", "gpos"), "id").alias("line"))
