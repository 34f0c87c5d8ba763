"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Documents with the same set of five-word shingles form a class.  A class's label in each of TREES prefix
tries is a string of DEPTH MinHash values.  The tries' matched prefixes are shortened from the whole label until
pairs at the threshold meet in some trie with the target recall.  Classes that trie nodes join form a group; a group's
classes are dealt to blocks; blocks are verified within on their shingle sets by matrix products, then a block meets all other
blocks of its group in one task.  Only a class's count of links and links between trees of linked classes leave a task, so no row
is made for a pair.
"""

from __future__ import annotations

import re
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import claim, digest_filter, numbered, passes, remember, written

SHINGLE = 5
TREES, DEPTH = 20, 8
TARGET_RECALL = 0.999
#: Classes and bytes of shingles of a group that a block holds at most on average.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Classes on a side of the products that verify a block.
TILE = 256
REMEMBERED = 150_000
#: Edges up to which the keys and roots of a graph (32 bytes each) are broadcast.
FEW_EDGES = 500_000
#: Bits of the filter of candidate classes for each class and at most; beyond its capacity more texts are shipped than needed.
CLASS_BITS, FILTER_BITS = 16, 1 << 26

_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = remember("lsh_forest", _Words())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text; a text of fewer words is one shingle, one of none has none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([_words[w] for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, dtype=np.uint64)
        for k in range(min(SHINGLE, len(h))):
            out = _mixed(out * _GOLD + h[k : k + n])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = TREES * DEPTH
    return rng.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 32, n, dtype=np.uint64)


_A, _B = _permutations()


def label(shingles: np.ndarray) -> bytes:
    """TREES labels one after the other: DEPTH MinHash values of two bytes each."""
    x = shingles >> np.uint64(32)
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            least = np.minimum(least, ((x[i : i + 256, None] * _A + _B) & np.uint64(0xFFFFFFFF)).min(axis=0))
        return ((least * _GOLD) >> np.uint64(48)).astype(">u2").tobytes()


def prefix_depth(threshold: float, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs at the threshold share a node of some trie with the target recall; 1 if none does."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that number the class of documents with these shingles."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key, label of every row, and its ``_row`` if ``docs`` has that column; rows without words have a null key."""

    def run(batches):
        claim("lsh_forest")
        for batch in batches:
            memo: dict[str | None, tuple] = {}
            keys, labels = [], []
            for text in batch.column(1).to_pylist():
                got = memo.get(text)
                if got is None:
                    s = shingle_set(text)
                    got = memo[text] = (class_key(s), label(s)) if len(s) else (None, None)
                keys.append(got[0])
                labels.append(got[1])
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(labels, pa.binary()), *batch.columns[2:]], names=["doc_id", "key", "label", *more])

    more = [c for c in docs.columns if c == "_row"]
    return docs.select("doc_id", "text", *more).mapInArrow(run, ", ".join(["doc_id long, key binary, label binary", *[f"{c} string" for c in more]]))


def shingle_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, shingles of the classes in ``keys`` (key): a filter of bounded size tells each task which documents to ship, a class once."""
    size = min(FILTER_BITS, max(1 << 10, 1 << (CLASS_BITS * keys.count()).bit_length()))
    flags = digest_filter(keys.select(F.col("key").alias("digest")), size, 2)
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        claim("lsh_forest")
        bits, sent = shared.value.tobytes(), set()
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for text in set(batch.column(0).to_pylist()):
                s = shingle_set(text)
                key = class_key(s)
                if len(s) and key not in sent and passes(bits, key, 2):
                    sent.add(key)
                    out.append((key, s.tobytes()))
            for i in range(0, len(out), 512):
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out[i : i + 512])], names=["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def forest_groups(classes: DataFrame, threshold: float) -> DataFrame:
    """key, root of the classes (key, label) that trie nodes at the final prefix depth join, directly or through others.

    A node's members are tied to its smallest key only, so rows grow with the members and not with their pairs.
    """
    depth = prefix_depth(threshold)
    nodes = classes.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("label", t * (2 * DEPTH) + 1, F.lit(2 * depth)).alias("prefix")))).alias("node"))
    nodes = nodes.select("key", F.xxhash64("node.tree", "node.prefix").alias("node"))
    hubs = nodes.groupBy("node").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("node", "hub")
    return components(nodes.join(hubs, "node").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct())


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in ``x`` with every set in ``y``: products of 0/1 matrices over the shingles on both sides."""
    left, right = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(left, right)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    if not len(both):
        return out

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        ok = both[at] == flat
        return np.repeat(np.arange(len(sets)), [len(v) for v in sets])[ok], at[ok]

    (ri, ci), (rj, cj) = places(left, x), places(right, y)
    for begin in range(0, len(both), 4096):
        m, n = (np.zeros((k, 4096), dtype=np.float32) for k in (len(x), len(y)))
        p, q = (ci >= begin) & (ci < begin + 4096), (cj >= begin) & (cj < begin + 4096)
        m[ri[p], ci[p] - begin] = 1
        n[rj[q], cj[q] - begin] = 1
        out += m @ n.T
    return out


class _Forest(dict):
    """Which keys links join: the smallest key of each tree is its root."""

    def find(self, k: bytes) -> bytes:
        while (up := self.get(k, k)) != k:
            self[k] = self.get(up, up)
            k = up
        return k

    def join(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` and ``b`` were in different trees until now."""
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _tiles(left: list, right: list, threshold: float):
    """Row and column offset, weights of the columns and Jaccard (0 below the threshold) of every TILE by TILE part of two lists of (key, n_docs, shingles, ...)."""
    for i in range(0, len(left), TILE):
        x = [np.frombuffer(r[2], dtype=np.uint64) for r in left[i : i + TILE]]
        nx = np.array([len(v) for v in x], dtype=np.float64)[:, None]
        for j in range(0, len(right), TILE):
            y = [np.frombuffer(r[2], dtype=np.uint64) for r in right[j : j + TILE]]
            both = _shared(x, y)
            jaccard = both / (nx + np.array([len(v) for v in y], dtype=np.float64) - both)
            jaccard[jaccard < threshold] = 0
            yield i, j, np.array([r[1] for r in right[j : j + TILE]], dtype=np.int64), jaccard


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("jaccard", pa.float64())])


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _LINKS.types)], schema=_LINKS)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _within(batches, threshold: float, pairs: bool):
    """From rows (root, g, key, n_docs, shingles) that come block by block: for each class a row a, b, n, null of its
    block's tree (its smallest key) and the documents of other classes of the block that are linked to it.

    With ``pairs``, also a, b, null, jaccard of every link.
    """
    claim("lsh_forest")
    out: list[tuple] = []
    for _, group in groupby(_rows(batches), key=lambda r: r[:2]):
        own = [r[2:] for r in group]
        forest, linked = _Forest(), np.zeros(len(own), dtype=np.int64)
        for i, j, weight, jaccard in _tiles(own, own, threshold):
            if i == j:
                np.fill_diagonal(jaccard, 0)
            linked[i : i + TILE] += (jaccard > 0) @ weight
            if i <= j:
                for p, q in zip(*(x.tolist() for x in np.nonzero(np.triu(jaccard) if i == j else jaccard))):
                    a, b = own[i + p][0], own[j + q][0]
                    forest.join(a, b)
                    if pairs:
                        out.append((min(a, b), max(a, b), None, float(jaccard[p, q])))
        out += [(r[0], forest.find(r[0]), n, None) for r, n in zip(own, linked.tolist())]
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _across(batches, threshold: float, pairs: bool):
    """From rows (root, ga, other, g, key, n_docs, shingles, tree) that bring a block and then all other blocks of its
    group: for each class of the block a row a, null, n of the documents linked to it in other blocks, and for
    each later block's tree a row a, b, 0 if it is linked to a tree that wasn't joined to it here.

    With ``pairs``, also a, b, null, jaccard of every link.
    """
    claim("lsh_forest")
    out: list[tuple] = []
    for (_, ga), group in groupby(_rows(batches), key=lambda r: r[:2]):
        own: list[tuple] = []
        linked = np.zeros(0, dtype=np.int64)
        forest = _Forest()
        for other, side in groupby(group, key=lambda r: r[2]):
            if not other:
                own = [r[4:] for r in side]
                linked = np.zeros(len(own), dtype=np.int64)
                continue
            while part := list(islice(side, TILE)):  # the other blocks pass by, tile by tile
                right = [r[4:] for r in part]
                later = np.array([r[3] > ga for r in part])
                for i, _, weight, jaccard in _tiles(own, right, threshold):
                    linked[i : i + TILE] += (jaccard > 0) @ weight
                    for p, q in zip(*(x.tolist() for x in np.nonzero(jaccard * later))):
                        a, b = own[i + p], right[q]
                        if forest.join(a[3], b[3]):
                            out.append((a[3], b[3], 0, None))
                        if pairs:
                            out.append((min(a[0], b[0]), max(a[0], b[0]), None, float(jaccard[p, q])))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        out += [(r[0], None, n, None) for r, n in zip(own, linked.tolist()) if n]
    if out:
        yield _batch(out)


def verify(groups: DataFrame, sets: DataFrame, threshold: float, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """key, root, linked of the classes that groups (key, root) hold, from their sets (key, n_docs, shingles), and the links (a, b, jaccard) that ``pairs`` asks for.

    A group's classes are dealt to blocks of about BLOCK classes and BLOCK_BYTES of shingles.  Blocks are verified within first,
    which leaves trees of linked classes.  Then each block meets the other blocks of its group in one
    task, and only links between trees leave it: rows grow with the classes, not with their pairs.
    """
    sized = written(groups.join(sets, "key").select("key", "root", "n_docs", "shingles"), "sets")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).alias("blocks")
    counts = written(sized.groupBy("root").agg(blocks), "blocks")
    dealt = sized.join(counts, "root").withColumn("g", F.pmod(F.xxhash64("key"), "blocks"))
    schema = "a binary, b binary, n long, jaccard double"
    ordered = dealt.select("root", "g", "key", "n_docs", "shingles").repartition("root", "g").sortWithinPartitions("root", "g", "key")
    first = written(ordered.mapInArrow(lambda batches: _within(batches, threshold, pairs), schema), "within")
    tree = first.where("n is not null").select(F.col("a").alias("key"), F.col("b").alias("tree"), "n")
    links = first.where("n is null").select("a", "b", "jaccard")
    if counts.where("blocks > 1").isEmpty():
        return tree.select("key", F.col("tree").alias("root"), F.col("n").alias("linked")), links
    large = dealt.where("blocks > 1").join(tree.select("key", "tree"), "key")
    meets = large.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("ga"), "g", "key", "n_docs", "shingles", "tree")
    meets = meets.select("root", "ga", (F.col("g") != F.col("ga")).alias("other"), "g", "key", "n_docs", "shingles", "tree")
    ordered = meets.repartition("root", "ga").sortWithinPartitions("root", "ga", "other", "g", "key")
    more = written(ordered.mapInArrow(lambda batches: _across(batches, threshold, pairs), schema), "across")
    joined = components(more.where("n = 0").select("a", "b").distinct())
    degree = more.where("b is null").select(F.col("a").alias("key"), F.col("n").alias("more"))
    found = tree.join(degree, "key", "left").join(joined.select(F.col("key").alias("tree"), "root"), "tree", "left")
    found = found.select("key", F.coalesce("root", "tree").alias("root"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("linked"))
    return found, links.unionByName(more.where("n is null").select("a", "b", "jaccard"))


def components(links: DataFrame) -> DataFrame:
    """key, root of every linked key: the smallest key that links lead to.

    Each round ties every key to the smallest key next to it, or to what that one is tied to, and puts it in the key's place:
    links within a tree vanish, so rounds have ever fewer keys and links.  The rounds' ties, last to first, give the roots.
    """

    def united(df: DataFrame) -> DataFrame:
        return written(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    edges, ties = united(links), []
    while n := edges.count():
        few = 2 * n <= FEW_EDGES  # a link has two keys at most, so the tables of ties may then be broadcast
        ends = edges.select(F.explode(F.array(F.struct(F.col("b").alias("key"), "a"), F.struct(F.col("a").alias("key"), "a"))).alias("e"))
        near = ends.groupBy("e.key").agg(F.min("e.a").alias("near"))
        step = near.join(_side(near.select(F.col("key").alias("near"), F.col("near").alias("root")), few), "near").select("key", "root")
        tie = written(step.coalesce(1 + n // 125_000) if few else step, "ties")
        ties.append((tie, few))
        for end in ("a", "b"):
            edges = edges.join(_side(tie.select(F.col("key").alias(end), F.col("root").alias("tied")), few), end).withColumn(end, F.col("tied")).select("a", "b")
        edges = united(edges)
    roots = edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
    for tie, few in reversed(ties):  # a later round has no more keys than this one
        last = _side(roots.select(F.col("key").alias("root"), F.col("root").alias("last")), few)
        roots = written(tie.join(last, "root", "left").select("key", F.coalesce("last", "root").alias("root")), "roots")
    return roots


def _side(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def similarity_join(docs: DataFrame, threshold: float = 0.8, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, key, and the row's number where ``docs`` has a column ``_row``), classes (key, n_docs, rep, root, linked) and, with ``pairs``, all links between classes (a, b, jaccard).

    Rows with equal shingle sets have one key, 128 bits of their hash; rows without words have a null key and no links.
    ``rep`` is the smallest identifier of a class, ``root`` the smallest key that links lead to and ``linked`` the number of
    documents of other classes linked to it; both are null in classes that no other class resembles.
    """
    rows = written(sketch(docs), "sketches")
    known = rows.where("key is not null")
    classes = written(known.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("rep"), F.first("label").alias("label")), "classes")
    groups = forest_groups(classes, threshold)
    sets = shingle_sets(docs, groups.select("key")).join(classes.select("key", "n_docs"), "key")
    verified, links = verify(groups, sets, threshold, pairs)
    return rows.drop("label"), classes.select("key", "n_docs", "rep").join(verified, "key", "left"), links


def _classified(docs: DataFrame, threshold: float) -> DataFrame:
    """The columns of similarity_join()'s members with group (one for the classes that links join, null without words), class_id, copies_id and n_links."""
    members, classes, _ = similarity_join(docs, threshold)
    classes = written(classes.withColumn("group", F.coalesce("root", "key")), "verified")
    ids = classes.groupBy("group").agg(F.min("rep").alias("class_id"))
    found = classes.join(ids, "group").select("key", "group", "class_id", F.col("rep").alias("copies_id"), (F.col("n_docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(written(found, "found"), "key", "left")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, copies_id, n_links for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the documents that links of the threshold or more lead to,
    ``copies_id`` the smallest one with the same shingles, ``n_links`` the number of other documents linked directly, equal ones included.
    Rows without words link to nothing and are their own class; repeated rows count each; other columns are not read.
    """
    found = _classified(docs.select("doc_id", "text"), threshold)
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies_id", "doc_id").alias("copies_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of near_duplicates(), all its columns as they are: the one with the smallest doc_id.

    Classes are told apart by their texts, whatever identifiers repeat.  Of rows that share the smallest doc_id one stays;
    rows without words stay each; null identifiers come last.  Extra columns may have any names; an empty table stays empty.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = numbered(docs, names)
    found = _classified(rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "_row"), threshold)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = found.groupBy("group", F.when(F.col("group").isNull(), F.col("_row")).alias("alone")).agg(F.min(order)["_row"].alias("_row")).select("_row")
    return rows.join(first, "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in at.items()])
