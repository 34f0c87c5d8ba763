"""Exact dedup by a log-structured merge index over text digests.

Each task fills memtables: texts of one digest meet there and are compared byte by byte.  A full memtable
is flushed as a run sorted by digest, written to the shared folder.  Compaction brings the entries of all runs together by
digest prefix, merges them in digest order and keeps, for every digest that several entries hold (a hit), the first identifier in the
index's order.  A compacted run has a Bloom filter of its hits, which a second pass over the documents probes to pick
the texts of hits, one copy for each task, and the bytes decide.  Digests whose texts differ are split by text.
Identifiers stay with their runs: only one small row for each entry moves, however many documents share a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import numbered, written

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MEMTABLE_BYTES = 48 << 20
#: First bits of a digest that name its compacted run.
PREFIX = 14
#: Bits of a compacted run's filter for each hit and at most, powers of two; beyond, the second pass only moves more texts.
HIT_BITS, FILTER_BITS = 16, 1 << 13
PROBES = 4
RUNS = "run long, digest binary, slot long, ids array<long>, rows array<string>"
VERDICTS = "digest binary, run long, slot long, keep_run long, keep_slot long, keep_id long, group_size long, filter binary"


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(LOWER)


def digest_of(text: bytes, size: int) -> bytes:
    """The first ``size`` bytes of the SHA-256, filled up with zeros."""
    return hashlib.sha256(text).digest()[:size].ljust(32, b"\0")


def _rows(batches) -> Iterator[tuple[int | None, bytes, str | None]]:
    for batch in batches:
        more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for doc_id, text, row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), more):
            yield doc_id, normalised(text), row


def _record(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


def flush_runs(docs: DataFrame, largest: bool, digest_bytes: int, memtable_bytes: int) -> DataFrame:
    """run, digest, slot, ids (the identifier to keep first), rows (their ``_row``, if there is one): sorted runs by digest, one entry for each text of a memtable."""
    schema = [("run", pa.int64()), ("digest", pa.binary()), ("slot", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.string()))]

    def run(batches):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        table: dict[bytes, list[tuple[bytes, list]]] = {}
        held = 0

        def flush():
            nonlocal table, held, seq
            out = []
            for digest in sorted(table):
                for slot, (_, members) in enumerate(table[digest]):
                    members.sort(key=lambda m: (m[0] is None, 0 if m[0] is None else -m[0] if largest else m[0], m[1] or ""))
                    out.append(((task << 24) + seq, digest, slot, [m[0] for m in members], [m[1] for m in members] if members[0][1] is not None else None))
            table, held, seq = {}, 0, seq + 1
            for i in range(0, len(out), 4096):
                yield _record(out[i : i + 4096], schema)

        for doc_id, text, row in _rows(batches):
            entries = table.setdefault(digest_of(text, digest_bytes), [])
            for same, members in entries:
                if same == text:
                    members.append((doc_id, row))
                    break
            else:
                entries.append((text, [(doc_id, row)]))
                held += len(text) + 200
            held += 16 if row is None else 80
            if held >= memtable_bytes:
                yield from flush()
        if table:
            yield from flush()

    return docs.mapInArrow(run, RUNS)


def _prefix(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big") >> (32 - PREFIX)


def run_filter(digests: list[bytes]) -> bytes:
    """Bloom filter of a compacted run: PROBES bits for each digest, from seven bytes each."""
    size = min(FILTER_BITS, max(64, 1 << (HIT_BITS * len(digests) - 1).bit_length()))
    out = bytearray(size // 8)
    for digest in digests:
        for k in range(PROBES):
            at = int.from_bytes(digest[7 * k : 7 * k + 7], "big") & (size - 1)
            out[at >> 3] |= 1 << (at & 7)
    return bytes(out)


def may_hold(flags: bytes | None, digest: bytes) -> bool:
    """Whether the run with this filter may hold ``digest``."""
    if flags is None:
        return False
    last = len(flags) * 8 - 1
    for k in range(PROBES):
        at = int.from_bytes(digest[7 * k : 7 * k + 7], "big") & last
        if not flags[at >> 3] >> (at & 7) & 1:
            return False
    return True


def compact(runs: DataFrame, largest: bool) -> DataFrame:
    """The entries of hits, in digest order: digest, run, slot, and the kept entry (keep_run, keep_slot, keep_id) and size of the digest's group.

    Every compacted run also has a row without a run: its first digest and its filter.
    """
    schema = [("digest", pa.binary()), ("run", pa.int64()), ("slot", pa.int64()), ("keep_run", pa.int64()), ("keep_slot", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("filter", pa.binary())]
    entries = runs.select("digest", "run", "slot", F.col("ids")[0].alias("best"), F.size("ids").cast("long").alias("n"))
    # one task has all entries of a prefix; the sort merges what the runs bring in order
    place = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - PREFIX)
    ordered = entries.withColumn("part", place).repartition("part").sortWithinPartitions("digest", "run", "slot").drop("part")

    def merge(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for _, part in groupby(rows, key=lambda r: _prefix(r[0])):
            hits: list[bytes] = []
            for digest, same in groupby(part, key=lambda r: r[0]):
                own = list(same)  # no more than there are runs, unless texts collide
                if len(own) > 1:
                    _, run, slot, best, _ = min(own, key=lambda r: (r[3] is None, 0 if r[3] is None else -r[3] if largest else r[3], r[1], r[2]))
                    size = sum(r[4] for r in own)
                    out += [(digest, r[1], r[2], run, slot, best, size, None) for r in own]
                    hits.append(digest)
            if hits:
                out.append((hits[0], None, None, None, None, None, None, run_filter(hits)))
            if len(out) >= 10_000:
                yield _record(out, schema)
                out = []
        if out:
            yield _record(out, schema)

    return ordered.mapInArrow(merge, VERDICTS)


def hit_texts(docs: DataFrame, filters: dict[int, bytes], digest_bytes: int, memtable_bytes: int) -> DataFrame:
    """digest, text of documents whose digest passes its compacted run's filter, each text once in a memtable's span."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = [("digest", pa.binary()), ("text", pa.binary())]

    def run(batches):
        known = shared.value
        seen: set[bytes] = set()
        out: list[tuple[bytes, bytes]] = []
        held = 0
        for _, text, _ in _rows(batches):
            digest = digest_of(text, digest_bytes)
            if may_hold(known.get(_prefix(digest)), digest) and text not in seen:
                seen.add(text)
                out.append((digest, text))
                held += len(text)
                if held >= memtable_bytes // 4:
                    yield _record(out, schema)
                    seen, out, held = set(), [], 0
        if out:
            yield _record(out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "digest binary, text binary")


def _split_by_text(docs: DataFrame, colliding: DataFrame, digest_bytes: int, largest: bool) -> DataFrame:
    """The members of colliding digests, told apart by their texts: doc_id, keep_id, group_size, kept, digest, _row."""
    from pyspark.sql import Window

    schema = [("doc_id", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()), ("row", pa.string())]

    def run(batches):
        for batch in batches:
            yield _record([(i, digest_of(x, digest_bytes), x, r) for i, x, r in _rows([batch])], schema)

    rows = docs.mapInArrow(run, "doc_id long, digest binary, text binary, _row string").join(colliding, "digest", "left_semi")
    group = Window.partitionBy("digest", "text")
    turn = F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id") if largest else F.asc_nulls_last("doc_id"), "_row"))
    best = F.max("doc_id") if largest else F.min("doc_id")
    return rows.select("doc_id", best.over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (turn == 1).alias("kept"), "digest", "_row")


def exact_groups(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs`` (doc_id, text), and its ``_row`` if there is one.

    Texts are equal when identical after lower-casing A-Z; a null text is empty.  ``keep`` says which
    identifier of a group stays, ``smallest`` or ``largest``; null identifiers come last, and of rows that
    repeat the kept identifier exactly one is kept.  Other columns are not read; an empty table gives no rows.
    """
    largest = keep == "largest"
    more = [c for c in docs.columns if c == "_row"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    runs = written(flush_runs(docs, largest, digest_bytes, memtable_bytes), "lsm-runs")
    compacted = written(compact(runs, largest), "lsm-compacted")
    filters = {_prefix(bytes(r.digest)): bytes(r.filter) for r in compacted.where("filter is not null").select("digest", "filter").collect()}  # at most 2**PREFIX filters
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", *more]
    verdicts = compacted.where("filter is null").drop("filter")
    clash = None
    if filters:
        texts = hit_texts(docs, filters, digest_bytes, memtable_bytes)
        clash = written(texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low != high").select("digest"), "lsm-clashes")
        if clash.isEmpty():
            clash = None
    if clash is not None:
        runs = runs.join(clash, "digest", "left_anti")
    # an entry is one row on both sides, so that a group of any size is spread like its runs
    found = runs.join(verdicts, ["run", "digest", "slot"], "left")
    found = found.select("digest", "run", "slot", F.coalesce("keep_run", "run").alias("keep_run"), F.coalesce("keep_slot", "slot").alias("keep_slot"), F.when(F.col("keep_run").isNull(), F.col("ids")[0]).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.size("ids").cast("long")).alias("group_size"), "ids", "rows")
    member = found.select("*", F.posexplode("ids").alias("pos", "doc_id"))
    kept = (F.col("run") == F.col("keep_run")) & (F.col("slot") == F.col("keep_slot")) & (F.col("pos") == 0)
    out = member.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", *[F.get("rows", F.col("pos")).alias(c) for c in more])
    if clash is None:
        return out
    return out.unionByName(_split_by_text(docs, clash, digest_bytes, largest).select(*columns))


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of ``docs`` for each text, all its columns as they are: the row with the ``largest`` or ``smallest`` doc_id.

    Of rows that repeat both one stays.  Null texts count as empty, null identifiers come last, extra columns may have any
    names, and an empty table stays empty.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = numbered(docs, names)
    kept = exact_groups(rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "_row"), keep).where("kept").select("_row")
    return rows.join(kept, "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in at.items()])
