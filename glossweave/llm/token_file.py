"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

A shard file holds, little-endian throughout:

* ``GWTF`` and the format version (uint32),
* documents (uint32), ids before the shard's first document (uint64),
* one index row per document: doc_id (int64), ids (uint32), control bytes (uint32), data bytes (uint32),
  all index columns stored one after the other,
* the control bytes of all documents, then the data bytes of all documents.

A document's ids are replaced by their rank in the corpus frequency table and stored in one to four
bytes each.  A control byte holds the lengths of four ids, two bits each, lowest bits first; the last
one of a document is padded with zero bits.  The rank table is a file of its own (uint32 ids in rank order).
"""

from __future__ import annotations

import codecs
import gc
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate, pairwise
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import claim, remember, scratch_path, written

MAGIC, VERSION = b"GWTF", 1
#: Ids in a batch's text that are encoded by the library in one call.
JOINED = 48
#: Words that the model merges in one call.
MERGED = 512
#: Chunks that a worker remembers at most; a chunk is remembered from the second batch that has it.
REMEMBERED = 250_000
#: Ids of a shard that are decoded at once, by whole documents.
BLOCK = 1 << 18
#: Slots, a power of two, that tell whether a chunk was met before.
MET = 1 << 21
#: A single space splits a text exactly unless white space is on both of its sides.
WIDE_SPACE = re.compile(r"\s \s")
#: A line end between words splits it too, unless other white space is next to it or it is one of more than two.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
BESIDE = ("  ", " \n", "\n ", "\n\n\n")
WITH_SPACE = re.compile(r"\s")
#: A chunk that begins with this one stands after a line end instead of a space.
LINE = "\0"
#: A word's ids come from the model alone; a mark after it is split off before merging, so they serve with and without it.
MARKS = ".,"
LETTERS = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and chr(c) not in "ªµº"]
WORD = re.compile(rf"{LINE}?[{''.join(LETTERS)}]+[{MARKS}]?").fullmatch

_state: dict[str, tuple] = {}


def _coder(path: str) -> tuple:
    """The tokenizer, the chunks known, the id of a line end, the slots of chunks met and the special tokens, of this worker process."""
    # one task, one core: the library's threads would cost time and memory of their own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _state:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        probe = "a b\n c, d.\n\ne  f"
        whole = tokenizer.encode(probe, add_special_tokens=False).ids
        newline = tokenizer.encode("\n", add_special_tokens=False).ids
        pieces = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", " b\n", " c,", " d.\n\ne  f")]
        # chunking needs a byte-level split that starts words at a space; else texts are encoded whole
        exact = tokenizer.normalizer is None and len(newline) == 1 and sum(pieces, []) == whole
        _state[path] = (tokenizer, remember("token_file", {}), newline[0] if exact else None, bytearray(MET), special)
    return _state[path]


def _spelling(tokenizer) -> str:
    """How the model spells each byte of words and line ends, a table for the charmap codec; empty if the tokenizer's own splitting doesn't keep words whole."""
    split, letters = tokenizer.pre_tokenizer, " " + "".join(LETTERS)
    whole = split.pre_tokenize_str(letters) if split is not None else []
    line = split.pre_tokenize_str("\n") if split is not None else []
    if len(whole) != 1 or len(line) != 1 or len(line[0][0]) != 1:
        return ""
    table = dict(zip(letters.encode(), whole[0][0])) | {ord("\n"): line[0][0]}
    spelling = "".join(table.get(b, "\ufffe") for b in range(256))  # U+FFFE: no such byte
    return spelling if codecs.charmap_decode(letters.encode(), "strict", spelling)[0] == whole[0][0] else ""


def _merged(tokenizer, newline: int, spelling: str, words: list[str]) -> list[bytes]:
    """The ids of words, by the model alone: line ends join them to few calls and part their ids."""
    from tokenizers import Tokenizer, pre_tokenizers

    mark = spelling[ord("\n")]
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = pre_tokenizers.Split(mark, "isolated")
    parts = [words[i : i + MERGED] for i in range(0, len(words), MERGED)]
    spelt = [codecs.charmap_decode("\n".join(p).encode(), "strict", spelling)[0] for p in parts]
    out: list[bytes] = []
    for part, got in zip(spelt, model.encode_batch_fast(spelt, add_special_tokens=False)):
        ids = np.array(got.ids, dtype="<u4")
        ends = np.flatnonzero(ids == newline)
        if len(ends) != part.count(mark):
            out += [np.array([t.id for t in model.model.tokenize(x)], dtype="<u4").tobytes() for x in part.split(mark)]
            continue
        raw = ids.tobytes()
        out += [raw[x + 4 : y] for x, y in pairwise([-4, *(4 * ends).tolist(), len(raw)])]
    return out


def _learn(tokenizer, known: dict[str, bytes], fresh: set[str], newline: int) -> dict[str, bytes]:
    """Ids of chunks that aren't known and of their words: words by the model, the others joined by line ends to one call; a line end is one id and splits words."""
    line = np.array([newline], dtype="<u4").tobytes()
    spelling = _spelling(tokenizer)
    words, marked, plain, odd = [], [], [], []
    new: dict[str, bytes] = {}
    for x in fresh:
        if spelling and WORD(x):
            if x[-1] in MARKS:
                marked.append(x)
                x = x[:-1]
                if x in fresh or x in new or x in known:
                    continue
                new[x] = b""
            words.append(x)
        elif x in ("", LINE) or WITH_SPACE.search(x):
            odd.append(x)
        else:
            plain.append(x)
    for x, got in zip(words, _merged(tokenizer, newline, spelling, [x[1:] if x[0] == LINE else " " + x for x in words])):
        new[x] = line + got if x[0] == LINE else got
    joined = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
    for part, got in zip(joined, tokenizer.encode_batch_fast(["\n".join([x[1:] if x[0] == LINE else " " + x for x in p]) for p in joined], add_special_tokens=False)):
        ids = np.array(got.ids, dtype="<u4")
        ends = np.flatnonzero(ids == newline).tolist()
        if len(ends) != len(part) - 1:
            odd.extend(part)
            continue
        raw, begin = ids.tobytes(), 0
        ends.append(len(ids))
        for chunk, end in zip(part, ends):
            new[chunk] = line * (chunk[0] == LINE) + raw[4 * begin : 4 * end]
            begin = end + 1
    whole = ["\n" + x[1:] if x[:1] == LINE else " " + x for x in odd]
    for chunk, got in zip(odd, tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
        new[chunk] = np.array(got.ids, dtype="<u4").tobytes()
    mark_ids = {c: np.array(tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in MARKS}
    for x in marked:
        new[x] = (known.get(x[:-1]) or new[x[:-1]]) + mark_ids[x[-1]]
    return new


def _parted(text: str) -> str | None:
    """``text`` with a space before every chunk but the first, line ends turned to `` LINE``; None if white space doesn't divide it exactly."""
    if LINE in text:
        return None
    if not (any(x in text for x in BESIDE) or text.endswith("\n\n") or any(map(text.__contains__, OTHER_SPACE))):
        return text.replace("\n", " " + LINE)
    return None if WIDE_SPACE.search(text) else text


@contextmanager
def _no_collection():
    """Millions of strings live for a batch and form no cycles: the collector would walk their lists again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@_no_collection()
def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids as little-endian uint32, the same as the library gives for the whole text.

    Every distinct chunk of ``texts`` is looked up once, and one gather lays out the ids of all chunks.
    """
    tokenizer, known, newline, met, special = _coder(path)
    out: list[bytes | None] = [None] * len(texts)
    heads: list[tuple[int, str]] = []
    rest: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        parted = None if newline is None or any(x in text for x in special) else _parted(text)
        if parted is None:
            out[i] = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        else:
            head, space, tail = parted.partition(" ")
            heads.append((i, head))
            if space:
                rest.append((i, tail))
    for (i, _), got in zip(heads, tokenizer.encode_batch_fast([x for _, x in heads], add_special_tokens=False)):
        out[i] = np.array(got.ids, dtype="<u4").tobytes()
    if not rest:
        return out
    lists = pc.split_pattern(pa.array([x for _, x in rest], pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    # no chunk holds a space, so one string brings all distinct ones over
    chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
    ids = list(map(known.get, chunks))
    missed = [k for k, x in enumerate(ids) if x is None]
    new = _learn(tokenizer, known, {chunks[k] for k in missed}, newline) if missed else {}
    for k in missed:
        ids[k] = new[chunks[k]]
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    flat, starts = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    n = sizes[codes]
    ends = np.cumsum(n)
    raw = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(n.sum())].tobytes()
    places = 4 * np.concatenate([[0], ends])[lists.offsets.to_numpy()]
    for (i, _), (x, y) in zip(rest, pairwise(places.tolist())):
        out[i] += raw[x:y]
    room = REMEMBERED - len(known)
    for x, ids in new.items() if room > 0 else ():
        slot = hash(x) & (MET - 1)
        if not met[slot]:
            met[slot] = 1
        elif room > 0:
            room -= 1
            known[x] = ids
    return out


def vbyte_encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of uint32."""
    return next(vbyte_parts(ranks, len(ranks)))


def vbyte_parts(ranks: np.ndarray, *counts: int) -> Iterator[tuple[bytes, bytes]]:
    """Control bytes and data bytes of each of the documents of so many uint32 that follow one another in ``ranks``."""
    ranks, n = ranks.astype("<u4"), np.array(counts, dtype=np.int64)
    size = 1 + (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads, ends = -(-n // 4), np.cumsum(n)
    code = np.zeros(4 * quads.sum(), dtype=np.uint8)
    code[np.arange(len(ranks)) + np.repeat(4 * (np.cumsum(quads) - quads) - (ends - n), n)] = size - 1
    code = code.reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], ends])].tolist()
    cut = [0, *np.cumsum(quads).tolist()]
    for k in range(len(counts)):
        yield control[cut[k] : cut[k + 1]], data[at[k] : at[k + 1]]


#: Lengths of the four ids that each control byte stands for.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.int64)


def vbyte_decode(control: bytes, data: bytes, *counts: int) -> np.ndarray:
    """The uint32 arrays of so many ids each, one after the other: lengths by table lookup, then one gather for each byte position."""
    n = np.array(counts, dtype=np.int64)
    if not n.any():
        return np.zeros(0, dtype="<u4")
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()
    padding, ends = -n % 4, np.cumsum(n + -n % 4)
    kept = np.ones(len(size), dtype=bool)
    for k in (1, 2, 3):
        kept[ends[padding >= k] - k] = False
    size = size[kept]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(3, dtype=np.uint32)])
    out = raw[at]
    for k in (1, 2, 3):
        some = size > k
        if some.any():
            out[some] |= raw[at[some] + k] << np.uint32(8 * k)
    return out.astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_shard(uri: str, base: int, docs: list[tuple[int, int, bytes, bytes]]) -> None:
    """Write a shard under a name of its own and move it into place."""
    ids, count, control, data = (list(x) for x in zip(*docs)) if docs else ([], [], [], [])
    head = MAGIC + np.array([VERSION, len(docs)], dtype="<u4").tobytes() + np.array([base], dtype="<u8").tobytes()
    index = np.array(ids, dtype="<i8").tobytes() + b"".join(np.array(x, dtype="<u4").tobytes() for x in (count, [*map(len, control)], [*map(len, data)]))
    files, path = _filesystem(uri)
    with files.open_output_stream(f"{path}.part") as out:
        for part in (head, index, *control, *data):
            out.write(part)
    files.move(f"{path}.part", path)


def read_shard(uri: str, ranked: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """doc_id, ids before it, and its ids, document by document."""
    files, path = _filesystem(uri)
    with files.open_input_stream(path) as source:
        raw = memoryview(source.read())
    version, n = np.frombuffer(raw[4:12], dtype="<u4").tolist()
    if bytes(raw[:4]) != MAGIC or version != VERSION:
        raise ValueError(f"{uri} is not a token file of version {VERSION}")
    before = int(np.frombuffer(raw[12:20], dtype="<u8")[0])
    at = 20 + 8 * n
    ids = np.frombuffer(raw[20:at], dtype="<i8").tolist()
    count, control, data = (np.frombuffer(raw[at + 4 * n * k : at + 4 * n * (k + 1)], dtype="<u4").tolist() for k in range(3))
    c = at + 12 * n
    d = c + sum(control)
    begin = 0
    while begin < n:
        end, held = begin, 0
        while end < n and held < BLOCK:
            held += count[end]
            end += 1
        a, b = sum(control[begin:end]), sum(data[begin:end])
        got, at = ranked[vbyte_decode(raw[c : c + a], raw[d : d + b], *count[begin:end])], 0
        for doc, k in zip(ids[begin:end], count[begin:end]):
            yield doc, before, got[at : at + k]
            before, at = before + k, at + k
        begin, c, d = end, c + a, d + b


def blocks(counts: list[int]) -> Iterator[int]:
    """Ends of runs of documents of at least BLOCK ids, but the last."""
    held = 0
    for k, n in enumerate(counts, 1):
        held += n
        if held >= BLOCK or k == len(counts):
            yield k
            held = 0


def _batches(texts: list, chars: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about so many characters."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (uint16 or uint32 little-endian, by ``wide``) of every document, the end id last; a null text is empty."""

    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        claim("token_file")
        for batch in batches:
            ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for part in _batches(texts):
                out = [x + end for x in encode_texts(tokenizer, texts[part])]
                counts = [len(x) // 4 for x in out]
                flat = np.frombuffer(b"".join(out), dtype="<u4")
                wide = [False] * len(out)
                if flat.max() > 0xFFFF:
                    wide = [bool(np.frombuffer(x, dtype="<u4").max() > 0xFFFF) for x in out]
                short, at = flat.astype("<u2").tobytes(), accumulate(counts, initial=0)
                raw = [x if w else short[2 * a : 2 * (a + n)] for x, w, n, a in zip(out, wide, counts, at)]
                yield pa.record_batch([ids[part], pa.array(counts, pa.int64()), pa.array(wide), pa.array(raw, pa.binary())], names=["doc_id", "n", "wide", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, wide boolean, ids binary")


def _unpack(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if wide else "<u2")


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, n over all documents: counted within each task, then summed."""

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            flags, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for wide in {*flags}:
                got = np.bincount(_unpack(b"".join([x for w, x in zip(flags, raws) if w == wide]), wide), minlength=len(total))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total += got
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write all of ``docs`` (doc_id, text) to token files in ascending doc_id order; return the manifest (shard, path, docs, base, ids).

    Null texts are empty, null doc_ids are left out of the order's end and stored as the smallest
    integer, repeated rows are stored each.  An empty table gives no shards.  The rank table is bounded by
    the vocabulary, the driver sees one count a shard.
    """
    spark = docs.sparkSession
    encoded = written(encode(docs, tokenizer, end_id), "token-ids", codec="zstd")
    counts = id_counts(encoded).toPandas().sort_values(["n", "id"], ascending=[False, True])
    ranked = counts["id"].to_numpy(dtype="<u4")
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype="<u4")
    rank[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank)

    smallest = F.lit(-(1 << 63))
    parts = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.select(F.coalesce("doc_id", smallest).alias("doc_id"), "n", "wide", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "wide", "ids")

    def store(batches):
        from pyspark import TaskContext

        shard, held, name = TaskContext.get().partitionId(), [], uuid.uuid4().hex
        files, size, seq, total = [], 0, 0, 0

        def flush():
            nonlocal held, size, seq, total
            path = f"{out_dir}/shard-{shard:06d}-{seq:06d}-{name}"
            write_shard(path, total, held)  # ids before it within the partition; the manifest adds those of earlier partitions
            n = sum(x[1] for x in held)
            files.append((shard, seq, path, len(held), n, total))
            held, size, seq, total = [], 0, seq + 1, total + n

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for begin, end in pairwise([0, *blocks([x[1] for x in rows])]):
                part = rows[begin:end]
                ranks = [shared.value[_unpack(raw, wide)] for _, _, wide, raw in part]
                for (doc_id, n, _, _), (control, data) in zip(part, vbyte_parts(np.concatenate(ranks), *map(len, ranks))):
                    held.append((doc_id, n, control, data))
                    size += len(control) + len(data)
                    if size >= 64 << 20:
                        flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "seq", "path", "docs", "ids", "within"), x)) for x in files], schema=pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("within", pa.int64())]))

    rows = written(ordered.mapInArrow(store, "shard long, seq long, path string, docs long, ids long, within long"), "token-manifest")
    base, manifest = 0, []
    for row in sorted(rows.collect()):
        manifest.append((row.shard, row.seq, row.path, row.docs, row.ids, base, base - row.within))
        base += row.ids
    files, path = _filesystem(f"{out_dir}/ranks")
    with files.open_output_stream(path) as out:
        out.write(ranked.tobytes())
    return spark.createDataFrame(manifest, "shard long, seq long, path string, docs long, ids long, base long, shift long")


def read_token_files(spark: SparkSession, manifest: DataFrame, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, read from the files."""
    files, path = _filesystem(f"{out_dir}/ranks")
    with files.open_input_stream(path) as source:
        ranked = spark.sparkContext.broadcast(np.frombuffer(source.read(), dtype="<u4"))

    def run(batches):
        for batch in batches:
            for path, shift in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(None if doc == -(1 << 63) else doc, start + shift, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))) for doc, start, ids in read_shard(path, ranked.value)]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "shift").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    spark = docs.sparkSession
    out_dir = scratch_path(spark, "token-files")
    files, path = _filesystem(out_dir)
    files.create_dir(path, recursive=True)
    return read_token_files(spark, write_token_files(docs, out_dir, tokenizer, end_id), out_dir)
