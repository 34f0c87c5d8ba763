"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed and its parts rebuilt: the normaliser (precompiled character map, white-space
removal), the metaspace marker with its dummy prefix, the pieces as a unigram model with their scores or as
byte-pair merges in the order of their scores (whichever type the file has), user-defined pieces, byte
fallback and the decoder.  Batches are encoded by the library's threads.  Parity with the sentencepiece
library is verified on every distinct chunk that a worker encodes; where it fails, an error tells the chunk.

Where no piece holds a marker behind another character, no merge or path crosses the start of a marker
run, so texts are encoded chunk by chunk at single spaces and a chunk met before is looked up.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossweave.llm.common import claim, remember

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
JOINED = 32
#: Chunks that a worker remembers; those met later are forgotten after their batch.
REMEMBERED = 250_000
#: Characters encoded in one call.
BATCH_CHARS = 1 << 20

_workers: dict[tuple, "Codec"] = {}


def read_model(path: str):
    """The parsed protobuf of a SentencePiece model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def merges_of(pieces: Iterable[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first; ways to the same piece in the order of the left part's length."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    order = {p: i for i, p in enumerate(score)}
    found = [(-score[p], order[p], k) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    names = list(score)
    return [(names[i][:k], names[i][k:]) for _, i, k in sorted(found)]


def rebuild(model):
    """A tokenizers.Tokenizer that encodes and decodes as the SentencePiece ``model`` does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    spec, trainer = model.normalizer_spec, model.trainer_spec
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    fallback = any(kind == BYTE for _, _, kind in pieces)
    if trainer.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=fallback)
    elif trainer.model_type == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=merges_of(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor byte-pair")
    tokenizer = Tokenizer(core)
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_markers(pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
    user = [p for p, _, kind in pieces if kind == USER_DEFINED]
    if user:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p in user])
    after = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.add_dummy_prefix:
        after.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(after)
    return tokenizer


def splits_at_markers(pieces: Iterable[tuple[str, float, int]]) -> bool:
    return not any(MARKER in p.lstrip(MARKER) for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED))


class Codec:
    """A worker's tokenizer, reference and memory of chunks."""

    def __init__(self, path: str, verify: bool = True):
        import sentencepiece

        model = read_model(path)
        self.pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self.tokenizer = rebuild(model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path) if verify else None
        spec = model.normalizer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not any(k == USER_DEFINED for _, _, k in self.pieces)
        self.known: dict[str, bytes] = {}
        line = self._ids(["a\nb"])[0]
        self.line = int(line[len(self._ids(["a"])[0])]) if plain and splits_at_markers(self.pieces) else None
        if self.line is not None:
            cut = [i for i, x in enumerate(line) if x == self.line]
            if len(cut) != 1 or any("\n" in p for p, _, _ in self.pieces):
                self.line = None
        #: What each id stands for, white-space marker undone; for decoding by table lookup.
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARKER, " ").encode() for p, _, kind in self.pieces]
        self.prefix = spec.add_dummy_prefix

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids if t else [] for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _check(self, texts: list[str], ids: list[list[int]]) -> None:
        if self.reference and (want := self.reference.encode(texts, num_threads=1)) != ids:
            bad = next(i for i, x in enumerate(want) if x != ids[i])
            raise ValueError(f"parity failed on {texts[bad][:200]!r}: {ids[bad][:50]} against {want[bad][:50]}")

    def _learn(self, fresh: set[str]) -> None:
        odd = {x for x in fresh if "\n" in x or not x}
        words = list(fresh - odd)
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        texts = ["\n ".join(p) for p in parts]
        got = self._ids(texts)
        self._check(texts, got)
        for part, ids in zip(parts, got):
            flat = np.array(ids, dtype="<u4")
            ends = [*np.flatnonzero(flat == self.line).tolist(), len(flat)]
            if len(ends) != len(part):
                odd.update(part)
                continue
            raw, begin = flat.tobytes(), 0
            for word, end in zip(part, ends):
                self.known[word] = raw[4 * begin : 4 * end]
                begin = end + 1
        rest = [x for x in odd if x]
        got = self._ids(rest)
        self._check(rest, got)
        self.known.update(zip(rest, [np.array(x, dtype="<u4").tobytes() for x in got]))
        if "" in odd:
            self.known[""] = np.array(self._ids([" "])[0][:0], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, little-endian uint32."""
        out: list[bytes | None] = [None] * len(texts)
        split = {i: t.split(" ") for i, t in enumerate(texts) if t and self.line is not None and MARKER not in t and "  " not in t and t[-1] != " " and t[0] != " "}
        whole = [i for i in range(len(texts)) if i not in split]
        if whole:
            some = [texts[i] for i in whole]
            ids = self._ids(some)
            self._check(some, ids)
            for i, x in zip(whole, ids):
                out[i] = np.array(x, dtype="<u4").tobytes()
        fresh = {x for x in set().union(*split.values()) if x not in self.known}
        full = len(self.known) > REMEMBERED
        if fresh:
            self._learn(fresh)
        for i, words in split.items():
            out[i] = b"".join(map(self.known.__getitem__, words))
        if full:
            for x in fresh:
                del self.known[x]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def codec(path: str, threads: int = 2, verify: bool = True) -> Codec:
    """This process's codec, as a task begins; the library encodes a batch with so many threads.

    The library starts its threads with the first batch that asks for them and then keeps their number.
    """
    claim("sp_tokenizers")
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    if (path, verify) not in _workers:
        os.environ.setdefault("RAYON_NUM_THREADS", str(max(2, threads)))
        _workers[path, verify] = Codec(path, verify)
        remember("sp_tokenizers", _workers[path, verify].known)
    return _workers[path, verify]


def _spans(texts: list[str]) -> Iterable[slice]:
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BATCH_CHARS:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text): the whole text's ids; null and empty texts have none.

    Rows that repeat are encoded each; other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        own = codec(model, threads)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in _spans(texts):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in own.encode(texts[part])]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.record_batch([batch.column(0)[part], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids)."""

    def run(batches):
        own = codec(model, 1)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32), round_trip (decoding gives the text back) of every row.

    Null and empty texts have no ids, repeated rows a row each; other columns are not read; an empty table gives no rows.
    Every text that is not put together from verified chunks is itself compared with the sentencepiece library.
    """

    def run(batches):
        own = codec(model, threads)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in _spans(texts):
                raw = own.encode(texts[part])
                same = [own.decode(np.frombuffer(x, dtype="<u4")) == t for x, t in zip(raw, texts[part])]
                yield pa.record_batch([batch.column(0)[part], pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
