import gc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import sp_tokenizers, token_file
from glossweave.llm.queries import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "x\n \ny", "\n", "\t x", "a, b.", "don't we'll 's", "w. w, w", "日本 🏽", "a\x00b", "<|endoftext|>", "▁a ▁", "x y z", "é é", "x\r\n y", "12 3.4,", ".", "a\n\nb", "a\n\n\nb", "a\n\n", "Zé.\nThe the.\nthe,", "a\n###\n's", "µx ºx ×\nÿ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(HARD), st.text(alphabet="ab ,.'\n\t\r é1$ ", max_size=30), st.text(max_size=20)), max_size=5))
def test_chunks_encode_as_whole_texts(texts):
    from tokenizers import Tokenizer

    whole = _whole.setdefault(0, Tokenizer.from_file(BPE))
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_file.encode_texts(BPE, texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


_whole: dict = {}


def test_special_tokens_as_the_library_takes_them(library):
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "a <|endoftext| > b"):
        assert np.frombuffer(token_file.encode_texts(BPE, [text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_file.encode_texts(BPE, ["x <|endoftext|> y"])[0], "<u4").tolist() == [87, 220, 50256, 331]


def test_forgetting_chunks_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_file, "REMEMBERED", 2)
    texts = [f"the {w} and, {w}. or {w}" for w in ("cat", "dog", "cat", "emu")]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in token_file.encode_texts(BPE, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_each_distinct_chunk_is_looked_up_once(library, monkeypatch):
    class Counting(dict):
        gets = 0

        def get(self, key, default=None):
            Counting.gets += 1
            return dict.get(self, key, default)

    coder = token_file._coder(BPE)
    monkeypatch.setitem(token_file._state, BPE, (coder[0], Counting(), *coder[2:]))
    texts = ["one the cat and\nthe dog " + "the cat and the dog " * 200 + "end"] * 5 + ["alone", "", " ", "\nx"]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_file.encode_texts(BPE, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counting.gets <= 20
    assert gc.isenabled()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_vbyte_round_trip(values):
    ids = np.array(values, dtype="<u4")
    control, data = token_file.vbyte_encode(ids)
    assert token_file.vbyte_decode(control, data, len(ids)).tolist() == values
    assert len(control) == -(-len(ids) // 4)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_vbyte_round_trip_of_documents(docs):
    parts = [token_file.vbyte_encode(np.array(x, dtype="<u4")) for x in docs]
    got = token_file.vbyte_decode(b"".join(c for c, _ in parts), b"".join(d for _, d in parts), *map(len, docs))
    assert got.tolist() == sum(docs, [])


@given(st.lists(st.lists(st.sampled_from([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, 2**32 - 1]), max_size=9), max_size=6))
def test_documents_in_a_block_are_coded_as_alone(docs):
    flat = np.array(sum(docs, []), dtype="<u4")
    parts = list(token_file.vbyte_parts(flat, *map(len, docs)))
    assert parts == [token_file.vbyte_encode(np.array(x, dtype="<u4")) for x in docs]
    for (control, data), x in zip(parts, docs):
        size = [max(1, (v.bit_length() + 7) // 8) for v in x]
        assert data == b"".join(v.to_bytes(n, "little") for v, n in zip(x, size))
        assert control == bytes(sum((n - 1) << 2 * k for k, n in enumerate(size[i : i + 4])) for i in range(0, len(x), 4))


@pytest.mark.parametrize("block", [1, 5, 1 << 18])
def test_shards_are_read_in_blocks(tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_file, "BLOCK", block)
    docs = [(7, [1, 2, 300]), (8, []), (9, [4] * 7), (9, [0])]
    token_file.write_shard(f"{tmp_path}/s", 11, [(i, len(x), *token_file.vbyte_encode(np.array(x, dtype="<u4"))) for i, x in docs])
    got = [(i, before, x.tolist()) for i, before, x in token_file.read_shard(f"{tmp_path}/s", np.arange(400, dtype="<u4"))]
    assert got == [(7, 11, [1, 2, 300]), (8, 14, []), (9, 14, [4] * 7), (9, 21, [0])]


def test_files_round_trip(odd, library):
    got = sorted([tuple(r) for r in token_file.token_file_digests(odd.repartition(3), BPE).collect()], key=lambda r: r[1])
    rows = sorted([(r.doc_id, r.text or "") for r in odd.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(none):
    assert token_file.token_file_digests(none, BPE).count() == 0
    assert sp_tokenizers.encode_digests(none, PIECES).count() == 0


def test_damaged_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"nope" + bytes(40))
    with pytest.raises(ValueError, match="token file"):
        list(token_file.read_shard(f"{tmp_path}/x", np.zeros(1, "<u4")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(HARD), st.text(alphabet="ab ▁é\n<0x>1🏽", max_size=25)), max_size=4))
def test_parity_with_the_reference_library(texts):
    codec = sp_tokenizers.codec(PIECES)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert ids == codec.reference.encode(texts, num_threads=1)
    assert [codec.decode(np.array(x)) for x in ids] == [codec.reference.decode(x) for x in ids]


def test_decode_gives_texts_back(spark, odd):
    got = {r.doc_id: r.text for r in sp_tokenizers.decode(sp_tokenizers.encode(odd, PIECES), PIECES).collect()}
    for r in odd.collect():
        assert got[r.doc_id] == (r.text or "").replace("▁", " ")


def unigram(tmp_path, fallback=True):
    """A unigram model written out by hand: the type that the public file isn't."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = True
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    rows += [(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else []
    rows += [("▁", -3, 1), ("a", -4, 1), ("b", -4.5, 1), ("c", -5, 1), ("ab", -5.5, 1), ("▁ab", -6, 1), ("bc", -6.25, 1), ("abc", -9, 1)]
    for piece, score, kind in rows:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("text", ["abc ab c", "  aab   bc ", "abé", "", "cab\nab"])
def test_unigram_models(tmp_path, text):
    codec = sp_tokenizers.Codec(unigram(tmp_path))
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode([text])]
    assert ids == codec.reference.encode([text])


def test_parity_failures_are_told(tmp_path):
    codec = sp_tokenizers.Codec(PIECES)
    with pytest.raises(ValueError, match="parity"):
        codec._check(["abc"], [[1, 2, 3]])
