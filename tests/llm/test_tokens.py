"""Token ids against the libraries on whole texts, and token files against plain encoding."""

import collections
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from huntlake.llm import tokenfile, tokens
from huntlake.session import scratch_path

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b c d", "  a b", " a", "a ", "a b\n c", "a\n b  c d", "x  y z", "　 a b", "\x85 q", "don't we're\x1c ok \x1d a", "<|endoftext|> a <s> b", "ﬁ, é! a1. 12, ²a ²", "日本 語、 x",
       "a\tb\t c", "", " ", "\n", "q ' s 's", "word.) a.. b", "x " * 300 + "y" * 700 + " z", "▁a ▁ b", "a  b", "\x00 a\x00", "é ́ a", "🙂 🙂🙂 x"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


@given(st.text(alphabet="ab  \n\t'sé1.  ▁日", max_size=40) | st.sampled_from(ODD))
@settings(max_examples=300, deadline=None)
def test_ids_of_chunks_are_those_of_whole_texts(text):
    library = Tokenizer.from_file(BYTES) if not hasattr(test_ids_of_chunks_are_those_of_whole_texts, "t") else test_ids_of_chunks_are_those_of_whole_texts.t
    library.encode_special_tokens = True
    test_ids_of_chunks_are_those_of_whole_texts.t = library
    ours = tokens.opened(tokens.ByteLevelIds, BYTES)
    for space in (False, True):
        want = library.encode(" " * space + text, add_special_tokens=False).ids
        assert np.frombuffer(ours.ids(text, space), "<u4").tolist() == want
    assert " ".join(tokens.parts(text, 7)) == text
    pieces = tokens.opened(tokens.PieceIds, PIECES)
    assert np.frombuffer(pieces.ids(text), "<u4").tolist() == pieces.model.encode(text)


def test_no_piece_crosses_into_a_space():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert not [p for p in map(model.id_to_piece, range(model.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_remembered_chunks_are_emptied_by_generation(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHED", 5)
    seen = []
    ids = tokens.ChunkIds(lambda words: (seen.extend(words), [w.encode() for w in words])[1])
    words = [f"w{i % 23}" for i in range(500)]
    for k in range(0, 500, 9):
        assert ids.join(words[k:k + 9]) == "".join(words[k:k + 9]).encode()
    assert len(ids.young) + len(ids.old) < 40 and len(seen) > 23
    assert ids.join([]) == b"" and ids.join(["x" * 100, "x" * 100]) == b"x" * 200 and "x" * 100 not in ids.young


# 13 --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gammaé", "the", "of", "x1", "\n"]
    return [(i, t) for i, t in enumerate(ODD)] + [(200 - i, " ".join(rng.choice(words, 5 * i))) for i in range(60)] + [
        (500, " ".join(rng.choice(words, 40_000))), (7, "again"), (7, "again"), (7, None), (None, "lost"), (None, None), (-3, "below zero"), (-(1 << 63), "least")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, ids string, part long, start long").repartition(5)


def brute(texts, library):
    rows = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        rows.append((i is None, i or 0, zlib.crc32(ids), len(ids) // 4, i))
    out, start = [], 0
    for _, _, crc, n, i in sorted(rows, key=lambda r: r[:4]):
        out.append((i, start, n, crc))
        start += n
    return out


@pytest.mark.parametrize("small", [False, True])
def test_token_files_return_every_document(docs, texts, library, monkeypatch, small):
    if small:  # long documents in parts and frames, several shards a task
        for name, value in (("FRAME_IDS", 64), ("PART_IDS", 100), ("SHARD_IDS", 900)):
            monkeypatch.setattr(tokenfile, name, value)
    got = tokenfile.token_file_round_trip(docs)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(texts, library))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_token_files_of_nothing(docs):
    assert tokenfile.token_file_round_trip(docs.limit(0)).count() == 0


def test_wanted_documents_are_read_alone(spark, docs, texts, library):
    folder = scratch_path(spark, "token-test")
    tokenfile.write_token_files(docs, folder)
    wanted = spark.createDataFrame([(500,), (7,), (-3,), (190,), (190,), (9999,), (None,), (-(1 << 63),)], "doc_id long")
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in tokenfile.fetch_documents(wanted, folder).collect())
    assert got == collections.Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in texts if i in (500, 7, -3, 190, -(1 << 63)))


@pytest.mark.parametrize("wide", [False, True])
def test_shard_frames_checksums_and_seek_table(wide):
    import zstandard

    class Kept(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    out = Kept()
    writer, kind = tokenfile.ShardWriter(out, wide), "<u4" if wide else "<u2"
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(kind) for n in (1, 60_000, 10_000, 200_000, 3, 65_536, 65_537, 0, 9)]
    for i, ids in enumerate(docs):
        for k, at in enumerate(range(0, max(1, len(ids)), 70_000)):
            writer.add(i, ids[at:at + 70_000].tobytes(), k == 0)
    writer.close()
    shard = tokenfile.ShardReader(pa.BufferReader(out.kept), wide)
    assert shard.counts.tolist() == list(map(len, docs))
    for i, ids in enumerate(docs):
        shard.frames_read = 0
        found = np.concatenate([x for _, x in shard.stretches([i])])
        assert np.array_equal(found, ids) and shard.frames_read <= max(1, -(-len(ids) // tokenfile.FRAME_IDS) + 1)
    assert shard.raw[:-1].max() <= tokenfile.FRAME_IDS * shard.width
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.kept), read_across_frames=True).read()  # any zstandard reader reads all frames
    assert plain.startswith(b"".join(x.tobytes() for x in docs))
    broken = bytearray(out.kept)
    broken[-12] ^= 1  # the last checksum of the seek table
    with pytest.raises(ValueError):
        tokenfile.ShardReader(pa.BufferReader(bytes(broken)), wide)
