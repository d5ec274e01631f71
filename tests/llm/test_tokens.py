"""Encoding, decoding and the id files, against the whole-text encoders of the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from carefold.llm import bitplanes, bpe

REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
WHOLE = Tokenizer.from_file(bitplanes.TOKENIZER)
WHOLE.encode_special_tokens = True
TEXTS = [
    None, "", " ", "  ", "a  b", "a   b ", "\n\n a \n b", "x  y  z", "naïve 日本語 👩‍👩‍👧 ", "<|endoftext|> it's 12 3",
    "\x1c a \x85 ", "word " * 30_000, "é É", "same text", "same text",
]
SCHEMA = "doc_id long, text string, ids string, begin int"


def lists(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\ta.'s1é 日\x1c\x85", max_size=40), min_size=1, max_size=20))
def test_pieces_encode_like_whole_texts(texts):
    assert lists(bpe.Encoder.of(bpe.RANKS), texts) == [REFERENCE.encode_ordinary(t) for t in texts]
    assert lists(bpe.Encoder.of(bitplanes.TOKENIZER), texts) == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_small_cache_changes_nothing():
    encoder = bpe.Encoder(bpe.build_tokenizer(bpe.load_ranks()))
    encoder.pieces = bpe.PieceCache(6)
    draw = random.Random(3)
    for _ in range(6):
        texts = [" ".join("".join(draw.choice("abcdé") for _ in range(draw.randint(0, 12))) for _ in range(40)) for _ in range(30)]
        assert lists(encoder, texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    for row in bpe.encode(docs, decoded=True).collect():
        text = TEXTS[row.doc_id] or ""
        assert row.ids == REFERENCE.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.digests(docs.limit(0)).collect() == []


def test_query_columns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for row in bpe.digests(docs).collect():
        ids = REFERENCE.encode_ordinary(TEXTS[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((TEXTS[row.doc_id] or "").encode()).hexdigest()


def test_offsets_cover_the_text(spark):
    texts = [t for t in TEXTS if t and len(t) < 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decoder = bpe.Decoder.of(bpe.RANKS)
    for row in bpe.encode(docs, offsets=True).collect():
        text = texts[row.doc_id]
        assert row.ids == REFERENCE.encode_ordinary(text)
        for number, begin, end in zip(row.ids, row.begins, row.ends, strict=True):
            piece = decoder.tokens[number]
            whole = text[begin:end].encode()
            assert piece in whole and (piece == whole or end - begin == 1 or b"\xef\xbf\xbd" in piece.decode("utf-8", "replace").encode())


def test_split_characters_come_whole():
    decoder = bpe.Decoder.of(bpe.RANKS)
    ids = REFERENCE.encode_ordinary("a 👩‍👩‍👧 é日")
    pieces = list(bpe.decode_stream(decoder.tokens[i] for i in ids))
    assert "".join(pieces) == "a 👩‍👩‍👧 é日" and "�" not in "".join(pieces)


@pytest.mark.parametrize("bits", [False, True])
@settings(max_examples=40, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_planes_round_trip(bits, ids):
    made = np.array(ids, "<u4")
    assert bitplanes.from_planes(bitplanes.to_planes(made, bits), len(made), bits).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_files_read_by_chunk_and_document(tmp_path, bits):
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 700, 3, 1500, 0)]
    with fs.LocalFileSystem().open_output_stream(f"{tmp_path}/a") as sink:
        writer = bitplanes.Writer(sink, bits, block=256)
        writer.add([5, None, 7], np.array([0, 1, 700]), np.concatenate(docs[:3]))
        writer.add([8, 9, 10], np.array([3, 1500, 0]), np.concatenate(docs[3:]))
        assert writer.close() == 2204
    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/a") as source:
        reader = bitplanes.Reader(source)
        assert len(reader.footer["chunks"]) == 9
        assert reader.chunk(3).tolist() == np.concatenate(docs)[768:1024].tolist()
        got = [(key, count, [int(x) for part in parts for x in part]) for key, count, parts in reader.documents()]
    assert got == [(k, len(d), d.tolist()) for k, d in zip([5, None, 7, 8, 9, 10], docs, strict=True)]


def test_round_trip_in_order(spark):
    rows = [(i * 7 % 15, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(bitplanes.round_trip(docs).collect(), key=lambda r: r.start)
    want, before = {}, 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    for row in got:
        assert row.start == before
        before += row.n_tokens
    for key, text in rows:
        ids = np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for key, made in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == key) == sorted(made)
    assert bitplanes.round_trip(docs.limit(0)).collect() == []


def thue_morse(a, b, bits):
    """A sequence and its complement, which polynomials modulo a power of two cannot tell apart."""
    ones = [bin(k).count("1") % 2 for k in range(1 << bits)]
    return [b if x else a for x in ones], [a if x else b for x in ones]


def test_sequences_that_collide_in_a_polynomial_have_ids_of_their_own():
    for head in ("", "same head"):
        first, second = ("".join(x) for x in thue_morse("a", "b", 11))
        for path, reference in ((bpe.RANKS, REFERENCE.encode_ordinary), (bitplanes.TOKENIZER, lambda t: WHOLE.encode(t, add_special_tokens=False).ids)):
            encoder = bpe.Encoder(bpe.build_tokenizer(bpe.load_ranks())) if path == bpe.RANKS else bpe.Encoder(Tokenizer.from_file(path), own_split=True)
            for text in (first, second):
                assert lists(encoder, [f"x {head}{text}"]) == [reference(f"x {head}{text}")]


def test_digests_tell_orders_lengths_and_salts_apart():
    from carefold.llm.words import digest_groups, digest_spans

    first, second = thue_morse(3, 5, 10)
    values = np.array(first + second, np.uint64)
    begins, ends = np.array([0, 1024]), np.array([1024, 2048])
    for salt in (1, 2):
        a, b = digest_groups(values, begins, ends, salt)
        assert a != b
    data = np.frombuffer(b"aaaaaaaabbbbbbbb" + b"bbbbbbbbaaaaaaaa" + b"ab\0" + b"ab" + b"", np.uint8)
    starts, stops = np.array([0, 16, 32, 35, 37]), np.array([16, 32, 35, 37, 37])
    assert len(set(digest_spans(data, starts, stops, 1).tolist() + digest_spans(data, starts, stops, 2).tolist())) == 9  # the empty span has one digest
    again = np.frombuffer(b"zab", np.uint8)
    assert digest_spans(again, np.array([1]), np.array([3]), 1)[0] == digest_spans(data, starts, stops, 1)[3]
    assert digest_spans(data, starts[:0], stops[:0], 1).tolist() == []
