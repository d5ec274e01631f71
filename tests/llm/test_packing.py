"""Packing: whole documents back from the pieces, full sequences, the subset sums against enumeration."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carefold.llm import packing

WHOLE = Tokenizer.from_file(packing.TOKENIZER)
WHOLE.encode_special_tokens = True


def unpadded(length):
    return length == packing.CAPACITY or length & (length - 1) == 0


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x1c\x85 aB.'s1éÉ日Σ<|endoftext|>", max_size=40), min_size=1, max_size=12))
def test_words_encode_like_whole_texts(texts):
    ids, counts = packing.WordEncoder.of(packing.TOKENIZER).encode(pa.array(texts, pa.string()))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_fill_comes_as_close_as_enumeration(counts, room):
    chosen = packing.fill(room, counts, sorted(counts, reverse=True))
    assert all(0 < n <= counts[length] for length, n in chosen)
    sums = {
        sum(length * n for length, n in zip(counts, taken))
        for taken in itertools.product(*(range(c + 1) for c in counts.values()))
    }
    assert sum(length * n for length, n in chosen) == max(s for s in sums if s <= room)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=20))
def test_the_plan_places_every_token_once(histogram):
    steps, n = packing.plan(histogram, 64)
    places = packing.Places(steps)
    length = np.repeat(np.array(list(histogram), np.int64), list(histogram.values()))
    rank = np.concatenate([np.arange(c) for c in histogram.values()] or [np.zeros(0, int)])
    bins, pieces = defaultdict(list), defaultdict(list)
    for which, start, take, sequence, offset in places.of(length, rank):
        for w, a, t, s, o in zip(which, start, take, sequence, offset):
            pieces[w].append((a, t))
            bins[s].append((o, t))
    assert sorted(bins) == list(range(n))
    for w, parts in pieces.items():
        ends = 0
        for a, t in sorted(parts):
            assert a == ends and t > 0
            ends += t
        assert ends == length[w]
    for s, parts in bins.items():
        ends = 0
        for o, t in sorted(parts):
            assert o == ends
            ends += t
        assert ends == 64 or ends & (ends - 1) == 0
    assert len(pieces) == len(length)


def test_one_length_only_and_the_number_of_steps():
    for length in (1, 3000, 4095):
        steps, n = packing.plan({length: 1_000_003})
        assert len(steps) < 3 * packing.CAPACITY
        assert n >= length * 1_000_003 // packing.CAPACITY
    draw = np.random.default_rng(1)
    small, _ = packing.plan(Counter(draw.integers(1, 4096, 20_000).tolist()))
    large, _ = packing.plan({k: 1000 * v for k, v in Counter(draw.integers(1, 4096, 20_000).tolist()).items()})
    assert len(small) < 50_000 and len(large) < 50_000


def test_documents_come_back_from_full_sequences(spark):
    texts = [None, "", " ", "a", "A a", "same text here", "same text here", "word " * 9_000, "é日 " * 5_000, "x" * 30_000]
    texts += ["some words of text number %d " % k * (k % 190) for k in range(400)] + ["copy of a text " * 700] * 150
    rows = [(i, t, -1, "clash") for i, t in enumerate(texts)] + [(None, "no id", 0, ""), (None, "no id", 0, ""), (5, "same id", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, length string").repartition(6)
    pieces = packing.pack(docs).cache()
    found = pieces.collect()
    wanted = Counter((key, tuple(ids_of(text))) for key, text, *_ in rows)
    # equal ids stand for several documents: compare their tokens by start as multisets
    got, sequences = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        got[r.doc_id, r.doc_tokens][r.start].append(tuple(ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (key, ids), times in wanted.items():
        same = [k for k in wanted if k[0] == key and len(k[1]) == len(ids)]
        if len(same) == 1 and times == 1:
            at = 0
            for start, parts in sorted(got[key, len(ids)].items()):
                assert start == at and len(parts) == 1 and parts[0] == ids[at : at + len(parts[0])]
                at += len(parts[0])
            assert at == len(ids)
    assert sum(r.length for r in found) == sum(len(k[1]) * n for k, n in wanted.items())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY and unpadded(end)
    whole = packing.sequences(pieces).collect()
    assert {r.sequence_id for r in whole} == set(sequences)
    assert all(len(r.ids) == 4 * r.length for r in whole)
    assert len({r.sequence_id for r in whole}) == max(sequences) + 1


def test_digests_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    rows = sorted(packing.digests(docs).collect(), key=lambda r: (r.doc_id, r.start))
    crc = {1: ids_of("a b c"), 2: ids_of("")}
    for r in rows:
        part = np.array(crc[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(crc[r.doc_id])
    assert sum(r.length for r in rows) == 5
    assert packing.digests(docs.limit(0)).collect() == []
