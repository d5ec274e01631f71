"""Fill-in-the-middle rewriting against a plain version over code points."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.llm import fim

SCHEMA = "doc_id long, text string, n int, output string"


def by_hand(key, text, rate=100):
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 50
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", len(prefix), len(middle), output


def chunked(text, cache):
    data = text.encode()
    places = fim.chunk_places(np.frombuffer(data, np.uint8))
    return data, fim.Chunked(data, fim.chunk_edges(0, len(data), places), cache)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \né日😀<PSM>\r ", max_size=60), st.integers(1, 40))
def test_counts_of_chunks_are_those_of_the_text(part, times):
    text = part * times
    data, found = chunked(text, fim.ChunkCache(1000))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert found.units == len(units) and found.chars[-1] == len(text)
    assert found.marked == any(m in text for m in ("<P>", "<S>", "<M>"))
    for k in {0, len(units) // 3, len(units)}:
        head = "".join(units[:k])
        assert found.end_of(k) == (len(head.encode()), len(head))


def test_a_mark_over_the_edge_of_two_chunks_is_seen():
    plain = "x" * 3 * fim.MOST
    for at in range(fim.MOST - 4, fim.MOST + 4):
        text = plain[:at] + "<S>" + plain[at:]
        data = text.encode()
        edges = [0, fim.MOST, 2 * fim.MOST, len(data)]
        assert fim.Chunked(data, edges, fim.ChunkCache()).marked


def test_shared_passages_share_chunks():
    draw = random.Random(1)
    passage = "".join(draw.choice("abcdefgh \n") for _ in range(60_000))
    cache = fim.ChunkCache()
    chunked(passage, cache)
    before = cache.hits
    _, second = chunked("".join(draw.choice("xyz\n") for _ in range(777)) + passage, cache)
    assert cache.hits - before > 0.9 * (len(second.parts) - 3)


def test_rows_against_the_plain_version(spark):
    draw = random.Random(2)
    texts = [
        None, "", "\n", "\n\n\n", "one line", "one\n", "a\nb", "a<P>b", "x<\nS>", "<", "<P", "\r\n\r", "é\n日本\n😀\n", "same\ntext", "same\ntext",
        "long line " * 30_000, "a\n" * 50_000, "".join(draw.choice("ab\n é日") for _ in range(200_000)),
    ]
    rows = [(i, t, -1, "clash") for i, t in enumerate(texts)] + [(None, "no\nid\n", 0, ""), (-3, "a\nb\nc", 0, ""), (3, "twice\n", 0, ""), (3, "twice\n", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = fim.rewrite(docs).select("*", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("back")).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found))) == sorted(
        str((key, *by_hand(key, text or ""))) for key, text, *_ in rows
    )
    wanted = sorted((str(key), text or "") for key, text, *_ in rows)
    assert sorted((str(r.doc_id), r.back) for r in found) == wanted
    forms = {r.form for r in fim.rewrite(docs, rate=0).collect()}
    assert forms == {"plain"} and fim.digests(docs.limit(0)).collect() == []


def test_digests(spark):
    docs = spark.createDataFrame([(i, "line\n" * i) for i in range(60)], "doc_id long, text string")
    for r in fim.digests(docs).collect():
        n, form, prefix, middle, output = by_hand(r.doc_id, "line\n" * r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(b"line\n" * r.doc_id).hexdigest()


def test_a_slice_of_a_batch_is_read_from_its_own_place():
    array = pa.array(["abc", "de", "f"]).slice(1)
    assert pa.concat_arrays([array]).offset == 0
