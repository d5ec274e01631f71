"""Byte-level BPE with the tokenizers library over Arrow batches: ids, character offsets, and decoding to bytes.

The rank file of a vocabulary becomes a ``tokenizers`` BPE model: every byte is written as one printable character
(the usual byte table), and the merge list follows from the ranks. Texts are cut at single spaces before the library
sees them, which never cuts inside a match of the split pattern, and equal pieces are encoded once per worker; this
changes nothing in the result.

Null texts count as empty, an empty text has no ids, repeated and equal rows each get their own result, an empty table
gives an empty table. Control strings such as ``<|endoftext|>`` inside a text are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from carefold.llm import common
from carefold.llm.words import digest_spans

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Matches of the pattern that a worker remembers in each of two generations.
CACHED_MATCHES = 150_000
#: A worker remembers at most 2 to this power pieces, about 40 bytes each.
CACHE_BITS = 21
_WS = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"
#: A space with other white space, or an end of the text, on both sides: a cut there could part one match.
UNSAFE = rf"{_WS} (?:{_WS}|$)|^ (?:{_WS}|$)"
#: Finds a character beyond Latin.
BEYOND = regex.compile("[^\\x00-\\u024f]").search

#: The kind of tasks that keep encoders and decoders.
KEEPS = "byte-bpe"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {}, 256
    for byte in range(256):
        if byte in shown:
            table[byte] = chr(byte)
        else:
            table[byte], free = chr(free), free + 1
    return [table[b] for b in range(256)]


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two or more bytes is merged from: what the lower ranks leave of it."""
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, place = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


def written_vocabulary(ranks: dict[bytes, int]) -> dict[str, int]:
    """The vocabulary with every byte written as its printable character."""
    shown = byte_characters()
    return {"".join(shown[b] for b in token): rank for token, rank in ranks.items()}


def build_tokenizer(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> Tokenizer:
    shown = byte_characters()
    text = lambda token: "".join(shown[b] for b in token)
    tokenizer = Tokenizer(models.BPE(
        vocab=written_vocabulary(ranks),
        merges=[(text(a), text(b)) for a, b in merges_of(ranks)],
    ))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class PieceCache:
    """Ids of pieces already seen, in flat arrays: a slot per hash, overwritten by later pieces of the same slot.

    A hit needs the same 128-bit digest and the same length.
    """

    def __init__(self, bits: int = CACHE_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.limit = 4 << bits
        self.clear()

    def clear(self) -> None:
        slots = int(self.mask) + 1
        self.hash, self.second = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size = np.full(slots, -1, np.int32)
        self.begin, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def keys(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: ends[-1]]
        starts, ends = ends[:-1], ends[1:]
        return digest_spans(data, starts, ends, 1), digest_spans(data, starts, ends, 2), (ends - starts).astype(np.int32)

    def missing(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        slot = keys[0] & self.mask
        return np.flatnonzero((self.hash[slot] != keys[0]) | (self.second[slot] != keys[1]) | (self.size[slot] != keys[2]))

    def put(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(ids) > self.limit:
            self.clear()
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        slot = keys[0] & self.mask
        # of several pieces for one slot the last stays, in every array alike
        slot, last = np.unique(slot[::-1], return_index=True)
        last = len(keys[0]) - 1 - last
        self.hash[slot], self.second[slot], self.size[slot] = keys[0][last], keys[1][last], keys[2][last]
        self.begin[slot] = self.used + (np.cumsum(counts) - counts)[last]
        self.count[slot] = counts[last]
        self.used += len(ids)


class Encoder:
    """Encodes Arrow arrays of texts; every match of the split pattern goes through the library once per worker.

    A text is cut at its single spaces by Arrow. A cut there always lies between two matches of the pattern, so the ids of
    the pieces joined are the ids of the text; texts in which a space stands inside white space are taken whole.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str = public_tokenizers.PATTERN, own_split: bool = False):
        tokenizer.encode_special_tokens = True
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.tokenizer = tokenizer
        #: The same model without its own split, for strings that are one match already.
        self.matches = Tokenizer(tokenizer.model)
        self.matches.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        #: Whether characters beyond Latin are split by the library's own copy of the pattern and its Unicode tables.
        self.own_split = own_split
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces = PieceCache()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder per worker and vocabulary file, built from ranks or read from a tokenizer file."""
        def build() -> "Encoder":
            if path.endswith(".json"):
                return cls(Tokenizer.from_file(path), own_split=True)
            return cls(build_tokenizer(load_ranks(path)))

        return common.kept(KEEPS, f"encoder:{path}", build)

    def _strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any strings in a row and their counts: split by the pattern, unseen matches through the library."""
        whole = [at for at, string in enumerate(strings) if BEYOND(string)] if self.own_split else []
        found = [self.find(string) for string in strings]
        for at in whole:
            found[at] = []
        known = {}
        new = []
        for match in set().union(*found) if found else ():
            ids = self.young.get(match)
            if ids is None and (ids := self.old.get(match)) is None:
                new.append(match)
            else:
                known[match] = ids
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            for match, made in zip(part, self.matches.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[match] = array("I", made.ids).tobytes()
        self.young.update(known)
        if len(self.young) > CACHED_MATCHES:
            self.old, self.young = self.young, {}
        out = [b"".join([known[m] for m in matches]) for matches in found]
        for at in whole:
            out[at] = array("I", self.tokenizer.encode(strings[at], add_special_tokens=False).ids).tobytes()
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row as unsigned 32-bit integers, and how many each text has."""
        rows = len(texts)
        if not rows:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        lists = pc.split_pattern(pc.if_else(unsafe, "", texts), " ")
        first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        opening = pc.if_else(unsafe, texts, names.take(coded.indices.take(pa.array(first))))
        cache = self.pieces
        keys = cache.keys(names)
        missing = cache.missing(keys)
        new_ids, new_counts = self._strings([" " + p for p in names.take(pa.array(missing)).to_pylist()])
        own_ids, own_counts = self._strings(opening.to_pylist())
        slot = keys[0] & cache.mask
        # ids lie in three rows one after the other: those remembered, the new pieces, the openings of texts
        begins = np.concatenate([cache.begin[slot], np.zeros(rows, np.int64)])
        lengths = np.concatenate([cache.count[slot], own_counts]).astype(np.int64)
        begins[missing] = cache.used + np.cumsum(new_counts) - new_counts
        lengths[missing] = new_counts
        begins[len(names) :] = cache.used + len(new_ids) + np.cumsum(own_counts) - own_counts
        pool = np.concatenate([cache.ids[: cache.used], new_ids, own_ids])
        cache.put(tuple(k[missing] for k in keys), new_ids, new_counts)
        index[first] = np.arange(len(names), len(names) + rows)
        counts = lengths[index]
        ends = np.cumsum(counts)
        places = np.repeat(begins[index] - (ends - counts), counts)
        places += np.arange(ends[-1])
        return pool[places], np.add.reduceat(counts, first)

    def encode_with_offsets(self, texts: list[str]) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
        """Ids, and each id's begin and end in code points; ids that share a character share its place."""
        made = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [m.ids for m in made], [m.offsets for m in made]


class Decoder:
    """Puts the bytes of ids together again by the reversed byte table."""

    def __init__(self, path: str):
        shown = {c: b for b, c in enumerate(byte_characters())}
        if path.endswith(".json"):
            vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        else:
            vocabulary = written_vocabulary(load_ranks(path))
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.tokens[number] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()

    @classmethod
    def of(cls, path: str) -> "Decoder":
        return common.kept(KEEPS, f"decoder:{path}", lambda: cls(path))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def lists(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; a null list has none."""
        return pa.array([self.bytes_of(x.values.to_numpy()) if x.is_valid else b"" for x in ids], pa.binary())


def decode_stream(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of a stream of decoded tokens; a character that is split over tokens appears once its last byte is there."""
    import codecs

    held = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        if text := held.decode(piece):
            yield text
    if text := held.decode(b"", True):
        yield text


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))


def encode(
    df: DataFrame, path: str = RANKS, offsets: bool = False, decoded: bool = False, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int) of every whole text.

    With ``offsets`` also ``begins`` and ``ends`` in code points of the text; an id that holds only part of a character has
    the place of the whole character. With ``decoded`` also the bytes that the ids decode to, taken in the same pass.
    Row-local: no shuffle.
    """
    source = common.plain(df, *keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in common.plain(df, *keep).schema)
    schema += ", ids array<int>" + (", begins array<int>, ends array<int>" if offsets else "") + (", decoded binary" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder.of(path), Decoder.of(path) if decoded else None
        for batch in common.slices(batches, text):
            texts = common.text_column(batch, text)
            columns = dict(zip(keep, batch.columns, strict=False))
            if offsets:
                ids, spans = encoder.encode_with_offsets(texts.to_pylist())
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                for side, name in enumerate(("begins", "ends")):
                    columns[name] = pa.array([[s[side] for s in row] for row in spans], pa.list_(pa.int32()))
            else:
                columns["ids"] = id_lists(*encoder.encode(texts))
            if decoder is not None:
                columns["decoded"] = decoder.lists(columns["ids"])
            yield pa.RecordBatch.from_pydict(columns)

    return common.map_arrow(source, run, schema, KEEPS)


def decode(df: DataFrame, path: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` and ``decoded`` (binary): the bytes of ``ids``, whole even where a character is split."""
    source = common.plain(df, *keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder.lists(batch.column(len(keep)))], [*keep, "ids", "decoded"])

    return common.map_arrow(source, run, schema, KEEPS)


def digests(df: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded texts."""
    return encode(df, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
