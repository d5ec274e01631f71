"""Words of a slice of texts as numpy arrays: places, documents and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_ALPHA = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])

#: Bytes that belong to a word, by kind: no white space; letters and digits; letters. Bytes beyond ASCII are letters.
NOT_SPACE, ALNUM, ALPHA = ~_SPACE, _ALNUM, _ALPHA

#: ASCII letters in lower case; every byte keeps its place.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STATE: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("up", ())) < n:
        base = _BASE | 1
        _STATE["up"] = np.cumprod(np.full(n, base, np.uint64))
        _STATE["down"] = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    return _STATE["up"], _STATE["down"]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans begin in ascending order. Worked on by segments of about 1 MB.

    A polynomial over bytes: good for features and candidates, which are counted or checked again. Texts built for it collide;
    what is taken for equal by its hash alone goes by ``digest_spans`` and ``digest_groups``.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + _SEGMENT, "right")))
        piece = data[origin : max(ends[to - 1], ends[at])]
        up, down = _powers(max(_SEGMENT, len(piece)) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=sums[1:])
        begin, end = starts[at:to] - origin, ends[at:to] - origin
        out[at:to] = (sums[end] - sums[begin]) * down[begin]
        at = to
    return mix64(out + np.uint64(salt))


def _summed(mixed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive groups of so many values; a group may be empty."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(mixed, (np.cumsum(counts) - counts)[some])
    return out


def digest_groups(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each group values[begin:end]: every value is mixed with its place and the salt before it is added.

    Unlike a polynomial over the values, no order of two of them collides by its form, and groups equal under one salt
    need not be so under another: two salts give 128 bits.
    """
    counts = (ends - begins).astype(np.int64)
    places = _places(begins, counts)
    inside = (places - np.repeat(begins, counts)).astype(np.uint64)
    mixed = mix64(mix64(inside * np.uint64(_BASE) + np.uint64((salt * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF)) ^ values[places].astype(np.uint64))
    return mix64(_summed(mixed, counts) + counts.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def digest_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each span of bytes, from blocks of 8 bytes, the last one filled with zeros, and the length."""
    sizes = (ends - starts).astype(np.int64)
    counts = (sizes + 7) >> 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    blocks = view[np.repeat(starts, counts) + 8 * inside]
    last = (np.cumsum(counts) - 1)[sizes > 0]
    blocks[last] &= ~np.uint64(0) >> (np.uint64(8) * ((-sizes[sizes > 0]) % 8).astype(np.uint64))
    seed = np.uint64((salt * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF)
    mixed = mix64(mix64(inside.astype(np.uint64) * np.uint64(_BASE) + seed) ^ blocks)
    return mix64(_summed(mixed, counts) + sizes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


class Words:
    """The words of a slice: ``starts``, ``ends`` (bytes), ``doc`` (row) and ``first`` (first word of each row, n+1)."""

    def __init__(self, texts: pa.Array, keep: np.ndarray, lower: bool = False):
        if lower:
            texts = pc.utf8_lower(texts)
        self.rows = len(texts)
        closed = pc.binary_join_element_wise(texts, "\n", "").cast(pa.string()) if self.rows else pa.array([], pa.string())
        offsets = np.frombuffer(closed.buffers()[1], np.int32)[closed.offset : closed.offset + self.rows + 1] if self.rows else np.zeros(1, np.int32)
        data = closed.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        inside = keep[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial over scrambled bytes, taken from running sums by segment.

        With ``prefix``, of at most the first so many bytes; such hashes differ from those of whole words.
        """
        last = np.minimum(self.ends, self.starts + prefix) if prefix else self.ends
        return hash_spans(self.bytes, self.starts, last, prefix)

    def exact_ids(self) -> np.ndarray:
        """A number for each word, equal only for equal words of the slice."""
        if not len(self):
            return np.zeros(0, np.int64)
        lengths = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        data = self.bytes[_places(self.starts, lengths)]
        array = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return array.dictionary_encode().indices.to_numpy().astype(np.int64)

    def text(self, at: int) -> str:
        return self.bytes[self.starts[at] : self.ends[at]].tobytes().decode("utf-8", "replace")


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def hash_groups(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each group values[begin:end], from running sums of a polynomial."""
    up, down = _powers(max(_SEGMENT, len(values)) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values + np.uint64(salt)) * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def runs(words: Words, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within one text, and the first word of each window."""
    if len(values) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(words.doc[: len(values) - size + 1] == words.doc[size - 1 :])
    total = np.zeros(len(whole), np.uint64)
    for k in range(size):
        total = mix64(total + values[whole + k].astype(np.uint64) + np.uint64(k + 1))
    return total, whole
