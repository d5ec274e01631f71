"""Texts as rows of atoms in numpy arrays, and sets of atom sequences in bitmaps of a fixed size.

An atom is a run of ASCII letters and digits, or any other single character that is no ASCII white space, in lower case. Where a phrase must not touch letters
or digits at either end, its places in a text begin and end at atoms, so phrases are found atom by atom.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Atoms:
    """All atoms of some texts: the text each is in, its begin and end in code points, and 64 hash bits."""

    def __init__(self, texts: pa.Array):
        closed = pc.binary_join_element_wise(pc.utf8_lower(texts), "\n", "").cast(pa.large_string())
        offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + len(closed) + 1]
        held = closed.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        alnum, wide = _ALNUM[data], data >= 0x80
        more = wide & (data < 0xC0)
        single = ~alnum & ~wide & ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:] = alnum[:-1]
        opening = (alnum & ~before) | single | (wide & ~more)
        after[:-1] = alnum[1:]
        follows = np.zeros(len(data), bool)
        follows[:-1] = more[1:]
        closing = (alnum & ~after) | single | (wide & ~follows)
        starts, ends = np.flatnonzero(opening), np.flatnonzero(closing) + 1
        self.text = np.searchsorted(offsets, starts, "right") - 1
        points = np.concatenate([[0], np.cumsum(~more)])
        base = points[offsets[:-1]][self.text] if len(starts) else np.zeros(0, np.int64)
        self.begin, self.end = points[starts] - base, points[ends] - base
        # letters and digits just outside an atom: only a single character can touch them
        self.touched_before = before[starts]
        self.touched_after = np.zeros(len(starts), bool)
        inner = ends < len(data)
        self.touched_after[inner] = alnum[ends[inner]]
        self.hash = _hashes(data, starts, ends)

    def __len__(self) -> int:
        return len(self.text)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of mixed blocks of 8 bytes, each with its place in the atom."""
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    if not len(sizes):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    first = np.cumsum(counts) - counts
    inside = np.arange(counts.sum()) - np.repeat(first, counts)
    blocks = view[np.repeat(starts, counts) + 8 * inside]
    blocks[first + counts - 1] &= ~np.uint64(0) >> (np.uint64(8) * ((-sizes) % 8).astype(np.uint64))
    mixed = _mixed(_mixed(inside.astype(np.uint64) * _ODD + np.uint64(1)) ^ blocks)
    return _mixed(np.add.reduceat(mixed, first) + sizes.astype(np.uint64))


def chained(chain: np.ndarray, hashes: np.ndarray, number: int) -> np.ndarray:
    """The hash of a sequence with one atom more."""
    return _mixed(chain * _ODD + hashes + np.uint64(number + 1))


def prefixes(atoms: Atoms, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings of each text, atom by atom, and of each whole text that has an atom."""
    count = np.bincount(atoms.text, minlength=texts)
    first = np.cumsum(count) - count
    live = np.flatnonzero(count)
    chain, found, whole = np.zeros(len(live), np.uint64), [], []
    number = 0
    while len(live):
        chain = chained(chain, atoms.hash[first[live] + number], number)
        found.append(chain)
        number += 1
        done = count[live] == number
        whole.append(chain[done])
        live, chain = live[~done], chain[~done]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(found or empty), np.concatenate(whole or empty)


class PhraseSet:
    """Bitmaps of a fixed size over the beginnings and the wholes of phrases, however many there are.

    A bit set by another phrase lets a candidate pass that is none; none that is a phrase is missed. With n phrases of w
    atoms in 2^b bits about n * w / 2^b of all places go on from one atom to the next by chance.
    """

    def __init__(self, beginnings: np.ndarray, wholes: np.ndarray, bits: int):
        self.beginnings, self.wholes, self.bits = beginnings, wholes, bits

    @staticmethod
    def words(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of the bitmap, and the bits in them, that these hashes set."""
        place = hashes >> np.uint64(64 - bits)
        word, which = np.unique((place >> np.uint64(6)).astype(np.int64), return_inverse=True)
        bits_of = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits_of, which, np.uint64(1) << (place & np.uint64(63)))
        return word, bits_of

    def _holds(self, bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def candidates(self, atoms: Atoms) -> tuple[np.ndarray, np.ndarray]:
        """First and last atom of every place that may be a phrase, letters and digits not touching it."""
        live, chain = np.arange(len(atoms)), np.zeros(len(atoms), np.uint64)
        live, chain = live[~atoms.touched_before], chain[~atoms.touched_before]
        first, last, number = [], [], 0
        while len(live):
            chain = chained(chain, atoms.hash[live + number], number)
            go = self._holds(self.beginnings, chain)
            live, chain = live[go], chain[go]
            hit = self._holds(self.wholes, chain) & ~atoms.touched_after[live + number]
            first.append(live[hit])
            last.append(live[hit] + number)
            number += 1
            inside = live + number < len(atoms)
            live, chain = live[inside], chain[inside]
            same = atoms.text[live + number] == atoms.text[live]
            live, chain = live[same], chain[same]
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(first or empty), np.concatenate(last or empty)
