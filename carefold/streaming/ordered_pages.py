"""Points in order of time, kept in small pages whose summaries add up.

A page holds at most ``PAGE`` points, or the places of at most ``PAGE`` pages below it, each with the first key and the
summary of what lies there. Taking in a point reads and writes the pages on the way to its neighbours, one per level, so
the state touched by an arrival is (PAGE x levels) whether a series has ten points or ten million, and whether its points
come in order, late, or all with one time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

#: Entries of a page at most.
PAGE = 32
#: Points at the end of a series that its trend needs.
TAIL = 3
ROOT = 0


class Point(NamedTuple):
    """``ts`` in microseconds. Points are ordered by ``ts, ord, entity_id``."""

    ts: int
    ord: int
    entity_id: str
    value: float
    low: float | None
    high: float | None
    unit: str | None
    confidence: float

    @property
    def key(self) -> tuple[int, int, str]:
        return self[:3]


class Summary(NamedTuple):
    """Of consecutive points: their number, sum of confidences, first and last ones, longest gap (microseconds), crossings."""

    points: int
    confidence: float
    first: Point
    tail: tuple[Point, ...]
    gap: int | None
    crossings: int


def inside(value: float, point: Point) -> bool:
    """Whether a value lies in the range of ``point``; a missing bound is no bound."""
    return not ((point.low is not None and value < point.low) or (point.high is not None and value > point.high))


def of_point(point: Point) -> Summary:
    return Summary(1, point.confidence, point, (point,), None, 0)


def joined(a: Summary, b: Summary) -> Summary:
    """The summary of a's points followed by b's."""
    last = a.tail[-1]
    step = b.first.ts - last.ts
    return Summary(
        a.points + b.points,
        a.confidence + b.confidence,
        a.first,
        (a.tail + b.tail)[-TAIL:],
        max(x for x in (a.gap, b.gap, step) if x is not None),
        a.crossings + b.crossings + (inside(last.value, b.first) != inside(b.first.value, b.first)),
    )


class Entry(NamedTuple):
    """A page below: its number, the first key it may hold, and the summary of its points."""

    page: int
    key: tuple[int, int, str]
    summary: Summary


class OrderedPages:
    """The pages of one series, over a store that reads and writes a page's text by its number.

    Pages are held while a batch of arrivals is taken in and written once by :meth:`flush`.
    """

    def __init__(self, read: Callable[[int], str | None], write: Callable[[int, str], None], drop: Callable[[int], None]):
        self._read, self._write, self._drop = read, write, drop
        self._held: dict[int, list] = {}
        self._changed: set[int] = set()
        self.pages_read = 0

    # ------------------------------------------------------------------ pages
    def _page(self, number: int) -> list:
        """``[is_leaf, next free number (root only), entries]``."""
        if number not in self._held:
            self.pages_read += 1
            text = self._read(number)
            self._held[number] = [True, ROOT + 1, []] if text is None else _parsed(text)
        return self._held[number]

    def _new(self, leaf: bool, entries: list) -> int:
        root = self._page(ROOT)
        number, root[1] = root[1], root[1] + 1
        self._held[number] = [leaf, 0, entries]
        self._changed |= {ROOT, number}
        return number

    def flush(self) -> None:
        for number in self._changed:
            page = self._held.get(number)
            if page is None:
                self._drop(number)
            else:
                self._write(number, json.dumps(page))
        self._changed.clear()

    # ------------------------------------------------------------------ summaries
    def _summary(self, number: int) -> Summary | None:
        leaf, _, entries = self._page(number)
        total = None
        for entry in entries:
            part = of_point(entry) if leaf else entry.summary
            total = part if total is None else joined(total, part)
        return total

    def summary(self) -> Summary | None:
        """Of all points; reads the root alone."""
        return self._summary(ROOT)

    def root_points(self) -> list[Point] | None:
        """All points while the root page holds them itself, else None."""
        leaf, _, entries = self._page(ROOT)
        return entries if leaf else None

    # ------------------------------------------------------------------ changes
    def put(self, point: Point) -> None:
        """Takes in a point; one of the same key is replaced."""
        self._change(point.key, point)

    def remove(self, key: tuple[int, int, str]) -> None:
        self._change(key, None)

    def _change(self, key: tuple[int, int, str], point: Point | None) -> None:
        path, number = [], ROOT
        while not self._page(number)[0]:
            entries = self._page(number)[2]
            at = max(_upper(entries, key) - 1, 0)
            path.append((number, at))
            number = entries[at].page
        entries = self._page(number)[2]
        at = _upper(entries, key)
        there = at > 0 and entries[at - 1].key == key
        if there:
            entries[at - 1 : at] = [] if point is None else [point]
        elif point is not None:
            entries.insert(at, point)
        self._changed.add(number)
        self._settle(number, path)

    def _settle(self, number: int, path: list[tuple[int, int]]) -> None:
        """Splits full pages, drops empty ones, and brings the summaries above up to date."""
        leaf, _, entries = self._page(number)
        if not path:
            if len(entries) > PAGE:
                half = len(entries) // 2
                parts = [(entries[0].key, self._new(leaf, entries[:half])), (entries[half].key, self._new(leaf, entries[half:]))]
                root = self._page(ROOT)
                root[0], root[2] = False, [Entry(n, key, self._summary(n)) for key, n in parts]
            elif not entries:
                self._page(ROOT)[0] = True
            self._changed.add(ROOT)
            return
        parent, at = path[-1]
        above = self._page(parent)[2]
        if not entries:
            del above[at]
            self._held[number] = None
            self._changed.add(number)
        elif len(entries) > PAGE:
            half = len(entries) // 2
            key, upper = entries[half].key, self._new(leaf, entries[half:])
            del entries[half:]
            above[at : at + 1] = [Entry(number, above[at].key, self._summary(number)), Entry(upper, key, self._summary(upper))]
        else:
            above[at] = Entry(number, above[at].key, self._summary(number))
        self._changed.add(parent)
        self._settle(parent, path[:-1])


def _upper(entries: list, key: tuple[int, int, str]) -> int:
    """How many entries have a key up to ``key``."""
    low, high = 0, len(entries)
    while low < high:
        middle = (low + high) // 2
        if entries[middle].key <= key:
            low = middle + 1
        else:
            high = middle
    return low


def _parsed(text: str) -> list:
    leaf, free, entries = json.loads(text)
    if leaf:
        return [leaf, free, [Point(*e) for e in entries]]
    return [leaf, free, [Entry(n, tuple(key), _summary_of(s)) for n, key, s in entries]]


def _summary_of(fields: list) -> Summary:
    points, confidence, first, tail, gap, crossings = fields
    return Summary(points, confidence, Point(*first), tuple(Point(*p) for p in tail), gap, crossings)
