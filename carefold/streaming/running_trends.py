"""Running trends over a stream of observations.

State is kept per (block of patients, code, slice), a slice being a fixed span of time, so a
series with very many points is many keys. Within a slice, points lie in ordered
pages (see :mod:`carefold.streaming.ordered_pages`): an arrival, late or not, touches
the pages next to it, never the whole slice. Each micro-batch gives the slice rows
it changed; ``stitch_slices`` turns the latest slice rows of a series into its trend,
just as it does for batch slices.

With ``lateness`` the stream has a watermark. When it passes the end of a slice, a
timer clears the slice's state: the row given last stands, and points that come
later than that are left out, as are repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from carefold.streaming import ordered_pages

SLICE_ROW = (
    "patient_id long, code string, slice int, points long, confidence_sum double, "
    "first_point struct<ts:timestamp,ord:int,entity_id:string,value:double,low:double,high:double,unit:string>, "
    "tail array<struct<ts:timestamp,ord:int,entity_id:string,value:double,low:double,high:double,unit:string>>, "
    "max_gap double, crossings long"
)
DAY_MICROS = 86_400_000_000
#: A block is 16 neighbouring patients; their state is read and written together.
BLOCK_BITS = 4


def slice_of(ts, days: int):
    """Number of the time span a point falls into."""
    return F.floor(F.unix_micros(ts) / (days * DAY_MICROS)).cast("int")


def slice_updates(observations: DataFrame, days: int = 30, lateness: str | None = None) -> DataFrame:
    """A stream of changed slice rows, in update mode.

    ``lateness`` is how far a point may lag behind the latest one seen, such as ``"10 days"``; without it no state ends.
    A point is known by its entity id: one that comes again replaces the one before. Rows without a patient, code, id,
    time or value are no points and are left out; a null confidence counts as 0, a null ``ord`` as 0.
    """
    named = observations.select(
        "patient_id", "code", "entity_id", "ts", "ord", "value", "low", "high", "unit", "confidence",
    ).filter("patient_id IS NOT NULL AND code IS NOT NULL AND entity_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    if lateness is not None:
        named = named.withWatermark("ts", lateness)
    keyed = named.withColumn("slice", slice_of(F.col("ts"), days)).withColumn("micros", F.unix_micros("ts"))
    return keyed.withColumn("block", F.shiftright("patient_id", BLOCK_BITS)).groupBy("block", "code", "slice").transformWithState(
        statefulProcessor=SliceState(days, lateness is not None),
        outputStructType=SLICE_ROW,
        outputMode="Update",
        timeMode="None" if lateness is None else "EventTime",
    )


class SliceState(StatefulProcessor):
    """One slice of a code for a block of patients.

    The root pages of all series of a block are one value, read and written once for each micro-batch that has points of the
    block: most series have no other page. Pages below a root, and the place of each entity id of such a series, are entries
    of their own.
    """

    def __init__(self, days: int, expires: bool):
        self.days, self.expires = days, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.roots = handle.getValueState("roots", "text string")
        self.pages = handle.getMapState("pages", "patient_id long, page long", "text string")
        self.keys = handle.getMapState("keys", "patient_id long, entity_id string", "ts long, ord int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = (int(key[2]) + 1) * self.days * DAY_MICROS // 1000
        if self.expires and timerValues.getCurrentWatermarkInMs() >= end:
            return
        before = self.roots.get()
        if self.expires and before is None:
            self.handle.registerTimer(end)
        # a line for each patient
        roots = {} if before is None else {int(n): text for n, text in (line.split(" ", 1) for line in before[0].split("\n"))}
        series: dict[int, _Series] = {}
        for r in rows:
            patient = int(r.patient_id)
            if patient not in series:
                series[patient] = _Series(self, patient, roots)
            series[patient].take(ordered_pages.Point(
                int(r.micros), int(_given(r.ord) or 0), r.entity_id, float(r.value),
                _given(r.low), _given(r.high), r.unit, float(_given(r.confidence) or 0.0),
            ))
        for one in series.values():
            one.flush()
        self.roots.update(("\n".join(f"{n} {text}" for n, text in roots.items()),))
        for patient, one in series.items():
            total = one.held.summary()
            yield Row(
                patient_id=patient, code=key[1], slice=key[2], points=total.points, confidence_sum=total.confidence,
                first_point=_row(total.first), tail=[_row(p) for p in total.tail],
                max_gap=None if total.gap is None else total.gap / DAY_MICROS, crossings=total.crossings,
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.roots.clear()
        self.pages.clear()
        self.keys.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Series:
    """One series while a micro-batch is taken in."""

    def __init__(self, state: SliceState, patient: int, roots: dict[int, str]):
        self.state, self.patient, self.roots = state, patient, roots
        self.held = ordered_pages.OrderedPages(self._read, self._write, lambda number: state.pages.removeKey((patient, number)))
        # while the root holds all points, it says itself where an entity id lies
        small = self.held.root_points()
        self.listed = small is None
        self.known = {} if small is None else {p.entity_id: (p.ts, p.ord) for p in small}

    def _read(self, number: int) -> str | None:
        if number == ordered_pages.ROOT:
            return self.roots.get(self.patient)
        found = self.state.pages.getValue((self.patient, number))
        return None if found is None else found[0]

    def _write(self, number: int, text: str) -> None:
        if number == ordered_pages.ROOT:
            self.roots[self.patient] = text
        else:
            self.state.pages.updateValue((self.patient, number), (text,))

    def take(self, point: ordered_pages.Point) -> None:
        place = self.known.get(point.entity_id)
        if place is None and self.listed:
            place = self.state.keys.getValue((self.patient, point.entity_id))
        if place is not None:
            self.held.remove((int(place[0]), int(place[1]), point.entity_id))
        self.held.put(point)
        self.known[point.entity_id] = (point.ts, point.ord)

    def flush(self) -> None:
        if self.held.root_points() is None:
            for entity_id, place in self.known.items():
                self.state.keys.updateValue((self.patient, entity_id), place)
        self.held.flush()


def _given(value):
    return None if value is None or value != value else float(value)


def _row(p: ordered_pages.Point) -> dict:
    at = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=p.ts)
    return dict(ts=at, ord=p.ord, entity_id=p.entity_id, value=p.value, low=p.low, high=p.high, unit=p.unit)


def latest_slices(updates: DataFrame) -> DataFrame:
    """The newest row of each slice from a table of updates with ``batch_id``."""
    keys = ["patient_id", "code", "slice"]
    fields = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.col("batch_id")).alias("r")
    ).select(*keys, "r.*")
