"""Guard tokens as streaming state that ends with their time to live."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from carefold import settings

#: Blocks of tokens; their state is read and written together. It bounds the tasks that share a stream's work.
BLOCKS = 1024


def live_values(
    lookups: DataFrame, ttl_seconds: int = settings.TOKEN_TTL_SECONDS, scope: tuple[str, ...] = ()
) -> DataFrame:
    """Answers a stream of ``token, value`` rows with what the state knows.

    ``scope`` names the string columns of the record a token belongs to; equal tokens of two records stay apart.

    A row with a value saves it for ``ttl_seconds``; a row without one asks for
    it and gets null once it has expired. Time is the clock of the cluster; ``values_as_of`` goes by the rows' own time.
    """
    keys = (*scope, "token")
    return lookups.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_processor(ttl_seconds * 1000, keys),
        outputStructType=", ".join(f"`{k}` string" for k in (*keys, "value")),
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def _processor(ttl_ms: int, keys: tuple[str, ...]) -> StatefulProcessor:
    class TokenState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.value = handle.getValueState("value", "value string", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for batch in rows:
                for given in batch["value"]:
                    if given is not None:
                        self.value.update((given,))
            known = self.value.get()[0] if self.value.exists() else None
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "value": [known]})

        def close(self) -> None:
            pass

    return TokenState()


def values_as_of(
    events: DataFrame, lateness: str, ttl_seconds: int = settings.TOKEN_TTL_SECONDS, scope: tuple[str, ...] = (), blocks: int | None = BLOCKS
) -> DataFrame:
    """Answers each lookup with the value that its token had at the lookup's own time, in append mode.

    ``events``: the string columns of ``scope``, ``token``, ``event_id`` (long), ``ts`` and ``value``. A row with a value
    saves it at ``ts`` for ``ttl_seconds``; one without a value asks for it. Of several values saved up to the lookup's
    time the last counts, of equal times the one of the larger event id; a value saved at the very time of a lookup is
    known to it, one whose time to live has just ended is not.

    A lookup waits until the watermark (the latest time seen less ``lateness``) has passed its time, so rows may come in any
    order within ``lateness``; later ones are left out. Rows without a token, id or time are left out. Event-time timers
    give the answers and clear values: of those that the watermark has passed only the last is kept, and only while it lives.

    Tokens share their state in ``blocks`` blocks by a hash, so a micro-batch costs a few state calls a block and its rows are
    worked on as columns; None gives each token a state of its own. A stream must keep its number of blocks.
    """
    keys = (*scope, "token")
    given = events.select(*keys, "event_id", "ts", "value").filter("token IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL")
    timed = given.withWatermark("ts", lateness).withColumn("micros", F.unix_micros("ts"))
    if blocks is not None:
        blocked = timed.select(F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int").alias("block"), *keys, "event_id", "ts", "micros", "value")
        return blocked.groupBy("block").transformWithStateInPandas(
            statefulProcessor=BlockState(ttl_seconds * 1_000_000, keys),
            outputStructType=", ".join(f"`{k}` string" for k in keys) + ", event_id long, value string",
            outputMode="Append",
            timeMode="EventTime",
        )
    return timed.groupBy(*keys).transformWithState(
        statefulProcessor=AsOfState(ttl_seconds * 1_000_000, keys),
        outputStructType=", ".join(f"`{k}` string" for k in keys) + ", event_id long, value string",
        outputMode="Append",
        timeMode="EventTime",
    )


class AsOfState(StatefulProcessor):
    """Values and open lookups of one token, by (time, event id); times in microseconds, timers in milliseconds."""

    def __init__(self, ttl: int, keys: tuple[str, ...]):
        self.ttl, self.keys = ttl, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "saved string, asked string")

    def _get(self) -> tuple[list, list]:
        held = self.held.get()
        saved, asked = ("[]", "[]") if held is None else held
        return json.loads(saved), json.loads(asked)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        saved, asked = self._get()
        for r in rows:
            at = int(r.micros)
            if r.value is not None:
                saved.append([at, int(r.event_id), r.value])
                self.handle.registerTimer(-(-(at + self.ttl) // 1000))
            else:
                asked.append([at, int(r.event_id)])
                self.handle.registerTimer(at // 1000 + 1)
        self.held.update((json.dumps(sorted(saved)), json.dumps(sorted(asked))))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        saved, asked = self._get()
        # rows at the watermark itself may still come
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = [a for a in asked if a[0] < passed]
        answers, at, last = [], 0, None
        for time, event in due:
            while at < len(saved) and saved[at][0] <= time:
                last, at = saved[at], at + 1
            answers.append((event, last[2] if last is not None and time - last[0] < self.ttl else None))
        before = sum(s[0] < passed for s in saved)
        kept = [s for s in saved[max(before - 1, 0) :] if s[0] + self.ttl > passed]
        left = asked[len(due) :]
        if kept or left:
            self.held.update((json.dumps(kept), json.dumps(left)))
        else:
            self.held.clear()
        for event, value in answers:
            yield Row(**dict(zip(self.keys, key, strict=True)), event_id=event, value=value)

    def close(self) -> None:
        pass


class BlockState(StatefulProcessor):
    """Values and open lookups of a block of tokens; times in microseconds, timers in milliseconds.

    Rows are appended as they come, as one piece for each micro-batch. There is one timer, at the first time at which something
    is due; when it ends, all that the watermark has passed is answered or cleared and what is left becomes one piece.
    """

    def __init__(self, ttl: int, keys: tuple[str, ...]):
        self.ttl, self.keys = ttl, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind = pa.schema([*((k, pa.string()) for k in self.keys), ("event_id", pa.int64()), ("micros", pa.int64()), ("value", pa.string())])
        given = pa.concat_tables([pa.Table.from_pandas(batch[kind.names], schema=kind, preserve_index=False) for batch in rows])
        self.pieces.appendValue((_packed(given),))
        set_at = self.timer.get()
        first = self._first(given)
        if set_at is None or first < set_at[0]:
            self._set(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, set_at = timerValues.getCurrentWatermarkInMs(), self.timer.get()
        if set_at is None or set_at[0] > now:
            # a timer that an earlier one has replaced
            return
        held = pa.concat_tables([_unpacked(piece[0]) for piece in self.pieces.get()])
        answers, left = as_of(held, self.keys, now * 1000, self.ttl)
        if left.num_rows:
            self.pieces.put([(_packed(left),)])
            self._set(self._first(left))
        else:
            self.pieces.clear()
            self.timer.clear()
        if answers.num_rows:
            yield answers.to_pandas()

    def _first(self, rows: pa.Table) -> int:
        """The first time at which a lookup is due or a value ends."""
        at, saves = rows["micros"].to_numpy(), pc.is_valid(rows["value"]).to_numpy()
        return int(np.where(saves, -(-(at + self.ttl) // 1000), at // 1000 + 1).min())

    def _set(self, at: int) -> None:
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def as_of(rows: pa.Table, keys: tuple[str, ...], passed: int, ttl: int) -> tuple[pa.Table, pa.Table]:
    """The answers to the lookups before ``passed`` (keys, event_id, value), and the rows that later ones need."""
    token = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        codes = pc.dictionary_encode(rows[k].combine_chunks(), null_encoding="encode")
        token = np.unique(token * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    at, saves = rows["micros"].to_numpy(), pc.is_valid(rows["value"]).to_numpy()
    # of equal times a value comes before a lookup, and of values the larger event id last
    order = np.lexsort((rows["event_id"].to_numpy(), ~saves, at, token))
    token, at, saves, place = token[order], at[order], saves[order], np.arange(len(order))
    start = np.maximum.accumulate(np.where(np.r_[True, token[1:] != token[:-1]], place, 0)) if len(order) else place
    last = np.maximum.accumulate(np.where(saves, place, -1))
    known = (last >= start) & (at - at[last] < ttl)
    # rows at the watermark itself may still come
    before = at < passed
    due = before & ~saves
    value = pa.array(np.where(known, order[last], -1)[due], mask=~known[due])
    answers = rows.select([*keys, "event_id"]).take(pa.array(order[due])).append_column("value", rows["value"].take(value))
    # of a token's values before that time only the last may still be asked for
    ends = np.r_[token[1:] != token[:-1], True][: len(order)] | np.r_[~before[1:], True][: len(order)]
    final = np.zeros(len(order), bool)
    final[last[before & ends & (last >= start)]] = True
    kept = np.where(saves, (~before | final) & (at + ttl > passed), ~before)
    return answers, rows.take(pa.array(np.sort(order[kept])))


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(piece: bytes) -> pa.Table:
    with pa.ipc.open_stream(bytes(piece)) as rows:
        return rows.read_all()
