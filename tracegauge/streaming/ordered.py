"""Rows of a key in event order, whatever order the micro-batches bring them in.

Arriving rows wait in a state list; an event-time timer wakes them once the watermark has passed the earliest
waiting row. Then all rows before the watermark are final: they are sorted and handed on in pieces, and the rest waits.
What a processor carries from row to row is kept until the key has been idle for ``idle_ms``, by the same timers.

State calls cost more than rows, so they are few: keys share ``SHARDS`` groups, each with one waiting list, one list of
what its keys carry and one timer, and an entry of a list holds up to ``PIECE`` rows, column by column.
A group holds the rows of the allowed lateness and of one micro-batch, which the source bounds by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIECE = 10_000
#: Groups of keys; fixed, because it is part of a checkpoint.
SHARDS = 4096
#: Event time in milliseconds, the first column of every waiting row.
AT = "at_ms"
_SHARD, _NULLS = "shard_", "nulls_"


def _plain(value):
    return None if value is None or value != value else value


def _arrays(kinds: Sequence[str]) -> str:
    return ", ".join(f"c{i} ARRAY<{k}>" for i, k in enumerate(kinds))


def _packed(rows: Sequence[tuple]) -> list[tuple]:
    """List entries of up to ``PIECE`` rows, a list per column."""
    return [tuple(map(list, zip(*rows[lo:lo + PIECE], strict=True))) for lo in range(0, len(rows), PIECE)]


def _unpacked(state) -> Iterator[tuple]:
    if state.exists():
        for entry in state.get():
            yield from zip(*entry, strict=True)


class InOrder(StatefulProcessor):
    """Base of processors that take rows in the order of (at, ``order``); subclasses define ``rows`` over the carried state."""

    def __init__(self, columns: Sequence[tuple[str, str]], order: Sequence[str], carried: str, out: Sequence[str], idle_ms: int | None) -> None:
        self.columns, self.order, self.carried, self.out, self.idle_ms = list(columns), list(order), carried, list(out), idle_ms
        self.key = ("key", "BIGINT")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [self.key[1], "BIGINT"]
        self.waiting = handle.getListState("waiting", _arrays([*kinds, *(t for _, t in self.columns)]))
        self.kept = handle.getListState("kept", _arrays([*kinds, *(c.split()[1] for c in self.carried.split(","))]))

    def _wake(self, at: int, fired: int | None = None) -> None:
        """One timer, at the earliest moment anything has to be done; one that has just fired is none."""
        timers = [t for t in self.handle.listTimers() if t != fired]
        if not timers or min(timers) > at:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _held(self, part: pd.DataFrame) -> list[tuple]:
        """(key, at, columns) of the arriving rows; whole numbers come as 0 where ``_NULLS`` has their bit."""
        kinds = dict([self.key, (AT, "BIGINT"), *self.columns])
        nulls = part[_NULLS].to_numpy()
        lists = []
        for i, (name, kind) in enumerate(kinds.items()):
            values = part[name].tolist()
            if kind != "BIGINT":
                values = list(map(_plain, values))
            elif (nulls >> i & 1).any():
                values = [None if n >> i & 1 else v for v, n in zip(values, nulls, strict=True)]
            lists.append(values)
        return list(zip(*lists, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            held = self._held(part)
            if held:
                self.waiting.appendList(_packed(held))
                low = min(r[1] for r in held)
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = {}, []
        for r in _unpacked(self.waiting):
            due.setdefault(r[0], []).append(r[1:]) if r[1] < now else rest.append(r)
        place = [0, *(1 + [n for n, _ in self.columns].index(c) for c in self.order)]
        kept: dict = {}
        for k, last, *carried in _unpacked(self.kept):
            kept.setdefault(k, (last, []))[1].append(tuple(carried))
        ready = []
        for k, mine in due.items():
            mine.sort(key=lambda r: tuple(r[i] for i in place))
            last, state = kept.pop(k, (None, []))
            for piece in self._pieces(mine, last):
                if self._silent(last, piece[0][0]):
                    state = []
                state, out = self.rows((k,), [r[1:] for r in piece], state)
                last = piece[-1][0]
                ready += out
                if len(ready) >= PIECE:
                    yield pd.DataFrame(ready, columns=self.out)
                    ready = []
            if state:
                kept[k] = last, state
        if ready:
            yield pd.DataFrame(ready, columns=self.out)
        if due:
            self.waiting.put(_packed(rest)) if rest else self.waiting.clear()
        wake = [min(r[1] for r in rest)] if rest else []
        if self.idle_ms is not None:
            expected = {r[0] for r in rest}  # a key with waiting rows is judged when they are due
            kept = {k: v for k, v in kept.items() if k in expected or v[0] + self.idle_ms >= now}
            wake += [last + self.idle_ms for k, (last, _) in kept.items() if k not in expected]
        self.kept.put(_packed([(k, last, *c) for k, (last, state) in kept.items() for c in state])) if kept else self.kept.clear()
        if wake:
            self._wake(min(wake), expiredTimerInfo.getExpiryTimeInMs())

    def _silent(self, before: int | None, at: int) -> bool:
        return self.idle_ms is not None and before is not None and at - before > self.idle_ms

    def _pieces(self, due: list[tuple], last: int | None) -> Iterator[list[tuple]]:
        """The rows in pieces, none of which spans an idle time."""
        lo = 0
        for i, r in enumerate(due):
            if i > lo and (i - lo == PIECE or self._silent(last, r[0])):
                yield due[lo:i]
                lo = i
            last = r[0]
        if lo < len(due):
            yield due[lo:]

    def rows(self, key, rows: list[tuple], state: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(state, output) after the rows, which are in order; the state is a list of tuples."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, t: Column, processor: InOrder, schema: str, late: str) -> DataFrame:
    """The processor's output over ``stream``; ``t`` are seconds, and rows more than ``late`` behind the newest are dropped."""
    processor.key = key, stream.schema[key].dataType.simpleString().upper()
    timed = stream.withColumn("_at", F.timestamp_millis(F.floor(t * 1000).cast("bigint"))).withWatermark("_at", late)
    kinds = dict([processor.key, (AT, "BIGINT"), *processor.columns])
    values = {n: F.unix_millis("_at") if n == AT else F.col(n) for n in kinds}
    # pandas makes whole numbers with nulls floats, so nulls are told apart
    gone = [F.when(v.isNull(), 1 << i).otherwise(0) for i, v in enumerate(values.values())]
    ready = timed.select(
        "_at", F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int").alias(_SHARD), sum(gone[1:], gone[0]).alias(_NULLS),
        *((F.coalesce(v.cast("bigint"), F.lit(0)) if kinds[n] == "BIGINT" else v).alias(n) for n, v in values.items()))
    return ready.groupBy(_SHARD).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
