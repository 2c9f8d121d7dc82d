"""Queued messages that go out by themselves: quiet hours, a least gap, and timers.

A message of a recipient is held until the hour is not quiet and the last batch
is long enough ago; then all that wait go out together, at most so many.  The
moment follows from the messages' times alone, not from when they arrive, so
the stream, whose event-time timers release a batch without any further message,
and the batch form give the same batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least seconds between batches, messages of a batch, hours without any, and senders named.
GAP, MOST, QUIET, NAMED = 300.0, 20, (22, 7), 3
SCHEMA = "recipient string, released_at double, n long, first_id long, last_id long, senders string"


def allowed(at: float, zone: str = "UTC", quiet: tuple[int, int] = QUIET) -> float:
    """The first moment from ``at`` on (seconds) whose local hour is not quiet."""
    begin, end = quiet
    local = datetime.fromtimestamp(at, ZoneInfo(zone))
    still = local.hour >= begin or local.hour < end if begin > end else begin <= local.hour < end
    if not still:
        return at
    day = local.date() + timedelta(days=1 if begin > end and local.hour >= begin else 0)
    return datetime(day.year, day.month, day.day, end, tzinfo=ZoneInfo(zone)).timestamp()


def summary(senders: list[str]) -> str:
    """The first few different senders, and how many messages more."""
    different = list(dict.fromkeys(senders))
    more = f" (+{len(senders) - NAMED} more)" if len(different) > NAMED else ""
    return " / ".join(different[:NAMED]) + more


def _row(key: str, due: float, held: list[tuple]) -> tuple:
    return key, due, len(held), held[0][1], held[-1][1], summary([s for _, _, s in held])


def _due(first: float, last: float | None, gap: float, zone: str, quiet: tuple[int, int]) -> float:
    return allowed(first if last is None else max(first, last + gap), zone, quiet)


def batches_of(events: Iterator[tuple], gap: float = GAP, most: int = MOST, zone: str = "UTC", quiet: tuple[int, int] = QUIET) -> Iterator[tuple]:
    """Batches of (key, at, id, sender) sorted by key and time; at most ``most`` messages are held."""
    now, last, due, held = None, None, 0.0, []
    for key, at, number, sender in events:
        if held and (key != now or at > due or len(held) == most):
            yield _row(now, due, held)
            last, held = due, []
        if key != now:
            now, last = key, None
        if not held:
            due = _due(at, last, gap, zone, quiet)
        held.append((at, number, sender))
    if held:
        yield _row(now, due, held)


def _plain(df: DataFrame, key: str, at: str, number: str, sender: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("recipient"), F.col(at).alias("at"), F.col(number).cast("long").alias("id"), F.coalesce(F.col(sender).cast("string"), F.lit("?")).alias("sender"))


def release(df: DataFrame, key: str, at: str, number: str, sender: str, **how) -> DataFrame:
    """The batches of a log of messages; ``at`` is seconds as a double.  One sorted pass: a task holds one batch of messages."""

    def run(found):
        rows = batches_of((r for b in found for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), **how)
        while True:
            part = [r for _, r in zip(range(4096), rows, strict=False)]
            if not part:
                return
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    plain = _plain(df, key, at, number, sender).where("recipient IS NOT NULL AND at IS NOT NULL")
    return plain.repartition("recipient").sortWithinPartitions("recipient", "at", "id").mapInArrow(run, SCHEMA)


def release_stream(df: DataFrame, key: str, at: str, number: str, sender: str, delay: str = "10 minutes", gap: float = GAP, most: int = MOST, zone: str = "UTC", quiet: tuple[int, int] = QUIET) -> DataFrame:
    """The same of a stream, ``at`` being a timestamp: state by recipient, released by event-time timers as the watermark passes.

    Needs the RocksDB state store.  State of a recipient is its waiting messages
    and its last release; the release is forgotten once the gap is over.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Queue(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at double, id long, sender string")
            self.last = handle.getValueState("last", "at double, timer long")

        def _arm(self, waiting: list[tuple], last: float | None) -> None:
            """One timer: the next release, or else the time when the last one is forgotten."""
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            due = _due(waiting[0][0], last, gap, zone, quiet) if waiting else last + gap
            self.handle.registerTimer(int(due * 1000))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            new = [r for pdf in rows for r in zip(pdf["at"].map(lambda x: x.timestamp()).tolist(), pdf["id"].tolist(), pdf["sender"].tolist(), strict=True)]
            waiting = sorted([*((r[0], r[1], r[2]) for r in self.waiting.get()), *new])
            self.waiting.put(waiting)
            self._arm(waiting, self.last.get()[0] if self.last.exists() else None)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            out, waiting = [], sorted((r[0], r[1], r[2]) for r in self.waiting.get())
            last = self.last.get()[0] if self.last.exists() else None
            passed = timerValues.getCurrentWatermarkInMs() / 1000
            while waiting and (due := _due(waiting[0][0], last, gap, zone, quiet)) <= passed:
                held = [w for w in waiting if w[0] <= due][:most]
                out.append(_row(key[0], due, held))
                waiting, last = waiting[len(held) :], due
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
            if waiting or last is not None and last + gap > passed:
                if last is not None:
                    self.last.update((last, 0))
                self._arm(waiting, last)
            else:
                self.last.clear()
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

        def close(self) -> None:
            pass

    plain = _plain(df, key, at, number, sender).where("recipient IS NOT NULL").withWatermark("at", delay)
    return plain.groupBy("recipient").transformWithStateInPandas(Queue(), SCHEMA, "Append", "EventTime")
