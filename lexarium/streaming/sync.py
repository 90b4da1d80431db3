"""The state of each source as a stream: events move it, moves that aren't allowed are refused, silent sources time out.

One keyed state a source (its state and when it last spoke) with an event-time timer: a source from which nothing comes for
`silence` is timed out at its last event plus that time, by the timer once the watermark has passed it, or when its next
event shows that it was silent for longer, so that the result doesn't depend on how events fall into batches. State and
timers are in the checkpoint; a restarted query goes on. Events that are not newer than the watermark are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a state says that timed out, and the configuration that keyed state with timers needs.
SILENT = "timed_out"
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SHAPE = "source string, micros long, event long, to string, state string, outcome string"


def step(state: str | None, to: str, allowed: frozenset[tuple[str, str]]) -> tuple[str | None, str]:
    """The state after a move, and first, moved, same or refused."""
    if state is None:
        return to, "first"
    if to == state:
        return state, "same"
    return (to, "moved") if (state, to) in allowed else (state, "refused")


def _millis(micros: int) -> int:
    return -(-micros // 1000)  # rounded up


class SourceSync(StatefulProcessor):
    """Rows (source, micros, event, to) -> SHAPE: one for each event, and one (without event) for each time a source timed out."""

    def __init__(self, allowed: Iterable[tuple[str, str]], silence: timedelta):
        self.allowed, self.silence = frozenset(allowed), silence // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, last long")

    def _silent(self, source: str, last: int) -> Row:
        return Row(source=source, micros=last + self.silence, event=None, to=None, state=SILENT, outcome=SILENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.now.get() if self.now.exists() else None
        state, last = (kept[0], kept[1]) if kept else (None, None)
        before = last
        for r in sorted(rows, key=lambda r: (r["micros"], r["event"])):
            if last is not None and state != SILENT and r["micros"] > last + self.silence:
                yield self._silent(key[0], last)
                state = SILENT
            state, outcome = step(state, r["to"], self.allowed)
            last = r["micros"] if last is None else max(last, r["micros"])
            yield Row(source=key[0], micros=r["micros"], event=r["event"], to=r["to"], state=state, outcome=outcome)
        self.now.update((state, last))
        if before is not None:
            self.handle.deleteTimer(_millis(before + self.silence))
        if state != SILENT:
            self.handle.registerTimer(_millis(last + self.silence))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, last = self.now.get()[:2]
        if state != SILENT:
            self.now.update((SILENT, last))
            yield self._silent(key[0], last)

    def close(self) -> None:
        pass


def synced_stream(events: DataFrame, allowed: Iterable[tuple[str, str]], silence: timedelta, delay: str = "0 seconds") -> DataFrame:
    """events(source string, at timestamp, event long, to string), a stream -> (source, at, event, to, state, outcome).

    Set PROVIDER on the session first.
    """
    e = events.withWatermark("at", delay).select("source", "at", F.unix_micros("at").alias("micros"), "event", "to")
    out = e.groupBy("source").transformWithState(SourceSync(allowed, silence), SHAPE, "Append", "EventTime")
    return out.select("source", F.timestamp_micros("micros").alias("at"), "event", "to", "state", "outcome")
