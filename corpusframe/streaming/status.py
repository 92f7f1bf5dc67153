"""Status of every document from a stream of events, with the state of each document kept between batches."""

from __future__ import annotations

from datetime import timedelta
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusframe.operators.library import MISSING_SUMMARY
from corpusframe.session import ship

STATUS = "document_id string, status string, attempts bigint, last_attempt_at timestamp, failure_kind string, error_message string"
#: What an attempt is given that does not end in time.
STUCK = ("unknown", "the attempt did not end")

_EVENTS = {"at": "timestamp", "event_id": "bigint", "status": "string", "failure_kind": "string", "error_message": "string", "summary": "string"}
_PLACE = "at bigint, event_id bigint"


def _text(value) -> str | None:
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else str(value)


class _Fold(StatefulProcessor):
    """The fold of ``library.fold_status``, event by event.

    State per document: the latest event, the latest failure, whether there is a summary, and the attempts by event id,
    so that an event that comes twice counts once and one that comes late takes its place.
    """

    def __init__(self, patience: float | None) -> None:
        self.patience = None if patience is None else int(patience * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", f"{_PLACE}, status string")
        self.failed = handle.getValueState("failed", f"{_PLACE}, kind string, message string")
        self.described = handle.getValueState("described", "yes boolean")
        self.started = handle.getMapState("started", "event_id bigint", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            stamps = part["at"].to_numpy("datetime64[us]").astype("int64")
            for at, event, status, kind, message, summary in zip(
                    stamps.tolist(), part["event_id"].tolist(), part["status"], part["failure_kind"], part["error_message"], part["summary"]):
                place = (at, event)
                if not self.latest.exists() or place >= tuple(self.latest.get()[:2]):
                    self.latest.update((*place, status))
                if status == "PROCESSING":
                    self.started.updateValue((event,), (at,))
                if status == "FAILED" and (not self.failed.exists() or place >= tuple(self.failed.get()[:2])):
                    self.failed.update((*place, _text(kind), _text(message)))
                if _text(summary) is not None:
                    self.described.update((True,))
        self._watch()
        yield self._row(key)

    def _watch(self) -> None:
        """A timer while the latest event is the start of an attempt; none otherwise."""
        if self.patience is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at, _, status = self.latest.get()
        if status == "PROCESSING":
            self.handle.registerTimer((at + self.patience) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, event, status = self.latest.get()
        if status == "PROCESSING":
            self.latest.update((at, event, "FAILED"))
            self.failed.update((at + 1, event, *STUCK))
            yield self._row(key)

    def _row(self, key) -> pd.DataFrame:
        _, _, status = self.latest.get()
        started = [(at[0], event[0]) for event, at in self.started.iterator()]
        last, failed = max(started, default=None), self.failed.get() if self.failed.exists() else None
        standing = failed is not None and (last is None or tuple(failed[:2]) > last)
        note = MISSING_SUMMARY if status == "READY" and not self.described.exists() else None
        return pd.DataFrame({
            "document_id": [key[0]], "status": [status], "attempts": [len(started)],
            "last_attempt_at": pd.to_datetime(pd.Series([last[0] if last else None], dtype="Int64"), unit="us"),
            "failure_kind": [failed[2] if standing else None], "error_message": [failed[3] if standing else note]})

    def close(self) -> None:
        pass


def stream_status(events: DataFrame, patience: timedelta | None = None, late: str = "1 day") -> DataFrame:
    """A row for every document that changed, in update mode; equal to ``library.fold_status`` over distinct events.

    events(document_id string, at, event_id[, failure_kind][, error_message][, summary], status). Events may come in any
    order within ``late``, and more than once. With ``patience``, an attempt that has seen no other event of its document
    for so long (in event time) is reported as FAILED; an event that comes after all takes its place in the fold again.
    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(events.sparkSession)
    filled = events.select("document_id", *[
        (F.col(name) if name in events.columns else F.lit(None)).cast(kind).alias(name) for name, kind in _EVENTS.items()])
    return filled.withWatermark("at", late).groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=_Fold(None if patience is None else patience.total_seconds()), outputStructType=STATUS,
        outputMode="Update", timeMode="EventTime")
