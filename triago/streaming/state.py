"""State that a stream keeps for each key, and that ends by itself: contents done lately, and pages that are waited for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from triago import fixed

#: The settings that such a query needs from its session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ERROR, LATE = "erreur", "delai"
PAGES = "doc_id string, page int, status string, reason string, text string"


class _Once(StatefulProcessor):
    """The first row of each key; the key is forgotten ``ttl_ms`` after it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = next((frame for frame in rows if len(frame)), None)
        if first is not None and not self.done.exists():
            self.done.update((True,))
            yield first.iloc[:1]
        for _ in rows:
            pass

    def close(self) -> None:
        pass


def once_for_a_while(stream: DataFrame, key: str, days: float = fixed.RETENTION_DAYS) -> DataFrame:
    """``stream`` less rows whose key came up in the last ``days``: what is older is taken again, and the state holds no more
    keys than that time brings. Null keys are one key. State outlives restarts with the query's checkpoint."""
    return stream.groupBy(key).transformWithStateInPandas(_Once(int(days * 86_400_000)), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime")


class _Awaited(StatefulProcessor):
    """Passes a page on when it comes; if it hasn't come ``wait_ms`` after it was asked for, an error row takes its place."""

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "status string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, came = False, None
        for frame in rows:
            asked = asked or bool(frame["status"].isna().any())
            done = frame[frame["status"].notna()]
            if came is None and len(done):
                came = done.sort_values(["status", "text"]).iloc[:1]
        if self.closed.exists():  # it came, or was given up; nothing is said twice
            return
        if came is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.closed.update(("ok",))
            yield came[[c.split()[0] for c in PAGES.split(", ")]]
        elif asked and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.closed.exists():
            self.closed.update((LATE,))
            yield pd.DataFrame({"doc_id": [key[0]], "page": pd.array([key[1]], dtype="Int32"), "status": [ERROR], "reason": [LATE], "text": [None]})

    def close(self) -> None:
        pass


def pages_or_errors(pages: DataFrame, wait_s: float = fixed.OCR_PAGE_SECONDS, keep_days: float = fixed.RETENTION_DAYS) -> DataFrame:
    """One row for each page of the stream ``pages`` (PAGES; a page that is asked for has a null status): the page as it came, or
    an error once ``wait_s`` have gone by. A page that comes after its error, or again, is left out for ``keep_days``."""
    return pages.groupBy("doc_id", "page").transformWithStateInPandas(_Awaited(int(wait_s * 1000), int(keep_days * 86_400_000)), outputStructType=PAGES, outputMode="Append", timeMode="ProcessingTime")
