"""Pages of documents on a stream: what ``operators.pages.rollup`` computes in batch, a row per document.

Pages come in any order, some of them twice. A document comes out with the last
of its pages where their number is known, else once the watermark is past the
last page seen by ``wait``. Failed pages are pages. What comes later is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pages import rollup

#: The columns that a page needs: its document, number, how many there are (or null), text, confidence, error and time.
PAGE = ["document", "page_number", "pages", "text", "confidence", "error", "ts"]
GATHERED = "document long, pages array<struct<page_number: long, text: string, confidence: double, error: string>>"


class PageGatherer(StatefulProcessor):
    """State per document: its pages as a list, the numbers seen and the timer as one value.

    A document that has come out leaves a marker until the timer, so that a
    repeated page doesn't begin it again.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "seen array<long>, expected long, timer long, done boolean")
        self.pages = handle.getListState("pages", "page_number long, text string, confidence double, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, expected, timer, done = self.at.get() or ([], None, 0, False)
        seen, fresh, latest = set(seen), [], 0
        for batch in rows:
            columns = [batch[c].astype(object).where(batch[c].notna(), None) for c in PAGE[1:-1]]
            times = batch["ts"].astype("datetime64[ms]").astype("int64")
            for (number, pages, text, confidence, error), ts in zip(zip(*columns), times):
                latest = max(latest, int(ts))
                expected = expected if pages is None else int(pages)
                if number is not None and int(number) not in seen and not done:
                    seen.add(int(number))
                    fresh.append((int(number), text, confidence, error))
        if latest + self.wait_ms > timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = latest + self.wait_ms
            self.handle.registerTimer(timer)
        out = []
        if not done and expected is not None and len(seen) >= expected:
            out, seen, done = [self._gathered(key, fresh)], set(), True
        elif fresh:
            self.pages.appendList(fresh)
        self.at.update((sorted(seen), expected, timer, done))
        yield pd.DataFrame(out, columns=["document", "pages"])

    def _gathered(self, key, more: list[tuple]) -> tuple:
        own = [*(tuple(p) for p in self.pages.get()), *more] if self.pages.exists() else more
        self.pages.clear()
        return key[0], [dict(zip(("page_number", "text", "confidence", "error"), p)) for p in sorted(own, key=lambda p: p[0])]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.at.get()
        out = [] if found is None or found[3] else [self._gathered(key, [])]
        self.at.clear()
        yield pd.DataFrame(out, columns=["document", "pages"])

    def close(self) -> None:
        pass


def gather(pages: DataFrame, late: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """``(document, pages)`` once a document is complete or nobody waits for it any longer. Needs the RocksDB state store."""
    rows = pages.select(*PAGE).where("document is not null").withWatermark("ts", late)
    return rows.groupBy("document").transformWithStateInPandas(PageGatherer(wait_ms), GATHERED, "Append", "EventTime")


def rolled_up(gathered: DataFrame) -> DataFrame:
    """The rollup of documents that ``gather`` has written."""
    each = gathered.select("document", F.explode("pages").alias("p")).select("document", "p.*")
    return rollup(each, ["document"])
