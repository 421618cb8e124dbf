"""The newest entries of every source, kept as a list in stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeloom.streaming.monitors import LOG_SIZE

LOG = "source_id bigint, event_ids array<bigint>, types array<string>"


class LogProcessor(StatefulProcessor):
    """Holds at most ``size`` entries of a source; older ones by (ts, event_id) leave."""

    def __init__(self, size: int = LOG_SIZE):
        self._size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("entries", "ts timestamp, event_id bigint, type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self._held.get())
        for part in rows:  # a part at a time, so that a busy source never is in memory whole
            new = part.sort_values(["ts", "event_id"]).tail(self._size)
            held = sorted([*held, *((r.ts.to_pydatetime(), int(r.event_id), r.type) for r in new.itertuples())], key=lambda e: (e[0], e[1]))[-self._size:]
        self._held.put([tuple(e) for e in held])
        yield pd.DataFrame({"source_id": [key[0]], "event_ids": [[e[1] for e in reversed(held)]], "types": [[e[2] for e in reversed(held)]]})

    def close(self) -> None:
        pass


def bounded_logs(entries: DataFrame, size: int = LOG_SIZE) -> DataFrame:
    """``LOG`` rows, newest entry first, for each source of a micro-batch of ``source_id, ts, event_id, type``."""
    return entries.groupBy("source_id").transformWithStateInPandas(LogProcessor(size), LOG, "Update", "None")
