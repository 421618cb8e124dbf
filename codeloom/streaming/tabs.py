"""One project out of many live sources: the newest content of every path, kept up to date as a stream.

State holds, for each path, what every open source last sent for it. A source that closes leaves all its paths, which
go back to the newest content of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MERGED = "path_key string, file_id bigint, project_id string, content string, copies bigint, gone boolean"
#: Parts that paths are dealt into; a closing source is told to each.
PARTS = 32


class TabsProcessor(StatefulProcessor):
    """Two maps for the paths of a part: who sent what and when, by path; and the content, by path and source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sources = handle.getMapState("sources", "path_key string", "sent array<struct<project_id:string,us:bigint,file_id:bigint,copies:bigint>>")
        self._contents = handle.getMapState("contents", "path_key string, project_id string", "content string")

    def _sent(self, path: str) -> list[tuple]:
        if not self._sources.containsKey((path,)):
            return []
        return [tuple(s) for s in self._sources.getValue((path,))[0]]

    def _close(self, source: str, us: int) -> set[str]:
        """Take a source out of all paths for which it has sent nothing since."""
        left = set()
        for (path,), (sent,) in list(self._sources.iterator()):
            kept = [tuple(s) for s in sent if s[0] != source or s[1] > us]
            if len(kept) < len(sent):
                left.add(path)
                self._contents.removeKey((path, source))
                if kept:
                    self._sources.updateValue((path,), (kept,))
                else:
                    self._sources.removeKey((path,))
        return left

    def _arrive(self, row) -> None:
        sent = self._sent(row.path_key)
        own = next((s for s in sent if s[0] == row.project_id), None)
        rest = [s for s in sent if s[0] != row.project_id]
        # Of what one source sends the newest counts, of equally new the smallest id.
        newer = own is None or (-row.us, row.file_id) < (-own[1], own[2])
        copies = (own[3] if own else 0) + 1
        now = (row.project_id, int(row.us), int(row.file_id), copies) if newer else (*own[:3], copies)
        self._sources.updateValue((row.path_key,), ([*rest, now],))
        if newer:
            self._contents.updateValue((row.path_key, row.project_id), (row.content,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: set[str] = set()
        # The rows of a part in one micro-batch, which the trigger's file limit bounds.
        for row in pd.concat(list(rows)).sort_values(["us", "closes", "file_id"], kind="stable").itertuples(index=False):
            if row.closes:
                changed |= self._close(row.project_id, int(row.us))
            else:
                self._arrive(row)
                changed.add(row.path_key)
        out = []
        for path in sorted(changed):
            sent = self._sent(path)
            if sent:
                won = min(sent, key=lambda s: (-s[1], s[0], s[2]))
                out.append((path, won[2], won[0], self._contents.getValue((path, won[0]))[0], sum(s[3] for s in sent), False))
            else:
                out.append((path, None, None, None, 0, True))
        yield pd.DataFrame(out, columns=["path_key", "file_id", "project_id", "content", "copies", "gone"]).astype({"file_id": "Int64"})

    def close(self) -> None:
        pass


def merged_tabs(arrivals: DataFrame, closings: DataFrame, parts: int = PARTS) -> DataFrame:
    """``MERGED`` rows of the paths that a micro-batch changes, from ``project_id, path, file_id, content, ts`` and ``project_id, ts``."""
    came = arrivals.select("project_id", F.lower("path").alias("path_key"), F.col("file_id").cast("bigint").alias("file_id"), "content",
                           F.unix_micros("ts").alias("us"), F.lit(False).alias("closes"))
    came = came.withColumn("part", F.pmod(F.xxhash64("path_key"), F.lit(parts)).cast("int"))
    went = closings.select("project_id", F.lit(None).cast("string").alias("path_key"), F.lit(0).cast("bigint").alias("file_id"), F.lit(None).cast("string").alias("content"),
                           F.unix_micros("ts").alias("us"), F.lit(True).alias("closes"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return came.unionByName(went).groupBy("part").transformWithStateInPandas(TabsProcessor(), MERGED, "Update", "None")
