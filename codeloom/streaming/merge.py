"""Stateful stream jobs: live incremental merge and the completeness gate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET_MS = 500
FORGET_MS = 24 * 3600 * 1000
MERGED = ("project_id string, path_key string, event_id bigint, ts timestamp, path string, status string, update_type string, "
          "content string, previous string")
GATED = "page_id bigint, element_id string, text string, ts timestamp"


def _lines(text: str) -> set[str]:
    return {x for x in (y.strip(" \t\n\r") for y in text.split("\n")) if x}


def update_type(old: str, new: str) -> str:
    """The update type of :func:`codeloom.functions.similarity.update_type` for one pair."""
    if not old or not new:
        return "REPLACEMENT"
    if new.startswith(old) and len(new) > len(old):
        return "EXTENSION"
    if old.startswith(new) and len(old) > len(new):
        return "MODIFICATION"
    a, b = _lines(old), _lines(new)
    similarity = (1.0 if a == b else 0.0) if not a or not b else len(a & b) / max(len(a), len(b))
    return "MODIFICATION" if similarity > 0.5 else "REPLACEMENT" if similarity > 0.2 else "UNRELATED"


class MergeProcessor(StatefulProcessor):
    """Keeps the current content of one (project, path); conflicts leave it as it is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of one key in one micro-batch; the trigger's file limit bounds them
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        content = self.current.get()[0] if self.current.exists() else None
        start, out = content, []
        for row in batch.itertuples(index=False):
            kind, before = None, content
            if content is None:
                status, content = "added", row.content
            elif content == row.content:
                status = "unchanged"
            else:
                kind = update_type(content, row.content)
                status = "conflict" if kind == "UNRELATED" else "updated"
                if status == "updated":
                    content = row.content
            out.append((key[0], key[1], row.event_id, row.ts, row.path, status, kind, row.content, before))
        if content != start:
            self.current.update((content,))
        yield pd.DataFrame(out, columns=["project_id", "path_key", "event_id", "ts", "path", "status", "update_type", "content", "previous"])

    def close(self) -> None:
        pass


def live_merge(files: DataFrame) -> DataFrame:
    """Status of every arriving (project_id, path, content, ts, event_id) against the state before it."""
    keyed = files.select("project_id", F.lower("path").alias("path_key"), "event_id", "ts", "path", "content")
    return keyed.groupBy("project_id", "path_key").transformWithStateInPandas(
        MergeProcessor(), outputStructType=MERGED, outputMode="Append", timeMode="None")


def change_log(merged: DataFrame) -> DataFrame:
    """Change entries with lengths and size difference; unchanged arrivals leave none."""
    kinds = F.create_map(*[F.lit(x) for x in ("added", "file_added", "updated", "file_updated", "conflict", "conflict")])
    return merged.where("status <> 'unchanged'").select(
        "event_id", "project_id", "path", "ts", F.element_at(kinds, F.col("status")).alias("type"), "update_type",
        F.length("previous").alias("old_length"), F.length("content").alias("new_length"),
        (F.length("content") - F.coalesce(F.length("previous"), F.lit(0))).alias("diff_size"))


def version_rows(merged: DataFrame) -> DataFrame:
    """Versions to save for added and updated arrivals."""
    changed = merged.where(F.col("status").isin("added", "updated"))
    return changed.select(
        F.col("event_id").alias("version_id"), "project_id", "path", "content", "ts",
        F.when(F.col("status") == "added", F.lit("live_scan_add")).otherwise(F.coalesce("update_type", F.lit("live_scan_update"))).alias("change_type"),
        F.lit("live_scan").alias("source"))


class GateProcessor(StatefulProcessor):
    """Gives a block's text once it has been quiet for the given time and was not marked busy.

    Rows are walked in the order of time; a text that was at rest before the next row came is given then, and else
    when the watermark passes. So the split into micro-batches does not matter. The text is held until it is given,
    its hash for ``forget_ms`` more, after which the block is unknown again.
    """

    def __init__(self, quiet_ms: int = QUIET_MS, forget_ms: int = FORGET_MS):
        self.quiet_ms, self.forget_ms = quiet_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "text string, hash string, since bigint, busy boolean, done string")

    def _given(self, key, rows: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pd.Series([key[0]] * len(rows), dtype="int64"), "element_id": pd.Series([key[1]] * len(rows), dtype="str"),
                             "text": pd.Series([t for t, _ in rows], dtype="str"), "ts": pd.to_datetime([s for _, s in rows], unit="ms")})

    def _timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        text, digest, since, busy, done = self.held.get() if self.held.exists() else (None, None, 0, False, None)
        rested = []
        for row in batch.itertuples(index=False):
            at = int(pd.Timestamp(row.ts).value // 1_000_000)
            if digest is not None and not busy and digest != done and at >= since + self.quiet_ms:
                rested.append((text, since))
                done = digest
            new = hashlib.sha256((row.text or "").encode()).hexdigest()
            if new != digest or bool(row.busy) != busy:
                text, digest, busy, since = row.text, new, bool(row.busy), at
        waiting = digest != done
        self.held.update((text if waiting else None, digest, since, busy, done))
        after = since + (self.quiet_ms if waiting and not busy else self.forget_ms)
        self._timer(max(after, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._given(key, rested)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, digest, since, busy, done = self.held.get()
        if busy or digest == done:
            self.held.clear()
            yield self._given(key, [])
            return
        self.held.update((None, digest, since, busy, digest))
        self._timer(max(since + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._given(key, [(text, since)])

    def close(self) -> None:
        pass


def complete_blocks(blocks: DataFrame, watermark: str = "10 minutes", quiet_ms: int = QUIET_MS) -> DataFrame:
    """Blocks (page_id, element_id, text, ts, busy) whose text has come to rest."""
    return (blocks.withWatermark("ts", watermark).groupBy("page_id", "element_id").transformWithStateInPandas(
        GateProcessor(quiet_ms), outputStructType=GATED, outputMode="Append", timeMode="EventTime"))
