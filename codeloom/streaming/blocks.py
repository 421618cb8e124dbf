"""Live block detection: identity, first sightings, bursts, code-like texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.text import content_hash, presence, strip

WATERMARK = "10 minutes"
BURST_GAP = "500 milliseconds"
MIN_TEXT = 10
# --- fixed values: class words and opening words of code -------------------------------
CODE_CLASSES = ["code", "hljs", "highlight", "code-block", "syntax", "prism", "monaco"]
CODE_LINE = r"(?:^|\n)(?:import |from |def |class |function |const |let |var )|(?:^|\n)(?://|#|/\*|--|<!--)"
CODE_BRACKETS = r"[{(][ \t\r]*\n[\s\S]*\n[ \t\r]*[)}]"
BUSY_CLASSES = ["streaming", "typing", "loading", "generating", "in-progress", "animate"]
BUSY_STATES = ["streaming", "generating"]


def element_id(own_id, message_id, parent_id, position, tag, text) -> Column:
    """Own id, else message id, else parent and place, else tag, place and the hash of the whole text."""
    place = F.col(position).cast("string")
    return F.coalesce(
        F.concat(F.lit("id_"), presence(own_id)), F.concat(F.lit("data-message-id_"), presence(message_id)),
        F.concat(F.lit("parent_"), presence(parent_id), F.lit("_idx_"), place),
        F.concat(F.lit("el_"), F.upper(tag), F.lit("_"), place, F.lit("_"), content_hash(text)))


def new_blocks(blocks: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each (page, element) once, with at least ten characters of text; works on streams."""
    long_enough = blocks.where(F.length(strip("text")) >= MIN_TEXT)
    return long_enough.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["page_id", "element_id"])


def bursts(blocks: DataFrame, gap: str = BURST_GAP, watermark: str = WATERMARK) -> DataFrame:
    """Blocks of a page that follow each other within the quiet period, as one burst."""
    return (blocks.withWatermark("ts", watermark).groupBy("page_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("blocks")).select("page_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "blocks"))


def looks_like_code(classes: Column | str, tag: Column | str, text: Column | str) -> Column:
    classes, tag, text = (F.col(c) if isinstance(c, str) else c for c in (classes, tag, text))
    decorated = F.lower(tag).isin("pre", "code")
    for word in CODE_CLASSES:
        decorated = decorated | classes.contains(word)
    plain = text.contains("\n") & (F.length(text) > 50) & (text.rlike(CODE_LINE) | text.rlike(CODE_BRACKETS))
    return F.coalesce(decorated, F.lit(False)) | plain


def is_busy(classes: Column | str, state: Column | str) -> Column:
    """Marked as still being written."""
    low = F.lower(F.col(classes) if isinstance(classes, str) else classes)
    out = F.coalesce((F.col(state) if isinstance(state, str) else state).isin(*BUSY_STATES), F.lit(False))
    for word in BUSY_CLASSES:
        out = out | F.coalesce(low.contains(word), F.lit(False))
    return out
