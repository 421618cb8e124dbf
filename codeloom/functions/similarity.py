"""Line-set similarity of two texts, and the update type derived from it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.functions.text import BLANKS, col, line_count, lines


def line_set(c: Column | str, keep_blank: bool = True) -> Column:
    """Distinct trimmed lines of a text."""
    trimmed = F.transform(lines(c), lambda x: F.btrim(x, F.lit(BLANKS)))
    if not keep_blank:
        trimmed = F.filter(trimmed, lambda x: x != "")
    return F.array_distinct(trimmed)


def ratio_gate(lines_a: Column, lines_b: Column) -> Column:
    """Line counts differ by at most half of the larger."""
    return F.abs(lines_a - lines_b) <= F.greatest(lines_a, lines_b) * 0.5


def jaccard(set_a: Column, set_b: Column) -> Column:
    shared = F.size(F.array_intersect(set_a, set_b))
    return shared / (F.size(set_a) + F.size(set_b) - shared)


def corpus_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard over trimmed lines including the blank line; 1 if equal, 0 beyond the line-count gate."""
    a, b = col(a), col(b)
    return (F.when(a == b, F.lit(1.0))
            .when((a == "") | (b == ""), F.lit(0.0))
            .when(~ratio_gate(line_count(a), line_count(b)), F.lit(0.0))
            .otherwise(jaccard(line_set(a), line_set(b))))


def update_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared lines over the larger distinct non-blank line set."""
    a, b = col(a), col(b)
    sa, sb = line_set(a, keep_blank=False), line_set(b, keep_blank=False)
    na, nb = F.size(sa), F.size(sb)
    return (F.when((a == "") | (b == "") | a.isNull() | b.isNull(), F.lit(0.0))
            .when(a == b, F.lit(1.0))
            .when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(F.size(F.array_intersect(sa, sb)) / F.greatest(na, nb)))


def update_type(old: Column | str, new: Column | str) -> Column:
    """EXTENSION, MODIFICATION, REPLACEMENT or UNRELATED."""
    old, new = col(old), col(new)
    similarity = update_similarity(old, new)
    blank = old.isNull() | new.isNull() | (old == "") | (new == "")
    return (F.when(blank, F.lit("REPLACEMENT"))
            .when(F.startswith(new, old) & (F.length(new) > F.length(old)), F.lit("EXTENSION"))
            .when(F.startswith(old, new) & (F.length(old) > F.length(new)), F.lit("MODIFICATION"))
            .when(similarity > 0.5, F.lit("MODIFICATION"))
            .when(similarity > 0.2, F.lit("REPLACEMENT"))
            .otherwise(F.lit("UNRELATED")))
