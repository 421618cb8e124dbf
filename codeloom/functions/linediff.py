"""Line diff of two texts: the one computation here that needs a table per row."""

from __future__ import annotations

import numpy as np

ROWS_HELD = 64  # rows of the table that are worked out at a time
ROWS_MARKED = 16  # rows kept while a stretch is cut into smaller ones


def _ids(old: list[str], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    seen: dict[str, int] = {}
    code = [seen.setdefault(x, len(seen)) for x in old + new]
    return np.array(code[:len(old)], dtype=np.int64), np.array(code[len(old):], dtype=np.int64)


def _next_row(row: np.ndarray, x: int, b: np.ndarray) -> np.ndarray:
    """The row of the table below ``row``: lengths of the longest common subsequences with one more old line."""
    new = np.zeros_like(row)
    new[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return new


def _walk(a: np.ndarray, b: np.ndarray, top: np.ndarray, low: int, high: int, j: int, ops: list[tuple[str, int, int]]) -> int:
    """Operations from (high, j) back to row ``low``, last first; ``top`` is that row. Returns the column reached.

    A long stretch is cut at marked rows and worked out from its end, so the rows in memory grow with the logarithm
    of the old text's lines.
    """
    rows = [top[:j + 1]]
    if high - low > ROWS_HELD:
        step = -(-(high - low) // ROWS_MARKED)
        row = rows[0]
        for i in range(low, high - 1):
            row = _next_row(row, a[i], b[:j])
            if (i + 1 - low) % step == 0:
                rows.append(row)
        for k in range(len(rows) - 1, -1, -1):
            j = _walk(a, b, rows.pop(), low + k * step, min(high, low + (k + 1) * step), j, ops)
        return j
    for i in range(low, high):
        rows.append(_next_row(rows[-1], a[i], b[:j]))
    i = high
    while i > low:
        if j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            ops.append(("unchanged", i, j))
        elif j == 0 or rows[i - 1 - low][j] > rows[i - low][j - 1]:
            i -= 1
            ops.append(("removed", i, j))
        else:
            j -= 1
            ops.append(("added", i, j))
    return j


def _exact(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """Operations (type, old index, new index) in order; on ties the new text moves."""
    a, b = _ids(old, new)
    ops: list[tuple[str, int, int]] = []
    left = _walk(a, b, np.zeros(len(b) + 1, dtype=np.int32), 0, len(a), len(b), ops)
    ops.extend(("added", 0, j) for j in range(left - 1, -1, -1))
    return ops[::-1]


def _approximate(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """Lines of the old text that occur in the new one, each once, are walked in step; the rest is added or removed."""
    left = set(new)
    common = []
    for line in old:
        if line in left:
            common.append(line)
            left.discard(line)
    ops, i, j, k = [], 0, 0, 0
    while i < len(old) or j < len(new):
        if k < len(common) and i < len(old) and old[i] == common[k]:
            if j < len(new) and new[j] == common[k]:
                ops.append(("unchanged", i, j))
                i, j, k = i + 1, j + 1, k + 1
            else:
                ops.append(("removed", i, j))
                i += 1
        elif j < len(new):
            ops.append(("added", i, j))
            j += 1
        else:
            ops.append(("removed", i, j))
            i += 1
    return ops


def diff(old: str | None, new: str | None, ignore_trailing_blanks: bool = False,
         approximate: bool = False) -> list[tuple[str, str, int]]:
    """Rows (type, content, line number): the number counts new lines, for removed lines old ones.

    The diff is a shortest one whatever the sizes; only a caller who asks for it gets the approximate walk.
    """
    if not old and not new:
        return []
    a = old.split("\n") if old else []
    b = new.split("\n") if new else []
    if ignore_trailing_blanks:
        a, b = [x.rstrip() for x in a], [x.rstrip() for x in b]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    core_a, core_b = a[head:len(a) - tail], b[head:len(b) - tail]
    make = _approximate if approximate else _exact
    out = [("unchanged", b[n], n + 1) for n in range(head)]
    for kind, i, j in make(core_a, core_b):
        out.append((kind, core_a[i], head + i + 1) if kind == "removed" else (kind, core_b[j], head + j + 1))
    out.extend(("unchanged", b[n], n + 1) for n in range(len(b) - tail, len(b)))
    return out
