"""Compare registered queries with their SQL counterparts, values and types."""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

#: Tables that the tests read.
SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return ("f", float(f"{v:.9g}"))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, datetime.datetime):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_plain(x) for x in v))
    return (type(v).__name__, v if v is None or isinstance(v, str) else str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, otherwise what differs."""
    from codeloom.plans import CHECKS, QUERIES
    df = QUERIES[name](spark, folder)
    start = time.time()
    got_names, got = df.columns, df.collect()
    compare.spark_seconds = time.time() - start
    if name not in CHECKS:
        return None
    result = con.execute(CHECKS[name])
    want_names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = _rows(got_names, got), _rows(want_names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ in {sorted(got_names)}, e.g. {str(bad[0])[:1500]}"
    return None


def main(argv: list[str]) -> int:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    from codeloom.plans import CHECKS, QUERIES
    from codeloom.session import local_session
    folder = argv[0]
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark, con, failures = local_session(8), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1800]}"
        failures += problem is not None
        mark = "ok" if problem is None else "FAIL"
        print(f"{mark:5}{'' if name in CHECKS else '(rows) '}{name} {time.time() - start:.1f}s (Spark {getattr(compare, 'spark_seconds', 0):.1f}s) {problem or ''}", flush=True)
    print(f"{len(names) - failures}/{len(names)} ok")
    return failures


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
