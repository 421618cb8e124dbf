import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

#: Texts that every operator has to take: none, empty, blank, repeated, very long, odd characters.
ODD_TEXTS = [None, "", " ", "\n\t", "one", "one two", "one two three four five six", "one  two\tthree four five six",
             "ONE two Three four five six", "é 日本 😀 naïve ▁ x", "word " * 4000, "x" * 30000, "a@b.example.com +1 (017) 555-7713 10.0.0.1 4556737586899855"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, each twice under two ids, one row repeated whole, one null id, and columns with clashing names."""
    rows = [(i, t, f"s{i % 2}", i) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, t, "s0", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "one two", "s1", 3), (5, "another text under an id that is taken", "s1", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, hash int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, name string, hash int")
