"""Duplicates: strategies, groups, skewed keys, and near duplicates against brute force."""

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from codeloom.operators import duplicates as D, merging as M, near_duplicates as ND
from codeloom.operators.ranking import numbered

FILES = "file_id bigint, project_id string, path string, language string, content string"


def files(spark, *rows):
    df = spark.createDataFrame([(i, "p", path, "python", text) for i, (path, text) in enumerate(rows)], FILES)
    return df.withColumn("ts", F.timestamp_seconds(F.col("file_id")))


SAME = [("app.py", "v1"), ("config.py", "c1"), ("app.py", "v2"), ("utils.py", "u1"), ("app.py", "v3")]


def test_latest_and_first(spark):
    f = files(spark, *SAME)
    assert {(r.path, r.content) for r in D.resolve_by_path(f, "latest").collect()} == {("app.py", "v3"), ("config.py", "c1"), ("utils.py", "u1")}
    assert {(r.path, r.content) for r in D.resolve_by_path(f, "keep_first").collect()} == {("app.py", "v1"), ("config.py", "c1"), ("utils.py", "u1")}


def test_merge_keeps_order_and_sums(spark):
    f = files(spark, *SAME)
    text = {r.path: r.content for r in D.merged_text(D.merge_parts(f)).collect()}
    assert text["app.py"] == "v1\n\nv2\n\nv3"
    pieces = D.merged_text(D.merge_parts(f), per_piece=2).where("path = 'app.py'").orderBy("piece").collect()
    assert [r.content for r in pieces] == ["v1\n\nv2", "v3"]
    assert D.merge_totals(f).where("path = 'app.py'").first()["size"] == 6


def test_keep_both_renames_and_avoids_taken_names(spark):
    f = files(spark, ("d/app.py", "1"), ("d/app.py", "2"), ("d/app.py", "3"), ("d/app_copy1.py", "4"))
    assert [r.path for r in D.keep_both(f).orderBy("file_id").collect()] == ["d/app.py", "d/app_copy1_1.py", "d/app_copy2.py", "d/app_copy1.py"]


def test_one_survivor_per_content(spark):
    f = D.hashed(files(spark, ("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("a", "z")))
    kept = D.without_duplicates(f, D.losers(f)).collect()
    assert len({r.hash for r in kept}) == len(kept)
    assert {r.file_id for r in kept} == {2, 3, 4}


def test_numbering_equals_window_on_a_hot_key(spark):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    got = numbered(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100), "rn")
    from pyspark.sql import Window
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("bigint"))
    assert got.count() == n and got.exceptAll(want).count() == 0


def brute_force(texts: list[str], threshold: float = 0.85):
    sets = [set(x.strip(" \t\n\r") for x in t.split("\n")) for t in texts]
    counts = [t.count("\n") + 1 for t in texts]
    claimed, out = set(), set()
    for i in range(len(texts)):
        if i in claimed:
            continue
        mine = []
        for j in range(i + 1, len(texts)):
            if j in claimed or abs(counts[i] - counts[j]) > max(counts[i], counts[j]) * 0.5:
                continue
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if threshold <= s < 1:
                mine.append((j, round(s, 9)))
                claimed.add(j)
        if mine:
            out |= {(i, i, None)} | {(i, j, s) for j, s in mine}
    return out


def corpus(rng: random.Random, n: int) -> list[str]:
    """Families of near copies around a few bases, with copies, shared and blank lines."""
    bases = [[f"base {b} line {i}" for i in range(rng.randint(6, 20))] for b in range(4)]
    out = []
    for _ in range(n):
        lines = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(lines))
            lines[at:at + 1] = rng.choice([[f"edit {rng.randint(0, 5)}"], [], ["", " padded "], [lines[at], "common"]])
            lines = lines or ["x"]
        out.append("\n".join(lines))
    return out


def near(spark, texts, **kwargs):
    got = ND.near_duplicate_members(files(spark, *[(f"f{i}", t) for i, t in enumerate(texts)]), **kwargs)
    return {(r.group_id, r.file_id, None if r.similarity is None else round(r.similarity, 9)) for r in got.collect()}


def test_near_duplicates_equal_brute_force(spark):
    for seed in range(3):
        texts = corpus(random.Random(seed), 60)
        assert near(spark, texts) == brute_force(texts)


def test_near_duplicates_with_one_candidate_a_round(spark):
    texts = corpus(random.Random(7), 30)
    assert near(spark, texts, seeds_per_line=1, threshold=0.7) == brute_force(texts, 0.7)


def test_near_duplicates_of_one_hot_family(spark):
    base = [f"line {i}" for i in range(40)]
    texts = ["\n".join(base[:-1] + [f"own {i}"]) for i in range(80)]
    got = near(spark, texts)
    assert got == brute_force(texts) and len(got) == 80


def test_merge_of_a_corpus_into_itself_changes_nothing(spark):
    f = files(spark, ("a.py", "x\ny"), ("B.py", "z"), ("c.py", ""))
    assert {r.status for r in M.merge(f, f).collect()} == {"unchanged"}


TYPES = {("a\nb", "a\nb\nc"): "EXTENSION", ("a\nb\nc", "a\nb"): "MODIFICATION", ("", "x"): "REPLACEMENT", ("a\nb\nc", "a\nb\nd"): "MODIFICATION",
         ("a\nb\nc", "a\nx\ny"): "REPLACEMENT", ("a", "b"): "UNRELATED"}


def test_update_types(spark):
    from codeloom.functions.similarity import update_type
    from codeloom.streaming.merge import update_type as one
    df = spark.createDataFrame(list(TYPES), "o string, n string")
    assert {(r.o, r.n): r.t for r in df.select("o", "n", update_type("o", "n").alias("t")).collect()} == TYPES
    assert {k: one(*k) for k in TYPES} == TYPES


text = st.lists(st.sampled_from(["a", "b", " a", "", "c "]), max_size=6).map("\n".join)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(text, text), min_size=30, max_size=30))
def test_update_type_forms_agree(spark, pairs):
    from codeloom.functions.similarity import update_type
    from codeloom.streaming.merge import update_type as one
    df = spark.createDataFrame(pairs, "o string, n string")
    for r in df.select("o", "n", update_type("o", "n").alias("t")).collect():
        assert r.t == one(r.o, r.n)


def test_split_blocks_join(spark):
    rows = [(1, 0, "a.py", "python", "def f(:"), (1, 1, "b.py", "python", "  x = 1;"), (1, 2, "b2.py", "python", "import os"), (1, 3, "c.js", "js", "y"), (1, 4, "c.js", "js", "function z")]
    df = spark.createDataFrame(rows, "page_id bigint, block_index int, file_name string, language string, content string")
    got = [(r.block_index, r.content, r.parts) for r in M.merge_split_blocks(df).orderBy("block_index").collect()]
    assert got == [(0, "def f(:\n  x = 1;", 2), (2, "import os", 1), (3, "y\nfunction z", 2)]


def test_files_that_share_a_line_only_take_few_rounds(spark, monkeypatch):
    rounds = []
    step = ND._round
    monkeypatch.setattr(ND, "_round", lambda *a, **k: rounds.append(1) or step(*a, **k))
    texts = ["\n".join(["shared by all"] + [f"own {i // 2} {j}" for j in range(12)] + [f"tail {i}"]) for i in range(3000)]
    got = near(spark, texts)
    assert len(got) == 3000 and all(f // 2 == g // 2 for g, f, _ in got)
    assert len(rounds) <= 4


def test_threshold_is_clamped_and_low_ones_work(spark):
    texts = corpus(random.Random(11), 12)
    assert near(spark, texts, threshold=1.7) == set()
    assert near(spark, texts, threshold=0.5) == brute_force(texts, 0.5)
