"""Diffs, retention, as-of lookup, search and lint details."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codeloom.functions import linediff
from codeloom.functions.linediff import diff
from codeloom.functions.text import content_key
from codeloom.operators import diffs as D, lint as L, search as S, versions as V

texts = st.lists(st.sampled_from(["a", "b", "c", "", "d "]), max_size=12).map("\n".join)


@settings(max_examples=300, deadline=None)
@given(texts, texts, st.booleans())
def test_replay_rebuilds_both_texts(old, new, approximate):
    rows = diff(old, new, approximate=approximate)
    if old or new:
        assert "\n".join(c for k, c, _ in rows if k != "added") == old
        assert "\n".join(c for k, c, _ in rows if k != "removed") == new


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(texts.filter(bool), texts.filter(bool))
def test_exact_diff_is_shortest(old, new):
    kept = sum(k == "unchanged" for k, _, _ in diff(old, new))
    assert kept == lcs(old.split("\n"), new.split("\n"))


@settings(max_examples=100, deadline=None)
@given(texts.filter(bool), texts.filter(bool))
def test_stretches_do_not_change_the_diff(old, new):
    want = diff(old, new)
    held, marked = linediff.ROWS_HELD, linediff.ROWS_MARKED
    try:
        linediff.ROWS_HELD, linediff.ROWS_MARKED = 1, 2
        assert diff(old, new) == want
    finally:
        linediff.ROWS_HELD, linediff.ROWS_MARKED = held, marked


def test_long_texts_are_diffed_exactly():
    draw = random.Random(1)
    old = [str(draw.randrange(900)) for _ in range(4000)]
    new = [x for x in old if draw.random() > 0.2] + ["end"]
    rows = diff("\n".join(old), "\n".join(new))
    assert [c for k, c, _ in rows if k != "added"] == old and [c for k, c, _ in rows if k != "removed"] == new
    assert sum(k == "unchanged" for k, _, _ in rows) == len(new) - 1


def test_tie_moves_in_the_new_text_and_numbers_lines():
    assert diff("x\na", "x\nb") == [("unchanged", "x", 1), ("removed", "a", 2), ("added", "b", 2)]
    assert diff("", "a\nb") == [("added", "a", 1), ("added", "b", 2)]
    assert diff("a \nb", "a\nb", ignore_trailing_blanks=True) == [("unchanged", "a", 1), ("unchanged", "b", 2)]


def test_diff_job_and_unified_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "s", "s")], "pair_id bigint, old string, new string")
    d = D.diff_lines(df)
    assert {r.pair_id: r["diff"] for r in D.unified_text(d).collect()} == {1: "  a\n- b\n+ x\n  c\n", 2: "  s\n"}
    assert {r.pair_id: (r.added, r.removed) for r in D.diff_statistics(d).collect()} == {1: (1, 1), 2: (0, 0)}
    bags = D.changed_line_bags(df).where("pair_id = 1").first()
    assert (bags.lost, bags.gained) == (1, 1)


VERSIONS = "version_id bigint, project_id string, path string, content string, seconds bigint, is_favorite boolean"


def versions(spark, n=30):
    return spark.createDataFrame([(i, "p", "f", f"v{i}", i * 37, i in (2, 3)) for i in range(n)], VERSIONS).withColumn(
        "ts", F.timestamp_seconds("seconds"))


def test_retention_keeps_newest_and_favourites(spark):
    assert sorted(r.version_id for r in V.retained(versions(spark), 5).collect()) == [2, 3, 25, 26, 27, 28, 29]


def test_as_of_equals_brute_force(spark):
    rng = random.Random(1)
    vs = [(i, "p", rng.choice("ab"), rng.randrange(0, 100_000)) for i in range(200)]
    ps = [(i, "p", rng.choice("abc"), rng.randrange(-10, 110_000)) for i in range(200)]
    v = spark.createDataFrame(vs, "version_id bigint, project_id string, path string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    p = spark.createDataFrame(ps, "probe_id bigint, project_id string, path string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.probe_id: r.version_id for r in V.as_of(p, v).collect()}
    want = {i: max(((s, k) for k, _, f, s in vs if f == path and s <= at), default=(None, None))[1] for i, _, path, at in ps}
    assert got == want


def test_toggles_twice_flip_back(spark):
    t = spark.createDataFrame([(1,), (2,), (2,), (3,)], "version_id bigint")
    got = {r.version_id: r.is_favorite for r in V.toggled(versions(spark, 5), t).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_search_tokens_and_literal_matching(spark):
    assert S.tokens("Hello my_big-World a") == ["hello", "my", "big", "world"]
    t = spark.createDataFrame([("k1", "file", "p", "a.b", "x/a.b", "x", "text", [], [], None, None, None, "a.b.c a+b", 9, False)],
                              "key string, type string, project_id string, name string, path string, directory string, language string, languages array<string>,"
                              "tags array<string>, source_url string, page_title string, source_site string, content string, size bigint, is_favorite boolean")
    t = t.withColumn("created_at", F.timestamp_seconds(F.lit(0))).withColumn("search_text", F.lower("content"))
    now = F.timestamp_seconds(F.lit(0))
    assert S.matches(t, "a+b", now).first().score == 20 + 5 + 2 + 10  # content, token, one literal hit, fresh
    assert S.matches(t, "zzz", now).count() == 0  # recency alone is no match


def lint(spark, language, content):
    df = spark.createDataFrame([(1, language, content)], "file_id bigint, language string, content string")
    return sorted((r.severity, r.message, r.line) for r in L.findings(df).collect())


def test_html_mismatch_cascades(spark):
    got = [m for s, m, _ in lint(spark, "html", "<div><p></div></i></p></div></x>") if s == "error"]
    assert sorted(got) == sorted(["Mismatched tag: expected </p>, got </div>", "Mismatched tag: expected </p>, got </i>", "Unexpected closing tag </x>"])


def test_json_and_unknown_language(spark):
    assert lint(spark, "json", '{"a": 1,}') == [("error", "Invalid JSON", None)]
    assert lint(spark, "json", '{"a": [1, null]}') == []
    assert lint(spark, "cobol", "x") == [("info", "No validator available for cobol", None)]


def test_markdown_fence_parity(spark):
    assert lint(spark, "markdown", "#bad\n```\n#inside\n```\n## fine\nhttp://x\n```") == [
        ("info", "Consider using markdown links for URLs", 6), ("warning", "Add space after # in heading", 1), ("warning", "Unclosed code block", None)]


def keyed(spark, rows):
    """Pairs (pair_id, old, new) as pairs of content keys, and the contents."""
    pairs = spark.createDataFrame(rows, "pair_id bigint, old string, new string")
    contents = pairs.select(F.col("old").alias("content")).union(pairs.select("new")).where("content IS NOT NULL").distinct()
    return (pairs, pairs.select("pair_id", content_key("old").alias("old_key"), content_key("new").alias("new_key")),
            contents.select(content_key("content").alias("content_key"), "content"))


def test_shared_pairs_of_texts_are_diffed_once(spark):
    rows = [(i, "a\nb", "a\nc") for i in range(50)] + [(50, None, "x"), (51, "x", None), (52, None, None), (53, "s", "s"), (54, "a\nb", "a\nc"), (54, "x", "y")]
    plain, keys, contents = keyed(spark, rows)
    pairs, owners = D.text_pairs(keys, contents)
    assert pairs.count() == 1 + 4 + 2 and owners.count() == 55
    for find in (D.diff_lines, D.changed_line_sets, D.changed_line_bags, lambda p: D.diff_statistics(D.diff_lines(p)), lambda p: D.unified_text(D.diff_lines(p)),
                 lambda p: D.numbered_lines(D.diff_lines(p))):
        want = find(plain)
        got = D.for_owners(find(pairs), owners).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_predecessors_and_pairs_by_content_key(spark):
    v = versions(spark).withColumn("content", F.when(F.col("version_id") % 7 != 0, F.concat(F.lit("t"), (F.col("version_id") % 3).cast("string"))))
    records = v.withColumn("content_key", content_key("content")).drop("content")
    contents = v.select(content_key("content").alias("content_key"), "content").where("content IS NOT NULL").distinct()
    columns = ["version_id", "old_version", "old_content"]
    assert sorted(map(str, V.with_predecessor(records, contents).select(columns).collect())) == sorted(map(str, V.with_predecessor(v).select(columns).collect()))
    wanted = spark.createDataFrame([(i, i % 30, i * 7 % 31) for i in range(80)], "pair_id bigint, old_version bigint, new_version bigint")
    columns = ["pair_id", "old", "new"]
    got, want = V.version_pairs(wanted, records, contents).select(columns), V.version_pairs(wanted, v).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_whole_diffs_equal_line_rows_and_need_no_shuffle(spark):
    draw = random.Random(2)
    rows = [(i, *("\n".join(draw.choices(["a", "b ", "c", "", "d"], k=draw.randrange(9))) for _ in range(2))) for i in range(60)]
    pairs = spark.createDataFrame(rows + [(60, None, "x"), (61, "x", None), (62, None, None), (63, "s \ns", "s \ns"), (64, "", "")], "pair_id bigint, old string, new string")
    for blanks, approximate in ((False, False), (True, False), (False, True)):
        lines, whole = (D.diff_lines(pairs, blanks, approximate, whole) for whole in (False, True))
        numbered = D.numbered_lines(whole).select("pair_id", F.inline("lines"))
        for find in (D.diff_statistics, D.unified_text, D.rebuilt_texts, lambda d: D.last_numbers(D.numbered_lines(d))):
            assert sorted(map(str, find(whole).collect())) == sorted(map(str, find(lines).collect()))
            assert "Exchange hashpartitioning" not in find(whole)._jdf.queryExecution().toString()
        want = D.numbered_lines(lines)
        assert sorted(map(str, numbered.select(want.columns).collect())) == sorted(map(str, want.collect()))
    bags = D.changed_line_bags(pairs, whole=True)
    assert sorted(map(str, bags.collect())) == sorted(map(str, D.changed_line_bags(pairs).collect()))
    assert "Exchange hashpartitioning" not in bags._jdf.queryExecution().toString()


def test_pairs_of_a_file_equal_pairs_by_key(spark, monkeypatch):
    text = F.when(F.col("version_id") % 7 != 0, F.concat(F.lit("a\nt"), (F.col("version_id") % 3).cast("string")))
    v = versions(spark).withColumn("content", text).withColumn("path", F.when(F.col("version_id") % 11 != 0, F.concat("path", (F.col("version_id") % 2).cast("string"))))
    records = v.withColumn("content_key", content_key("content")).drop("content")
    texts = v.select("project_id", "path", content_key("content").alias("content_key"), "content").where("content IS NOT NULL").repartition(3)
    contents = texts.select("content_key", "content").distinct()
    want = V.with_texts(V.predecessor_keys(records), contents).select("pair_id", "old", "new")
    pairs = V.file_pairs(records, texts)
    assert sorted(map(str, D.for_owners(pairs).collect())) == sorted(map(str, want.collect()))
    assert pairs.count() < want.count()
    assert not V.ids_repeat(records) and V.ids_repeat(records.union(records.limit(1))) and V.large_files(records, texts).isEmpty()
    monkeypatch.setattr(V, "FILE_VERSIONS", 13)
    assert [r.path for r in V.large_files(records, texts).collect()] == ["f1"]


def test_large_files_and_repeated_ids_give_the_same_diffs(spark, tmp_path, monkeypatch):
    from codeloom.plans import QUERIES

    docs = spark.createDataFrame([(i, f"a\nb{i % 5}\n{i}", "en", f"src{i % 2}") for i in range(12)], "doc_id bigint, text string, lang string, source string")
    events = spark.range(80).selectExpr("id AS event_id", "timestamp_seconds(id * 7919 % 1000) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    events.write.parquet(f"{tmp_path}/a/events.parquet")
    find = lambda: sorted(map(str, QUERIES["v5_unified_text"](spark, f"{tmp_path}/a").collect()))
    want = find()
    assert len(want) == 78
    with monkeypatch.context() as m:
        m.setattr(V, "FILE_BYTES", 35)
        m.setattr(V, "ids_repeat", lambda versions: False)
        assert find() == want
    with monkeypatch.context() as m:
        m.setattr(V, "ids_repeat", lambda versions: True)
        assert find() == want
