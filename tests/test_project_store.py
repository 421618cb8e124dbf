"""The project store: upserts, deletes, broken-off writes, untouched directories."""

from pathlib import Path

import pytest

from codeloom.sources.project_store import ProjectStore

SCHEMA = "id string, project_id string, path string, language string, content string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, p, f"{i}.txt", "en", c) for i, p, c in rows], SCHEMA)


def held(store):
    return {r["id"]: (r["project_id"], r["content"], r["generation"]) for r in store.files().collect()}


def data_files(folder, generation, project):
    return {f.name: f.stat().st_mtime_ns for f in Path(folder, "files", f"generation={generation}", f"project_id={project}").glob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"a{i}", "A", f"text {i}") for i in range(25)] + [("b1", "B", "x"), ("b2", "B", None), ("c1", "C c/=", "y"), (None, "D", "z"), ("d1", None, "z")]
    return ProjectStore.create(frame(spark, *rows), str(tmp_path / "store"), rows_a_file=10)


def test_upsert_touches_its_projects_alone(spark, store):
    before, size = data_files(store.folder, 0, "A"), len(held(store))
    assert size == 28 and len(before) == 3  # ten rows a file
    store.upsert(frame(spark, ("b1", "B", "new"), ("e1", "E", "added"), ("c1", "B", "moved"), (None, "A", "no id")))
    now = held(store)
    assert now["b1"] == ("B", "new", 1) and now["b2"] == ("B", None, 1) and now["e1"] == ("E", "added", 1) and now["c1"] == ("B", "moved", 1)
    assert now["a3"] == ("A", "text 3", 0) and data_files(store.folder, 0, "A") == before and not data_files(store.folder, 1, "A")
    manifest = {r["project_id"]: (r["held_by"], r["files"], r["size"]) for r in store.manifest().collect()}
    assert manifest == {"A": (0, 25, sum(len(f"text {i}") for i in range(25))), "B": (1, 3, 8), "E": (1, 1, 5)}  # the emptied project is gone


def test_repeated_import_and_delete(spark, store):
    new = frame(spark, ("b1", "B", "new"), ("f1", "F", "f"))
    store.upsert(new)
    once = {i: v[:2] for i, v in held(store).items()}
    store.upsert(new)
    assert {i: v[:2] for i, v in held(store).items()} == once
    store.delete(spark.createDataFrame([("f1",), ("a0",), ("unknown",)], "id string"))
    assert set(held(store)) == set(once) - {"f1", "a0"}


def test_write_that_breaks_off_changes_nothing(spark, store, monkeypatch):
    before = held(store)
    with monkeypatch.context() as m:
        m.setattr(store._generations, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.upsert(frame(spark, ("b1", "B", "half"), ("z1", "Z", "half")))
    assert held(store) == before
    store.upsert(frame(spark, ("b1", "B", "whole")))
    assert held(store)["b1"] == ("B", "whole", 1) and "z1" not in held(store)


def test_empty_and_small_reads(spark, store, tmp_path):
    empty = ProjectStore.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert empty.files().count() == 0 and empty.manifest().count() == 0
    empty.upsert(frame(spark, ("q", "Q", "q")))
    assert held(empty) == {"q": ("Q", "q", 1)}
    assert store.files(spark.createDataFrame([("B",)], "project_id string")).count() == 2
