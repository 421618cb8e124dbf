"""File names, languages and paths on hand-worked inputs."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import language as G, paths as P
from codeloom.operators import names as N

FIELDS = "page_id bigint, block_index int, code string, label string, text_before string, text_after string, surrounding_text string, language string"


def name(spark, code="x", label="", before="", after="", around="", language="text", index=0):
    df = spark.createDataFrame([(1, index, code, label, before, after, around, language)], FIELDS)
    r = N.resolve_names(df).first()
    return r.strategy, r.file_name


@pytest.mark.parametrize("kwargs, expected", [
    (dict(label="app.py"), ("label", "app.py")),
    (dict(label="`src/utils/database.py` holds it"), ("label", "src/utils/database.py")),
    (dict(label="Python"), ("label", "Python")),
    (dict(code="# filename: config/settings.yaml\nx"), ("comment", "config/settings.yaml")),
    (dict(before="Now edit src/utils/database.py:"), ("text_before", "src/utils/database.py")),
    (dict(after="saved in models.py"), ("text_after", "models.py")),
    (dict(around="Create the file main.go now"), ("surrounding", "main.go")),
    (dict(code="write the file out.sh\n"), ("create_phrase", "out.sh")),
    (dict(code="from .models.user import User", language="python"), ("import", "models/user.py")),
    (dict(code="import x from './lib/thing'", language="typescript"), ("import", "thing.ts")),
    (dict(code="```python run.me\nx"), ("fence", "run.me")),
    (dict(code='{"manifest_version": 3}', language="json"), ("content", "manifest.json")),
    (dict(code="FROM python:3\nRUN x", language="dockerfile"), ("content", "Dockerfile")),
    (dict(code="node_modules/\n*.log\n.env\ndist/"), ("content", "gitignore")),
    (dict(code="y = 1", language="python", before="Step 3: Set API key!\n"), ("heading", "set_api_key_3.py")),
    (dict(code="y = 1", language="python", before="## 2. Train model\n"), ("heading", "train_model_2.py")),
    (dict(code="y = 1", language="python", before="Here is the code:"), ("generated", "python_1.py")),
    (dict(code="y = 1", language="makefile", index=4), ("generated", "Makefile")),
    (dict(label='bad:name*"x?.txt'), ("label", "bad_name_x_.txt")),
])
def test_cascade(spark, kwargs, expected):
    assert name(spark, **kwargs) == expected


def test_repeated_names_are_numbered(spark):
    df = spark.createDataFrame([(1, i, "x", "Main.PY", "", "", "", "python") for i in range(3)], FIELDS)
    got = [r.file_name for r in N.unique_names(N.resolve_names(df)).orderBy("block_index").collect()]
    assert got == ["Main.PY", "Main_2.py", "Main_3.py"]


@pytest.mark.parametrize("code, declared, file_name, expected", [
    ("x", "python", None, "python"), ("x", "JS", None, "javascript"), ("x", "text", "a/b/Dockerfile", "dockerfile"), ("x", "text", "q.R", "r"),
    ("import os\ndef f():\n    self.x = 1", "text", None, "python"), ("const x = require('y');\nconsole.log(x)", "text", None, "javascript"),
    ("<!DOCTYPE html>\n<html><head></head><body><div></div></body>", "text", None, "html"), ('{"a": [1, 2]}', "text", None, "json"),
    ("SELECT a FROM b WHERE c", "text", None, "sql"), ("#!/bin/bash\necho hi\nexport A=1", "text", None, "bash"),
    ("FROM x\nRUN y\nCOPY a b\nCMD z", "text", None, "dockerfile"), ("", "text", None, "text"), ("hello", "", None, "text"),
])
def test_language(spark, code, declared, file_name, expected):
    df = spark.createDataFrame([(code, declared, file_name)], "code string, language string, file_name string")
    assert df.select(G.identify("code", "language", "file_name")).first()[0] == expected


@pytest.mark.parametrize("path, expected", [
    ("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../../x", "x"), ("src\\utils\\helper.py", "src/utils/helper.py"), ("", ""), ("a/b/../../c/d", "c/d")])
def test_normalised_path(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(P.normalised("p")).first()[0] == expected


def test_placed_paths_and_last_block_wins(spark):
    rows = [(1, 0, "one", "python", "app.py"), (1, 1, "two", "css", "app.py"), (1, 2, "three", "python", "app.py"), (1, 3, "four", "text", "lib\\x.py")]
    df = spark.createDataFrame(rows, "page_id bigint, block_index int, code string, language string, file_name string")
    got = {(r.path, r.code, r.position) for r in N.mapped_files(df).collect()}
    assert got == {("src/app.py", "three", 0), ("public/css/app.py", "two", 1), ("lib/x.py", "four", 3)}


def test_valid_paths(spark):
    cases = {"a/b.py": True, "": False, "a//b": False, "a|b": False, "x" * 256: False, "a/" + "y" * 255: True, "p" * 5000: False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", P.valid_path("p").alias("ok")).collect()} == cases


def test_suffix_keeps_folder_and_extension(spark):
    df = spark.createDataFrame([("a.b/app.py",), ("Makefile",)], "p string")
    assert [r[0] for r in df.select(P.suffixed("p", F.lit("_copy1"))).collect()] == ["a.b/app_copy1.py", "Makefile_copy1"]
