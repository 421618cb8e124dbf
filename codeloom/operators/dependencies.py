"""Dependencies of projects: packages by ecosystem, main file, manifest lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import presence
from codeloom.rules import dependencies as R
from codeloom.session import cut_lineage

SCRIPT = ["javascript", "typescript"]


def _python(content: Column) -> Column:
    modules = F.concat(
        F.regexp_extract_all(content, F.lit(r"(?:^|\n)[ \t\r]*import[ \t]+([\w.]+)"), F.lit(1)),
        F.regexp_extract_all(content, F.lit(r"(?:^|\n)[ \t\r]*from[ \t]+([\w.]+)[ \t]+import"), F.lit(1)))
    top = F.transform(modules, lambda m: F.substring_index(m, ".", 1))
    return F.array_except(top, F.array(*[F.lit(x) for x in R.PYTHON_STDLIB]))


def _node(content: Column) -> Column:
    """First ``require`` of each line, or its ``import .. from``; relative modules dropped, scopes kept."""
    found = F.transform(F.split(content, "\n"), lambda x: F.coalesce(
        presence(F.regexp_extract(x, r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)),
        presence(F.regexp_extract(x, r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", 1))))
    outer = F.filter(found, lambda m: m.isNotNull() & ~F.startswith(m, F.lit(".")) & ~F.startswith(m, F.lit("/")))
    return F.array_distinct(F.transform(outer, lambda m: F.when(
        F.startswith(m, F.lit("@")), F.substring_index(m, "/", 2)).otherwise(F.substring_index(m, "/", 1))))


def _go(content: Column) -> Column:
    modules = F.array_distinct(F.regexp_extract_all(content, F.lit(r'(?:^|\n)[ \t\r]*(?:import[ \t]+)?"([^"\n]+)"'), F.lit(1)))
    return F.filter(modules, lambda m: ~F.startswith(m, F.lit(".")) & ~F.startswith(m, F.lit("/"))
                    & ~F.substring_index(m, "/", 1).isin(*R.GO_STDLIB))


def _any(content: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [content.contains(m) for m in marks])


def _java(content: Column) -> Column:
    flags = F.array(F.when(_any(content, R.SPRING_MARKS), F.lit("org.springframework.boot:spring-boot-starter-web")),
                    F.when(_any(content, R.JUNIT_MARKS), F.lit("org.junit.jupiter:junit-jupiter")))
    return F.filter(flags, lambda f: f.isNotNull())


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct ``project_id, ecosystem, package``; packages are found inside the row, so only they are shuffled."""
    language, content = F.col("language"), F.col("content")
    ecosystem = (F.when(language == "python", F.lit("python")).when(language.isin(*SCRIPT), F.lit("node"))
                 .when(language == "go", F.lit("go")).when(language == "java", F.lit("java")))
    packages = (F.when(language == "python", _python(content)).when(language.isin(*SCRIPT), _node(content))
                .when(language == "go", _go(content)).when(language == "java", _java(content)))
    return files.select("project_id", ecosystem.alias("ecosystem"), F.explode(packages).alias("package")).distinct()


def main_files(files: DataFrame) -> DataFrame:
    """First candidate any script file ends with, else the first script file."""
    script = files.where(F.col("language").isin(*SCRIPT))
    rank = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(R.MAIN_FILES):
        rank = rank.when(F.endswith("path", F.lit(name)), F.lit(i))
    g = script.withColumn("rank", rank).groupBy("project_id").agg(
        F.min("rank").alias("rank"), F.min_by("path", F.struct("file_id")).alias("first_path"))
    names = F.array(*[F.lit(x) for x in R.MAIN_FILES])
    return g.select("project_id", F.coalesce(F.get(names, F.col("rank")), F.col("first_path"), F.lit("index.js")).alias("main_file"))


# --- fixed values: ecosystem -> manifest file -----------------------------------------------
MANIFESTS = {"python": "requirements.txt", "node": "package.json", "go": "go.mod", "java": "pom-dependencies.xml"}
NOTE = "# Auto-generated from the extracted files"


def _frame(ecosystem: Column, project: Column, main: Column) -> Column:
    """Lines around the package lines: (section, line); packages stand in section 100."""
    heads = {
        "python": [NOTE, "# Review and update versions as needed", ""],
        "node": ["{", F.concat(F.lit('  "name": "'), P.package_name(project), F.lit('",')), '  "version": "1.0.0",',
                 F.concat(F.lit('  "main": "'), main, F.lit('",')), '  "scripts": {',
                 F.concat(F.lit('    "start": "node '), main, F.lit('",')),
                 '    "test": "echo \\"Error: no test specified\\" && exit 1"', "  },", '  "dependencies": {'],
        "go": [F.concat(F.lit("module "), P.module_name(project)), "", "go 1.21", "", "require ("],
        "java": ["<dependencies>"],
    }
    tails = {"python": [], "node": ["  }", "}"], "go": [")"], "java": ["</dependencies>"]}
    out = F.when(F.lit(False), F.array(F.struct(F.lit(0).alias("section"), F.lit("").alias("line"))))
    for name, head in heads.items():
        rows = [*enumerate(head), *enumerate(tails[name], start=200)]
        out = out.when(ecosystem == name, F.array(*[
            F.struct(F.lit(n).alias("section"), (x if isinstance(x, Column) else F.lit(x)).alias("line")) for n, x in rows]))
    return out


def _package_line(ecosystem: Column, package: Column, is_last: Column) -> Column:
    comma = F.when(is_last, F.lit("")).otherwise(F.lit(","))
    return (F.when(ecosystem == "python", package)
            .when(ecosystem == "node", F.concat(F.lit('    "'), package, F.lit('": "^latest"'), comma))
            .when(ecosystem == "go", F.concat(F.lit("\t"), package, F.lit(" latest")))
            .otherwise(F.concat(F.lit("  <dependency><groupId>"), F.substring_index(package, ":", 1), F.lit("</groupId><artifactId>"),
                                F.substring_index(package, ":", -1), F.lit("</artifactId></dependency>"))))


def manifest_lines(deps: DataFrame, mains: DataFrame) -> DataFrame:
    """Manifest files line by line: ``project_id, path, section, sort_key, line``.

    The lines of a manifest ordered by (section, sort_key) are its text; a project may have any
    number of packages, so nothing is gathered.
    """
    ecosystem = F.col("ecosystem")
    deps = cut_lineage(deps)  # distinct packages: narrow, and read twice below
    heads = deps.groupBy("project_id", "ecosystem").agg(F.max("package").alias("last_package")).join(mains, "project_id", "left")
    frame = heads.select("project_id", "ecosystem", F.explode(_frame(
        ecosystem, F.col("project_id"), F.coalesce("main_file", F.lit("index.js")))).alias("l")).select(
        "project_id", "ecosystem", "l.section", F.lit("").alias("sort_key"), "l.line")
    body = deps.join(heads.select("project_id", "ecosystem", "last_package"), ["project_id", "ecosystem"]).select(
        "project_id", "ecosystem", F.lit(100).alias("section"), F.col("package").alias("sort_key"),
        _package_line(ecosystem, F.col("package"), F.col("package") == F.col("last_package")).alias("line"))
    names = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    return frame.unionByName(body).select("project_id", F.element_at(names, ecosystem).alias("path"), "section", "sort_key", "line")
