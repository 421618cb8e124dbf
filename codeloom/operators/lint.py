"""Text lint over a corpus: one findings row per problem."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.language import is_json
from codeloom.functions.text import BLANKS, col, line_count, occurrences

MAX_LINE = 120
SUPPORTED = ["javascript", "typescript", "python", "html", "css", "json", "yaml", "markdown", "sql", "bash"]
# --- fixed values: tags that never close, keywords a SQL text should hold ----------------
VOID_TAGS = ["br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"]
SQL_KEYWORDS = ["SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "JOIN"]


@dataclass(frozen=True)
class LintRule:
    """A user's own per-line rule."""
    language: str
    severity: str
    pattern: str
    message: str


def _finding(severity: str, message: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _text(n: Column) -> Column:
    return n.cast("string")


def _when(test: Column, severity: str, message: Column | str) -> Column:
    return F.when(test, _finding(severity, message))


def _file_findings(content: Column, language: Column) -> Column:
    """Findings about a file as a whole, without line."""
    def count(c):
        return occurrences(content, c)

    braces = _when(count("{") != count("}"), "error", F.concat(
        F.lit("Mismatched braces: "), _text(count("{")), F.lit(" opening, "), _text(count("}")), F.lit(" closing")))
    parens = _when(count("(") != count(")"), "error", F.concat(
        F.lit("Mismatched parentheses: "), _text(count("(")), F.lit(" opening, "), _text(count(")")), F.lit(" closing")))
    n = line_count(content)
    upper = F.upper(content)
    keyword = reduce(lambda a, b: a | b, [upper.contains(k) for k in SQL_KEYWORDS])
    by_language = {
        ("javascript", "typescript"): [braces, parens],
        ("python",): [_when(~content.contains("if __name__") & ~content.contains("def main") & (n > 10), "info", "No main block detected")],
        ("css",): [braces],
        ("html",): [
            _when(~content.contains("<!DOCTYPE") & content.contains("<html"), "warning", "Missing DOCTYPE declaration"),
            _when(~content.contains("<title>") & content.contains("<head>"), "warning", "Missing <title> tag in <head>")],
        ("json",): [_when(~is_json(content), "error", "Invalid JSON")],
        ("markdown",): [_when(F.regexp_count(content, F.lit(r"(?:^|\n)[ \t\r]*```")) % 2 == 1, "warning", "Unclosed code block")],
        ("sql",): [_when(~keyword & (n > 3), "info", "No SQL keywords detected")],
        ("bash",): [
            _when(~F.startswith(F.btrim(F.substring_index(content, "\n", 1), F.lit(BLANKS)), F.lit("#!")), "info",
                  "Missing shebang line (#!/bin/bash)"),
            _when(count('"') % 2 == 1, "error", "Unclosed double quote"),
            _when(count("'") % 2 == 1, "error", "Unclosed single quote")],
    }
    out = F.when(F.lit(False), F.array(_finding("", "")))
    for languages, checks in by_language.items():
        out = out.when(language.isin(*languages), F.array(*checks))
    rest = F.when(~language.isin(*SUPPORTED), F.array(_finding("info", F.concat(F.lit("No validator available for "), language))))
    return F.filter(F.coalesce(out, rest), lambda f: f.isNotNull())


def _line_findings(line: Column, language: Column, own: list[LintRule]) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    long = _when(F.length(line) > MAX_LINE, "warning", F.concat(
        F.lit("Line too long ("), _text(F.length(line)), F.lit(" chars, max 120)")))
    indent = F.length(line) - F.length(F.ltrim(line, F.lit(BLANKS)))
    upper = F.upper(trimmed)

    def unless(skip: Column, check: Column) -> Column:
        return F.when(~skip, check)

    hash_or_blank = (trimmed == "") | F.startswith(trimmed, F.lit("#"))
    css_skip = (trimmed == "") | F.startswith(trimmed, F.lit("/*")) | F.startswith(trimmed, F.lit("*"))
    by_language = {
        ("javascript", "typescript"): [
            _when(trimmed.contains("==") & ~trimmed.contains("===") & ~trimmed.contains("!=="), "warning", "Consider using === instead of =="),
            _when(trimmed.contains("console.log"), "info", "console.log statement found"), long],
        ("python",): [
            unless(hash_or_blank, _when((indent % 4 != 0), "warning", "Indentation should be multiples of 4 spaces")),
            unless(hash_or_blank, _when(trimmed.contains("print("), "info", "print() statement found")),
            unless(hash_or_blank, long)],
        ("css",): [unless(css_skip, _when(trimmed.contains("!important"), "warning", "Avoid using !important")), unless(css_skip, long)],
        ("yaml",): [
            unless(hash_or_blank, _when(F.startswith(line, F.lit(" ")) & (indent % 2 != 0), "warning", "YAML indentation should be even spaces")),
            unless(hash_or_blank, _when(line.contains("\t"), "error", "YAML does not allow tabs, use spaces"))],
        ("sql",): [
            _when(F.startswith(upper, F.lit("SELECT")) & ~upper.contains("FROM"), "warning", "SELECT without FROM clause"),
            _when(F.startswith(upper, F.lit("SELECT")) & upper.contains("*"), "warning", "SELECT * is not recommended, specify columns")],
    }
    for rule in own:
        by_language.setdefault((rule.language.lower(),), [])
        by_language[(rule.language.lower(),)] = by_language[(rule.language.lower(),)] + [
            _when(line.rlike(rule.pattern), rule.severity, rule.message)]
    out = F.when(F.lit(False), F.array(_finding("", "")))
    for languages, checks in by_language.items():
        out = out.when(language.isin(*languages), F.array(*checks))
    return F.filter(out, lambda f: f.isNotNull())


def _html_findings(content: Column) -> Column:
    """Tag stack as an ordered fold over the tags of one file; a mismatch pops nothing."""
    tags = F.regexp_extract_all(content, F.lit(r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*/?>"), F.lit(0))
    entry = F.transform(tags, lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name"), F.startswith(t, F.lit("</")).alias("closes"),
        F.endswith(t, F.lit("/>")).alias("alone")))
    entry = F.filter(entry, lambda e: ~e["name"].isin(*VOID_TAGS) & (e["closes"] | ~e["alone"]))
    kind = "struct<stack:array<string>,errors:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("errors")).cast(kind)

    def step(acc: Column, e: Column) -> Column:
        stack, errors = acc["stack"], acc["errors"]
        top = F.get(stack, F.size(stack) - 1)
        message = F.when(F.size(stack) == 0, F.concat(F.lit("Unexpected closing tag </"), e["name"], F.lit(">"))).otherwise(
            F.concat(F.lit("Mismatched tag: expected </"), top, F.lit(">, got </"), e["name"], F.lit(">")))
        fits = (F.size(stack) > 0) & (top == e["name"])
        return (F.when(~e["closes"], F.struct(F.concat(stack, F.array(e["name"])).alias("stack"), errors.alias("errors")))
                .when(fits, F.struct(F.slice(stack, 1, F.size(stack) - 1).alias("stack"), errors.alias("errors")))
                .otherwise(F.struct(stack.alias("stack"), F.concat(errors, F.array(message)).alias("errors")))).cast(kind)

    messages = F.aggregate(entry, start, step, lambda acc: F.concat(acc["errors"], F.transform(
        acc["stack"], lambda t: F.concat(F.lit("Unclosed tag: <"), t, F.lit(">")))))
    return F.transform(messages, lambda m: _finding("error", m))


def _markdown_lines(files: DataFrame) -> DataFrame:
    """Heading and link findings outside fences; the running fence parity is a window over one file."""
    rows = files.where("language = 'markdown'").select("file_id", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    fence = F.startswith(F.btrim("text", F.lit(BLANKS)), F.lit("```")).cast("int")
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    outside = rows.withColumn("open", F.sum(fence).over(w) % 2).where("open = 0")
    text = F.col("text")
    checks = F.array(
        _when(text.rlike(r"^#+[^# ]") | text.rlike(r"^#+$"), "warning", "Add space after # in heading"),
        _when(text.contains("http") & ~text.contains("[") & ~text.contains("<"), "info", "Consider using markdown links for URLs"))
    return outside.select("file_id", "language", (F.col("line") + 1).alias("line"), F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("f"))


def findings(files: DataFrame, own_rules: list[LintRule] = ()) -> DataFrame:
    """``file_id, language, severity, message, line`` over all files.

    Whole-file checks are evaluated before lines are exploded, so line rows stay narrow.
    """
    f = files.select("file_id", F.lower(F.coalesce("language", F.lit("text"))).alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    whole = f.select("file_id", "language", F.lit(None).cast("int").alias("line"), F.explode(
        F.concat(_file_findings(F.col("content"), F.col("language")),
                 F.when(F.col("language") == "html", _html_findings(F.col("content"))).otherwise(F.array().cast(
                     "array<struct<severity:string,message:string>>")))).alias("f"))
    own = list(own_rules)
    checked = [x for x in ("javascript", "typescript", "python", "css", "yaml", "sql", *[r.language.lower() for r in own])]
    rows = f.where(F.col("language").isin(*checked)).select("file_id", "language", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    lines = rows.select("file_id", "language", (F.col("n") + 1).alias("line"), F.explode(
        _line_findings(F.col("text"), F.col("language"), own)).alias("f"))
    return whole.unionByName(lines).unionByName(_markdown_lines(f)).select("file_id", "language", "f.severity", "f.message", "line")


def results(files: DataFrame, found: DataFrame) -> DataFrame:
    """Per file: errors, warnings (all other findings) and validity."""
    counts = found.groupBy("file_id").agg(F.count_if(F.col("severity") == "error").alias("errors"),
                                          F.count_if(F.col("severity") != "error").alias("warnings"))
    return files.select("file_id", "language").join(counts, "file_id", "left").select(
        "file_id", "language", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings")).withColumn(
        "valid", F.col("errors") == 0)


def summary(r: DataFrame) -> DataFrame:
    g = r.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
              F.sum("errors").alias("total_errors"), F.sum("warnings").alias("total_warnings"))
    rate = F.format_string("%.1f%%", F.round(F.col("valid") / F.col("total") * 100, 1))
    return g.withColumn("pass_rate", F.when(F.col("total") > 0, rate).otherwise(F.lit("0%")))
