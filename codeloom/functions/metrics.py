"""Line metrics of a text, counted with one regex pass each and no line rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.functions.text import col, line_count

START = r"(?:^|\n)[ \t\r]*"

# --- fixed values: what opens a function, a class, an import ------------------------
FUNCTIONS = r"(?:function |const \w+\s*=\s*(?:async\s+)?function|def |func |fn )"
CLASSES = r"(?:class |interface |type \w+\s*=)"
IMPORTS = r"(?:import |from [^\n]* import |require\(|#include )"
# --- fixed values: comment openings by language ------------------------------------
HASH_LANGUAGES = ["python", "bash", "ruby", "yaml"]
MARKUP_LANGUAGES = ["html", "xml"]
DASH_LANGUAGES = ["sql"]
SLASH_COMMENT = r"(?://|/\*|\*)"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(START + pattern))


def functions(text) -> Column:
    return _count(col(text), FUNCTIONS)


def classes(text) -> Column:
    return _count(col(text), CLASSES)


def imports(text) -> Column:
    return _count(col(text), IMPORTS)


def comment_lines(text, language) -> Column:
    text, language = col(text), F.lower(col(language))
    return (F.when(language.isin(*HASH_LANGUAGES), _count(text, "#"))
            .when(language.isin(*MARKUP_LANGUAGES), _count(text, "<!--"))
            .when(language.isin(*DASH_LANGUAGES), _count(text, "--"))
            .otherwise(_count(text, SLASH_COMMENT)))


def filled_lines(text) -> Column:
    return F.regexp_count(col(text), F.lit(r"[^ \t\r\n][^\n]*"))


def blank_lines(text) -> Column:
    return line_count(text) - filled_lines(text)
