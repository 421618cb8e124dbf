"""File-name resolution as one cascade of native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from codeloom.functions.text import BLANKS, col, extract, lookup, once, presence, strip
from codeloom.rules import languages as L, naming as N


def from_label(label: Column | str) -> Column:
    label = presence(label)
    short = F.when((F.length(label) < 50) & ~label.contains("\n"), label)
    return F.coalesce(extract(label, N.FILE_LIKE), short)


def from_comment(code: Column | str) -> Column:
    return extract(F.substring_index(col(code), "\n", 5), N.COMMENT_NAME)


def from_text_before(text: Column | str) -> Column:
    return extract(F.substring_index(col(text), "\n", -3), N.FILE_LIKE)


def from_text_after(text: Column | str) -> Column:
    return extract(F.substring_index(col(text), "\n", 3), N.FILE_LIKE)


def from_create_phrase(text: Column | str) -> Column:
    return extract(text, N.CREATE_PHRASE)


def from_surrounding(text: Column | str) -> Column:
    return F.coalesce(from_create_phrase(text), extract(text, N.FILE_LIKE))


def from_import(code: Column | str, language: Column | str) -> Column:
    """Local imports only: relative Python modules, relative or slashed JS/TS modules."""
    code, language = col(code), col(language)
    python = F.coalesce(
        extract(code, r"(?:^|\n)from[ \t]+(\.[.\w/]+)[ \t]+import|(?:^|\n)import[ \t]+(\.[.\w/]+)", 1),
        extract(code, r"(?:^|\n)from[ \t]+(\.[.\w/]+)[ \t]+import|(?:^|\n)import[ \t]+(\.[.\w/]+)", 2))
    python = F.concat(F.regexp_replace(F.replace(python, F.lit("."), F.lit("/")), "^/", ""), F.lit(".py"))
    ext = F.when(language == "typescript", F.lit(".ts")).otherwise(F.lit(".js"))
    modules = F.transform(F.split(code, "\n"), lambda x: F.regexp_extract(x, r"from\s+['\"]([^'\"]+)['\"]", 1))
    local = F.filter(modules, lambda m: (m.startswith(".") | m.contains("/")) & ~m.endswith("/"))
    base = F.substring_index(F.get(local, 0), "/", -1)
    script = F.when(base.endswith(ext), base).otherwise(F.concat(base, ext))
    return (F.when(language == "python", python)
            .when(language.isin("javascript", "typescript") & code.contains("from"), script))


def from_fence(code: Column | str) -> Column:
    first = strip(F.substring_index(col(code), "\n", 1))
    return F.when(F.startswith(col(code), F.lit("```")),
                  presence(strip(F.regexp_extract(first, r"```\s*(\w+)\s*(.*)", 2))))


def _all_match(text: Column, patterns: list[str]) -> Column:
    tests = [~text.rlike(p[1:]) if p.startswith("!") else text.rlike(p) for p in patterns]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def from_content(code: Column | str, language: Column | str) -> Column:
    """Content fingerprints, first match wins."""
    return once(strip(code), lambda text: _fingerprint(text, col(language)))


def _fingerprint(text: Column, language: Column) -> Column:

    def fingerprints(rows):
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for lang, patterns, name in rows:
            test = _all_match(text, patterns)
            chain = chain.when(test if lang is None else (language == lang) & test, F.lit(name))
        return chain

    json_kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for patterns, name in N.JSON_KINDS:
        json_kind = json_kind.when(_all_match(text, patterns), F.lit(name))
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    ignored = F.size(F.filter(kept, lambda x: x.rlike(N.IGNORE_LINE)))
    ignore_list = F.when(
        (language.isNull() | language.isin("", "text")) & (ignored >= 3) & (ignored > F.size(kept) * 0.5),
        F.when(text.contains("docker"), F.lit(".dockerignore")).otherwise(F.lit(".gitignore")))
    tree = F.when(F.regexp_count(text, F.lit(N.TREE_LINE + r"[^\n]*")) >= 3, F.lit("project-structure.txt"))
    return F.coalesce(tree, F.when((language == "json") | F.startswith(text, F.lit("{")), json_kind),
                      fingerprints(N.FINGERPRINTS_BEFORE_IGNORE), ignore_list,
                      fingerprints(N.FINGERPRINTS_AFTER_IGNORE))


def _heading_of_line(line: Column) -> Column:
    """``number \\u0001 title`` of a heading-like line, null otherwise."""
    return once(F.btrim(line, F.lit(BLANKS)), _heading_of_text)


def _heading_of_text(text: Column) -> Column:
    def numbered(pattern):
        number = F.regexp_extract(text, pattern, 1)
        return F.when(text.rlike(pattern), F.concat(
            F.coalesce(number.try_cast("bigint").cast("string"), F.lit("")), F.lit("\u0001"),
            F.btrim(F.regexp_extract(text, pattern, 2), F.lit(BLANKS))))

    clean = F.btrim(F.regexp_replace(text, "[:;-]", ""), F.lit(BLANKS))
    short = ((F.length(text) > 2) & (F.length(text) <= 70) & (F.size(F.split(text, r"\s+")) <= 10)
             & ~clean.rlike(N.FILLER) & ~clean.contains("```"))
    return F.coalesce(numbered(N.HEADING_BLOCK), numbered(N.HEADING_MARKDOWN), numbered(N.HEADING_NUMBERED),
                      F.when(short, F.concat(F.lit("\u0001"), clean)))


def heading(text: Column | str) -> Column:
    """Nearest heading in the last six lines, read upwards."""
    last = F.split(F.substring_index(col(text), "\n", -6), "\n")
    found = F.filter(F.transform(F.reverse(last), _heading_of_line), lambda x: x.isNotNull())
    return F.get(found, 0)


def from_heading(text_before: Column | str, surrounding: Column | str, language: Column | str) -> Column:
    return once(F.coalesce(heading(presence(text_before)), heading(presence(surrounding))),
                lambda found: _heading_name(found, language))


def _heading_name(found: Column, language: Column | str) -> Column:
    number, caption = F.substring_index(found, "\u0001", 1), F.substring_index(found, "\u0001", -1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(caption), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = presence(F.substring(slug, 1, 40))
    ext = F.coalesce(lookup(L.NAME_EXTENSION, F.lower(col(language))), F.lit(".txt"))
    return F.concat(slug, F.when(number != "", F.concat(F.lit("_"), number)).otherwise(F.lit("")), ext)


def generated(language: Column | str, index: Column | str) -> Column:
    language = F.lower(col(language))
    ext = F.coalesce(lookup(L.NAME_EXTENSION, language), F.lit(".txt"))
    return F.coalesce(
        lookup(L.WHOLE_NAME, language),
        F.concat(F.coalesce(presence(language), F.lit("snippet")), F.lit("_"),
                 (col(index) + 1).cast("string"), ext))


STRATEGIES = ["label", "comment", "text_before", "text_after", "surrounding", "create_phrase", "import", "fence",
              "content", "heading", "generated"]


def resolve(code, label, text_before, text_after, surrounding, language, index) -> Column:
    """Struct (strategy, name) of the first strategy that yields a name."""
    candidates = [
        from_label(label), from_comment(code), from_text_before(text_before), from_text_after(text_after),
        from_surrounding(surrounding), from_create_phrase(code), from_import(code, language), from_fence(code),
        from_content(code, language), from_heading(text_before, surrounding, language), generated(language, index),
    ]
    def labelled(strategy: str, candidate: Column) -> Column:
        return once(candidate, lambda name: F.when(
            name.isNotNull(), F.struct(F.lit(strategy).alias("strategy"), name.alias("name"))))

    return F.coalesce(*[labelled(s, c) for s, c in zip(STRATEGIES, candidates)])
