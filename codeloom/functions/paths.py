"""File name and path expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.rules import languages as L
from codeloom.functions.text import col, lookup


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def directory(path: Column | str) -> Column:
    """Everything before the last slash, '' when there is none."""
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def extension(path: Column | str) -> Column:
    """From the last dot on, case kept; '' without a dot."""
    return F.regexp_extract(col(path), r"\.[^.]*$", 0)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\.[^.]*$", "")


def suffixed(path: Column | str, suffix: Column) -> Column:
    """Insert ``suffix`` before the extension of the base name, keeping the folder."""
    path = col(path)
    name = base_name(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.concat(folder, stem(name), suffix, extension(name))


def normalised(path: Column | str) -> Column:
    """Resolve ``.``, empty and ``..`` segments; backslashes count as slashes."""
    parts = F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/")
    parts = F.filter(parts, lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, empty,
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))))
    # the fold is needed only where a parent step occurs
    return F.array_join(F.when(F.array_contains(parts, ".."), folded).otherwise(parts), "/")


def ancestors(path: Column | str) -> Column:
    """All proper prefixes of a path: ``a/b/c -> [a, a/b]``."""
    parts = F.split(col(path), "/")
    depth = F.size(parts)
    return F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1),
                                         lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
                  ).otherwise(F.array().cast("array<string>"))


def language_folder(language: Column | str) -> Column:
    return lookup(L.LANGUAGE_FOLDER, F.lower(col(language)))


def placed(file_name: Column | str, language: Column | str) -> Column:
    """Path of a named block: its own folder if it has one, else the folder of its language."""
    name = col(file_name)
    folder = language_folder(language)
    return (F.when(name.contains("/") | name.contains("\\"), normalised(name))
            .when(folder.isNotNull(), F.concat(folder, F.lit("/"), name))
            .otherwise(name))


def export_extension(path: Column | str) -> Column:
    """Lower-case extension without dot, ``no-ext`` without one."""
    path = col(path)
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise(F.lit("no-ext"))


# Characters that no stored name may hold.
ILLEGAL_IN_NAME = r'[<>:"/\\|?*\x00-\x1F]'
ILLEGAL_IN_PATH = r'[<>:"|?*\x00-\x1F]'


def valid_path(path: Column | str) -> Column:
    path = col(path)
    segments = F.split(path, r"[/\\]")
    return F.coalesce(
        (F.length(F.trim(path)) > 0) & (F.length(path) <= 4096) & ~path.rlike(ILLEGAL_IN_PATH)
        & F.forall(segments, lambda s: F.length(s).between(1, 255)), F.lit(False))


def valid_file_name(name: Column | str) -> Column:
    name = col(name)
    return F.coalesce((F.length(F.trim(name)) > 0) & (F.length(name) <= 255) & ~name.rlike(ILLEGAL_IN_NAME)
                      & ~name.rlike(r"^\.+$"), F.lit(False))


def valid_project_name(name: Column | str) -> Column:
    name = col(name)
    return F.coalesce((F.length(F.trim(name)) > 0) & (F.length(name) <= 100)
                      & ~name.rlike(ILLEGAL_IN_NAME), F.lit(False))


def sanitised_path_name(name: Column | str) -> Column:
    """Visible block names: slashes stay, other illegal characters become underscores."""
    out = F.regexp_replace(col(name), r'[<>:"\\|?*\x00-\x1F]', "_")
    out = F.regexp_replace(out, r"^\.+|\.+$", "")
    out = F.regexp_replace(out, r"[ \t\n\r]+", "_")
    out = F.substring(F.regexp_replace(out, r"_{2,}", "_"), 1, 255)
    return F.when(out == "", F.lit("unnamed_file.txt")).otherwise(out)


def sanitised_file_name(name: Column | str) -> Column:
    out = F.regexp_replace(col(name), ILLEGAL_IN_NAME, "_")
    out = F.regexp_replace(out, r"^\.+|\.+$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(out, r"[ \t\n\r]+", "_"), r"_{2,}", "_"), 1, 255)


def package_name(name: Column | str) -> Column:
    out = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9\-_.]", "-")
    out = F.substring(F.regexp_replace(out, r"^-+|-+$", ""), 1, 214)
    return F.when(out == "", F.lit("extracted-project")).otherwise(out)


def module_name(name: Column | str) -> Column:
    out = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9\-_.]", "-")
    return F.concat(F.lit("github.com/user/"), F.regexp_replace(out, r"^-+|-+$", ""))
