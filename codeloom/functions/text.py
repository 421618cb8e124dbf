"""Plain text expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\r"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim blanks, tabs and line breaks (the engine's ``trim`` strips blanks only)."""
    return F.btrim(col(c), F.lit(BLANKS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` mentions it.

    Expressions inside conditional branches are not shared by the code generator, so a costly
    value mentioned by a long rule chain would be computed once per rule.
    """
    return F.get(F.transform(F.array(value), use), 0)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row ``inline``, which the optimizer does not merge with later projections.

    Plain columns are substituted into every expression that mentions them, also into the body of
    a lambda, where they would be computed once per array element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def presence(c: Column | str) -> Column:
    """The value, or null where it is null or empty."""
    c = col(c)
    return F.when(c != "", c)


def default(c: Column | str, value) -> Column:
    return F.coalesce(presence(c), value if isinstance(value, Column) else F.lit(value))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def line_count(c: Column | str) -> Column:
    """Number of lines without building the line array: breaks + 1."""
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def occurrences(c: Column | str, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    c = col(c)
    gone = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return F.floor(gone / F.lit(len(needle))).cast("int")


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group of the first match, null when there is none or it is empty."""
    return presence(F.regexp_extract(col(c), pattern, group))


def content_hash(c: Column | str) -> Column:
    """Identity of a text."""
    return F.sha2(col(c), 256)


def content_key(c: Column | str) -> Column:
    """Short identity of a text, the first half of its hash: by it rows name a text that is stored once."""
    return F.substring(F.unhex(content_hash(c)), 1, 16)


def legacy_hash(c: Column | str) -> Column:
    """32-bit ``h*31 + c`` hash in base 36; a compatibility column, never an identity."""
    value = F.abs(F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), col(c)).cast("bigint"))
    return F.lower(F.conv(value.cast("string"), 10, 36))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Map lookup that stays inside the projection (fixed, small tables only)."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def format_bytes(c: Column | str) -> Column:
    """``1536 -> '1.5 KB'``: two decimals at most, trailing zeros dropped."""
    c = col(c).cast("double")
    unit = (F.when(c < 1024, F.lit(0)).when(c < 1024 ** 2, F.lit(1)).when(c < 1024 ** 3, F.lit(2))
            .otherwise(F.lit(3)))
    number = F.format_string("%.2f", F.round(c / F.pow(F.lit(1024.0), unit), 2))
    short = F.regexp_replace(F.regexp_replace(number, r"0+$", ""), r"\.$", "")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Bytes", "KB", "MB", "GB")]), unit + 1)
    return F.concat(short, F.lit(" "), name)


def truncate(c: Column | str, width: int = 50) -> Column:
    c = col(c)
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 3), F.lit("...")))


def normalise_blanks(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("  "))
