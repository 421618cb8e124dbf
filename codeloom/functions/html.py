"""HTML as text: noise removal, entity decoding and in-row block segmentation.

Blocks are cut inside the row with regular expressions, so extraction is a
map-only stage: no token rows, no shuffle, one pass per page.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.functions.text import col, extract, once, strip

NOISE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
TAG = r"<[^>]*>"
BLOCK_END = (r"(?is)</?(?:p|li|ul|ol|dl|div|pre|table|h[1-6]|article|section|nav|footer|header|main|"
             r"blockquote|figure|body|html)(?:[ \t\r\n/][^>]*)?>.*")

_MARK, _ATTR, _BODY = "\u0001", "\u0002", "\u0003"


def without_noise(html: Column | str) -> Column:
    """Drop comments, scripts and styles."""
    return F.regexp_replace(col(html), NOISE, "")


def without_tags(html: Column | str) -> Column:
    return F.regexp_replace(col(html), TAG, "")


def _character(number: Column) -> Column:
    """The character of a reference's number, as UTF-8 bytes put together."""
    n = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substring(number, F.lit(2), F.length(number)), 16, 10)).otherwise(number).cast("bigint")
    n = F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(n)

    def tail(place: int) -> Column:
        return 0x80 + F.shiftright(n, 6 * place).bitwiseAND(F.lit(0x3F))

    code = (F.when(n < 0x80, n).when(n < 0x800, (0xC0 + F.shiftright(n, 6)) * 0x100 + tail(0))
            .when(n < 0x10000, ((0xE0 + F.shiftright(n, 12)) * 0x100 + tail(1)) * 0x100 + tail(0))
            .otherwise((((0xF0 + F.shiftright(n, 18)) * 0x100 + tail(2)) * 0x100 + tail(1)) * 0x100 + tail(0)))
    return F.decode(F.unhex(F.hex(code)), "UTF-8")


def decode_entities(c: Column | str) -> Column:
    """Six named entities, decimal and hexadecimal references; ``&amp;`` last, so nothing is decoded twice.

    A number that is no character becomes U+FFFD.
    """
    out = col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))

    def numeric(text: Column) -> Column:
        numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))
        decoded = F.aggregate(numbers, text, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), _character(n)))
        return F.replace(F.when(text.contains("&#"), decoded).otherwise(text), F.lit("&amp;"), F.lit("&"))

    return F.when(col(c).contains("&"), once(out, numeric)).otherwise(col(c))


def escape(c: Column | str) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def text_content(html: Column | str) -> Column:
    """Decoded text of a fragment."""
    return once(without_tags(html), decode_entities)


def segments(html: Column | str, tags: list[str]) -> Column:
    """``array<struct<tag, attrs, body>>``: one entry per opening tag in ``tags``.

    ``body`` runs to the next opening tag in ``tags`` or the end of the page;
    the caller cuts it at the element's end.
    """
    opening = rf"(?i)<({'|'.join(tags)})((?:[ \t\r\n][^>]*)?)>"
    marked = F.regexp_replace(col(html), opening, f"{_MARK}$1{_ATTR}$2{_BODY}")
    parts = F.split(marked, _MARK)
    return F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.struct(
            F.lower(F.substring_index(p, _ATTR, 1)).alias("tag"),
            F.substring_index(F.substring_index(p, _BODY, 1), _ATTR, -1).alias("attrs"),
            F.substring(p, F.instr(p, _BODY) + 1, F.length(p)).alias("body")))


def attribute(attrs: Column, name: str) -> Column:
    """Value of a quoted or bare attribute, null when absent."""
    return F.coalesce(extract(attrs, rf'(?i)(?:^|[ \t\r\n]){name}[ \t\r\n]*=[ \t\r\n]*"([^"]*)"'),
                      extract(attrs, rf"(?i)(?:^|[ \t\r\n]){name}[ \t\r\n]*=[ \t\r\n]*'([^']*)'"),
                      extract(attrs, rf"(?i)(?:^|[ \t\r\n]){name}[ \t\r\n]*=[ \t\r\n]*([^ \t\r\n\"'>]+)"))


def prose_text(segment: Column) -> Column:
    """Text of a paragraph or list item: ends at its own or any other block-level tag."""
    return strip(text_content(F.regexp_replace(segment["body"], BLOCK_END, "")))


def code_text(segment: Column) -> Column:
    """Text of a ``pre`` element, or of the ``code`` element directly inside it."""
    def content(body: Column) -> Column:
        inner = F.regexp_extract(body, r"(?is)<code(?:[ \t\r\n][^>]*)?>(.*?)(?:</code>|\z)", 1)
        return F.when(body.rlike(r"(?i)<code[ \t\r\n>]"), inner).otherwise(body)

    body = F.regexp_replace(segment["body"], r"(?is)</pre>.*", "")
    return strip(text_content(once(body, content)))


def code_attributes(segment: Column) -> Column:
    """Attributes of the inner ``code`` tag followed by those of its ``pre``."""
    inner = F.regexp_extract(segment["body"], r"(?is)^[^<]*<code((?:[ \t\r\n][^>]*)?)>", 1)
    return F.concat(inner, F.lit(" "), segment["attrs"])


def headings(html: Column | str, level: int) -> Column:
    """Trimmed texts of all headings of one level, in document order."""
    raw = F.regexp_extract_all(col(html), F.lit(rf"(?is)<h{level}(?:[ \t\r\n][^>]*)?>(.*?)</h{level}>"), F.lit(1))
    return F.transform(raw, lambda h: strip(text_content(h)))


def title(html: Column | str) -> Column:
    return strip(text_content(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
