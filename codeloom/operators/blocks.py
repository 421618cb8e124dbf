"""Block extraction from pages and messages: map-only jobs, numbered inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import html as H, language as G
from codeloom.functions.text import col, computed, content_hash, line_count, presence, strip
from codeloom.rules import naming as N
from codeloom.rules.sites import GENERIC_SITE, SITES, SiteRule

MIN_BLOCK = 10


def site_of(url: Column | str, rules: list[SiteRule] = SITES) -> Column:
    """First matching site rule, else the generic site."""
    url = col(url)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        chain = chain.when(url.rlike(rule.pattern), F.lit(rule.site))
    return chain.otherwise(F.lit(GENERIC_SITE))


def route_sites(pages: DataFrame, rules: list[SiteRule] = SITES) -> DataFrame:
    return pages.withColumn("site", site_of("url", rules))


def _numbered(pages: DataFrame, blocks: Column) -> DataFrame:
    kept = F.filter(blocks, lambda b: F.length(b["code"]) >= MIN_BLOCK)
    out = pages.select("page_id", "url", F.posexplode(kept).alias("block_index", "b"))
    return out.select(
        "page_id", "block_index", "b.*", site_of("url").alias("source"), "url",
        F.length("b.code").alias("size"), line_count("b.code").alias("lines"))


def extract_prose_blocks(pages: DataFrame, tags: tuple[str, ...] = ("p", "li")) -> DataFrame:
    """Paragraph-like elements as blocks; an unclosed element ends at the next block-level tag."""
    segments = H.segments(H.without_noise("html"), list(tags))
    return _numbered(pages, F.transform(segments, lambda s: F.struct(
        H.prose_text(s).alias("code"), F.lit("text").alias("language"), s["tag"].alias("tag"))))


def extract_code_blocks(pages: DataFrame) -> DataFrame:
    """``pre`` elements (or the ``code`` inside) with the language named by their attributes."""
    segments = H.segments(H.without_noise("html"), ["pre"])

    def block(s: Column) -> Column:
        return F.struct(H.code_text(s).alias("code"), H.code_attributes(s).alias("attrs"))

    out = _numbered(pages, F.transform(segments, block))
    attrs = F.col("attrs")
    out = out.withColumn("classes", F.lower(F.coalesce(H.attribute(attrs, "class"), F.lit("")))).withColumn(
        "data_language", F.coalesce(H.attribute(attrs, "data-language"), H.attribute(attrs, "data-lang"),
                                    H.attribute(attrs, "language"))).drop("attrs")
    language = F.coalesce(F.lower(presence("data_language")), _class_language("classes"), F.lit("text"))
    return out.withColumn("language", language)


def _class_language(classes: Column | str) -> Column:
    return F.coalesce(*[presence(F.regexp_extract(col(classes), p, 1))
                        for p in (r"language-(\w+)", r"lang-(\w+)", r"hljs\s+(\w+)")])


def block_languages(blocks: DataFrame) -> DataFrame:
    """Language from class patterns, data attribute, header label or content."""
    return blocks.withColumn("block_language", G.from_attributes(
        F.coalesce("classes", F.lit("")), F.col("data_language"), F.col("label"), F.col("code")))


def scoped(blocks: DataFrame, selections: DataFrame) -> DataFrame:
    """Blocks inside a selected region of their page, renumbered per page."""
    s = selections.select(F.col("page_id").alias("s_page"), "from_pos", "to_pos")
    inside = blocks.join(s, (F.col("page_id") == F.col("s_page"))
                         & F.col("block_index").between(F.col("from_pos"), F.col("to_pos")), "left_semi")
    w = Window.partitionBy("page_id").orderBy("block_index")  # a page is one input row, so the group is bounded
    return inside.withColumn("block_index", F.row_number().over(w) - 1)


def fenced_blocks(messages: DataFrame, text: str = "text") -> DataFrame:
    """Markdown fences of each message; a fence without closing marks is no block.

    Texts are searched once: a fence's code is what stands between its first line and its closing marks.
    """
    whole = F.regexp_extract_all(col(text), F.lit("(?s)```(\\w+)?\\n.*?```"), F.lit(0))
    rest = [c for c in messages.columns if c != text]
    out = computed(messages, _f=whole).select(*rest, F.posexplode("_f").alias("block_index", "fence"))
    head = F.instr("fence", "\n")
    return (out.withColumn("language", F.coalesce(presence(F.regexp_extract("fence", r"^```(\w+)?\n", 1)), F.lit("text")))
            .withColumn("code", F.substr("fence", head + 1, F.length("fence") - head - 3)).drop("fence"))


def with_fingerprint(blocks: DataFrame, content: str = "code") -> DataFrame:
    return (blocks.withColumn("hash", content_hash(content)).withColumn("size", F.length(content))
            .withColumn("lines", line_count(content)))


def of_language(blocks: DataFrame, language: str) -> DataFrame:
    return blocks.where(F.col("language") == language.lower())


def with_keyword(blocks: DataFrame, keyword: str) -> DataFrame:
    low = keyword.lower()
    test = F.lit(False)
    for c in ("code", "label", "surrounding_text"):
        if c in blocks.columns:
            test = test | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return blocks.where(test)


def page_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.sum("size").alias("size"), F.sum("lines").alias("lines"))


def page_languages(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("page_id", "language").agg(F.count("*").alias("blocks"))


def project_names(pages: DataFrame) -> DataFrame:
    """``[Platform] heading``: first specific h1/h2 of 3 to 49 characters, else the cleaned page title."""
    heads = F.concat(H.headings("html", 1), H.headings("html", 2))
    specific = F.filter(heads, lambda h: F.length(h).between(3, 49)
                        & ~F.lower(h).isin(*N.GENERIC_HEADINGS))
    caption = H.title("html")
    for suffix in N.TITLE_SUFFIXES:
        caption = F.regexp_replace(caption, suffix, "")
    caption = strip(F.regexp_replace(strip(caption), "[^a-zA-Z0-9 _-]", ""))
    host = H.host("url")
    platform = F.when(F.lit(False), F.lit(None).cast("string"))
    for needle, name in N.PLATFORMS:
        platform = platform.when(host.contains(needle), F.lit(name))
    return pages.select("page_id", F.concat(
        F.lit("["), platform.otherwise(F.lit("Web")), F.lit("] "),
        F.coalesce(F.get(specific, 0), presence(caption), F.lit("Extracted Project"))).alias("project_name"))


def file_mentions(texts: DataFrame, text: str = "text") -> DataFrame:
    """Every file-like token of a text, in order."""
    found = F.regexp_extract_all(col(text), F.lit(N.FILE_LIKE), F.lit(1))
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(found).alias("position", "mention"))
