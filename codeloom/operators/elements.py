"""Elements of stored pages with their chain of ancestors: site rules, messages, labels, context.

A page is tokenised and folded inside its row, keeping the stack of open tags; elements come
out with their opening-tag chain and extent. All jobs but the per-page repeat filters are map-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import html as H
from codeloom.functions.selectors import chain_pattern, tag_pattern
from codeloom.functions.text import computed, once, presence, strip
from codeloom.operators.blocks import site_of
from codeloom.operators.site_rules import by_url
from codeloom.rules import sites as R
from codeloom.session import cut_lineage

VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
CODE_LIKE = r'(?i)^<(?:pre|code|code-block)[\s>]|\sclass="[^"]*(?:code|CodeMirror|editor)|\sdata-(?:code|lang)'
CONTAINERS = r'(?i)^<(?:article|main|section)[\s>]|\sclass=|\sdata-(?:testid|message)'
_STATE = ("struct<stack:array<struct<name:string,raw:string,at:int,wanted:boolean>>,"
          "out:array<struct<at:int,until:int,chain:string>>>")


def _ended(stack: Column, place: Column, until: Column) -> Column:
    """The wanted ones among the open tags from ``place`` on, as elements that end at ``until``."""
    above = F.transform(F.slice(stack, place, F.size(stack)), lambda s, n: F.struct(
        s["at"].alias("at"), until.alias("until"), F.when(s["wanted"], F.array_join(F.transform(
            F.slice(stack, F.lit(1), place + n), lambda o: o["raw"]), "")).alias("chain")))
    return F.filter(above, lambda f: f["chain"].isNotNull())


def _closed(acc: Column, e: Column, i: Column) -> Column:
    """Pop the nearest open tag of that name with everything above it; nothing without one.

    Elements above it were not closed themselves and end there too.
    """
    stack = acc["stack"]

    def pop(place: Column) -> Column:
        out = F.concat(acc["out"], _ended(stack, place, i))
        kept = F.struct(F.slice(stack, F.lit(1), place - 1).alias("stack"), out.alias("out"))
        return F.when(place == 0, acc).otherwise(kept.cast(_STATE))

    # depth of the nearest open tag of that name: position from the top of the stack
    from_top = F.array_position(F.transform(F.reverse(stack), lambda s: s["name"]), e["name"])
    return once(F.when(from_top > 0, F.size(stack) - from_top + 1).otherwise(F.lit(0)).cast("int"), pop)


def elements(pages: DataFrame, wanted: str, inside: str | None = None) -> DataFrame:
    """``page_id, url, at, chain, tag, text`` of elements whose opening tag matches ``wanted``.

    An element without end tag ends with the one it stands in, or with the page. ``inside`` is a pattern that every page
    with a wanted tag has in its text: other pages are not taken apart.
    """
    clean = computed(pages.select("page_id", "url", "html"), clean=H.without_noise("html")).drop("html")
    clean = clean if inside is None else clean.where(F.col("clean").rlike(inside))
    rows = computed(clean, tokens=F.regexp_extract_all("clean", F.lit(r"<[^>]*>|[^<]+"), F.lit(0)))
    marks = F.transform("tokens", lambda t, i: F.struct(
        F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][\w-]*)", 1)).alias("name"), F.startswith(t, F.lit("</")).alias("closes"),
        F.endswith(t, F.lit("/>")).alias("alone"), t.alias("raw"), (i + 1).alias("at"), t.rlike(wanted).alias("wanted")))
    marks = F.filter(marks, lambda m: (m["name"] != "") & ~m["name"].isin(*VOID) & ~m["alone"])

    def step(acc: Column, e: Column) -> Column:
        pushed = F.struct(F.concat(acc["stack"], F.array(F.struct(e["name"].alias("name"), e["raw"].alias("raw"), e["at"].alias("at"), e["wanted"].alias("wanted")))).alias("stack"),
                          acc["out"].alias("out")).cast(_STATE)
        return F.when(e["closes"], _closed(acc, e, e["at"])).otherwise(pushed)

    start = F.from_json(F.lit('{"stack":[],"out":[]}'), _STATE)
    found = F.aggregate(marks, start, step, lambda acc: F.concat(acc["out"], _ended(acc["stack"], F.lit(1), F.size("tokens") + 1)))
    rows = computed(rows.select("page_id", "url", "tokens"), found=found)
    texts = F.transform("found", lambda f: F.struct(
        f["at"].alias("at"), f["chain"].alias("chain"),
        H.decode_entities(F.array_join(F.filter(F.slice(F.col("tokens"), f["at"] + 1, f["until"] - f["at"] - 1),
                                                lambda t: ~F.startswith(t, F.lit("<"))), "")).alias("text")))
    out = rows.select("page_id", "url", F.explode(texts).alias("f")).select("page_id", "url", "f.*")
    return out.withColumn("tag", F.regexp_extract("chain", r"(<[^>]*>)\z", 1))


def _first_rule(selectors: list[str]) -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for i, s in enumerate(selectors):
        chain = chain.when(F.col("chain").rlike(chain_pattern(s)), F.lit(i))
    return chain


def generic_blocks(pages: DataFrame) -> DataFrame:
    """Code-like elements of any page in rule order; equal texts appear once."""
    e = computed(elements(pages, CODE_LIKE), priority=_first_rule(R.GENERIC_SELECTORS)).where("priority IS NOT NULL")
    e = e.where((F.length("text") >= 15) & F.col("text").rlike(r"\S"))
    w = Window.partitionBy("page_id", F.sha2(strip("text"), 256)).orderBy("priority", "at")  # within one page
    first = e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    order = Window.partitionBy("page_id").orderBy("priority", "at")
    return first.withColumn("code", strip("text")).where(F.length("code") >= 10).withColumn(
        "block_index", F.row_number().over(order) - 1).drop("text")


def _wanted(known: str, selectors: list[str]) -> str:
    """Opening tags that the built-in or the users' selectors can pick."""
    return "|".join([known, *dict.fromkeys(f"(?:{tag_pattern(s)})" for s in selectors)])


def site_blocks(pages: DataFrame, rules: list[R.SiteRule] = R.SITES) -> DataFrame:
    """Elements picked by the rules of the page's site; pages of other sites give none here.

    Under a user's rule ``label`` is the text of the nearest earlier element that its label selectors pick.
    """
    own = [s for r in rules for s in (*r.blocks, *r.labels)]
    e = elements(pages, _wanted(CODE_LIKE, own)).withColumn("site", site_of("url", rules))
    priority = by_url(rules, lambda r: _first_rule(list(r.blocks) or R.BLOCK_SELECTORS.get(r.site, []) if r else []))
    label = F.lit(None).cast("string")
    if any(r.labels for r in rules):
        picked = by_url(rules, lambda r: _first_rule(list(r.labels) if r else []))
        e = computed(e, _label=F.when(picked.isNotNull(), presence(strip("text"))))
        label = F.last("_label", True).over(Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    e = computed(e.withColumn("label", label).drop("_label"), priority=priority, code=strip("text")).where((F.length("code") >= 10) & F.col("priority").isNotNull())
    order = Window.partitionBy("page_id").orderBy("priority", "at")
    classes = F.lower(H.attribute("tag", "class"))
    language = F.coalesce(presence(F.regexp_extract(classes, r"language-(\w+)", 1)), presence(F.regexp_extract(classes, r"lang-(\w+)", 1)),
                          F.lower(H.attribute("tag", "data-language")), F.lower(H.attribute("tag", "language")), F.lit("text"))
    return e.withColumn("block_index", F.row_number().over(order) - 1).withColumn("language", language).drop("text", "chain", "tag")


def message_containers(pages: DataFrame, rules: list[R.SiteRule] = R.SITES) -> DataFrame:
    """Containers by the first of the site's selectors that matches anything on the page."""
    e = elements(pages, _wanted(CONTAINERS, [s for r in rules for s in r.containers])).withColumn("site", site_of("url", rules))
    rule = by_url(rules, lambda r: _first_rule((list(r.containers) or R.MESSAGE_SELECTORS.get(r.site, [])) if r else R.MESSAGE_SELECTORS[R.GENERIC_SITE]))
    e = computed(e, priority=rule).where("priority IS NOT NULL")
    best = F.min("priority").over(Window.partitionBy("page_id"))
    return e.withColumn("_b", best).where("priority = _b").drop("_b")


def conversation(pages: DataFrame) -> DataFrame:
    """``page_id, at, author, text`` of message nodes; a page without any gives its whole body."""
    own = "|".join(tag_pattern(s) for s in R.CONVERSATION_SELECTORS)
    e = elements(pages, own, own).where(_first_rule(R.CONVERSATION_SELECTORS).isNotNull())
    e = computed(e.withColumnRenamed("text", "raw_text"), text=strip("raw_text")).where("text <> ''")
    classes = F.lower(F.coalesce(H.attribute("tag", "class"), F.lit("")))
    author = (F.when(classes.rlike(R.USER_CLASS), F.lit("User")).when(classes.rlike(R.ASSISTANT_CLASS), F.lit("Assistant"))
              .otherwise(F.lit("Unknown")))
    found = e.select("page_id", "at", author.alias("author"), "text", classes.alias("classes")).groupBy("page_id", "text", "classes").agg(
        F.min(F.struct("at", "author")).alias("m")).select("page_id", "m.at", "m.author", "text")
    found = cut_lineage(found)  # pages are gone through once, though the found ones are asked for twice
    body = F.coalesce(presence(F.regexp_extract("clean", r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)), F.col("clean"))
    rest = computed(pages.join(found.select("page_id"), "page_id", "left_anti").select("page_id", "html"), clean=H.without_noise("html"))
    rest = computed(computed(rest, body=body), text=strip(H.text_content("body"))).select(
        "page_id", F.lit(0).alias("at"), F.lit("Unknown").alias("author"), "text").where("text <> ''")
    return found.unionByName(rest)


# --- labels and context: the pieces of a page between its blocks --------------------------------
def _plain(fragment: Column) -> Column:
    """Text of a fragment, one line per element, blank lines dropped."""
    text = H.decode_entities(F.regexp_replace(fragment, "<[^>]*>", "\n"))
    return strip(F.regexp_replace(text, r"[ \t\r]*\n\s*", "\n"))


def _last_match(fragment: Column, pattern: str) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(fragment, F.lit(pattern), F.lit(1)), lambda x: strip(H.text_content(x))), lambda x: x != "")
    return once(found, lambda f: F.get(f, F.size(f) - 1))


HEADING = r"(?is)(<h[1-4][^>]*>.*?</h[1-4]>|<p[^>]*>\s*<(?:strong|b)>.*?</(?:strong|b)>)"
NAMED = r'(?is)<\w+[^>]*\sclass="[^"]*(?:filename|file-name|tab-name|label|header)[^"]*"[^>]*>([^<]*)<'
VOTES = r'(?is)<\w+[^>]*\sclass="[^"]*vote-count[^"]*"[^>]*>([^<]*)<'
BOT = r'(?is)<\w+[^>]*\sclass="[^"]*(?:botName|bot-name|author)[^"]*"[^>]*>([^<]*)<'
BEFORE, SURROUNDING = 300, 1000


def block_contexts(pages: DataFrame) -> DataFrame:
    """Label, nearest heading and the text before, after and around every ``pre`` block of a page."""
    clean = H.without_noise("html")
    segments = H.segments(clean, ["pre"])
    head = F.get(F.split(clean, r"(?i)<pre(?:[ \t\r\n][^>]*)?>"), 0)
    gaps = F.concat(F.array(head), F.transform(segments, lambda s: F.regexp_replace(s["body"], r"(?is)^.*?</pre>", "")))
    rows = computed(pages, segments=segments, gaps=gaps).select("page_id", "url", "gaps", F.posexplode("segments").alias("n", "s"))
    rows = computed(rows, code=H.code_text(F.col("s"))).where(F.length("code") >= 10)
    before, after = F.get("gaps", F.col("n")), F.get("gaps", F.col("n") + 1)
    heads = F.filter(F.transform(F.slice("gaps", F.lit(1), F.col("n") + 1), lambda g: _last_match(g, HEADING)), lambda h: h.isNotNull())
    rows = computed(rows, b=before, bt=_plain(before), at=_plain(after), heading=once(heads, lambda h: F.get(h, F.size(h) - 1)))
    own_line = once(F.substring_index("bt", "\n", -1), lambda x: F.when((x != "") & (F.length(x) < 100), x))
    file_label = _last_match(F.col("b"), NAMED)
    votes, bot = _last_match(F.col("b"), VOTES), _last_match(F.col("b"), BOT)
    site = site_of("url")
    label = (F.when((site == "Stack Overflow") & votes.isNotNull(), F.concat(F.lit("Answer (score: "), votes, F.lit(")")))
             .when((site == "Stack Overflow") & F.col("b").rlike(r'\sclass="(?:[^"]*\s)?answer[\s"]'), F.lit("Answer"))
             .when((site == "Stack Overflow") & F.col("b").rlike(r'\sclass="(?:[^"]*\s)?question[\s"]'), F.lit("Question"))
             .when((site == "Poe") & bot.isNotNull(), F.concat(bot, F.coalesce(F.concat(F.lit(": "), file_label), F.lit(""))))
             .otherwise(F.coalesce(file_label, own_line)))
    tail = F.when(F.length("bt") > BEFORE, F.right("bt", F.lit(BEFORE))).otherwise(F.col("bt"))
    text_before = F.substring(strip(F.concat(F.coalesce(F.concat("heading", F.lit("\n")), F.lit("")), tail)), 1, BEFORE)
    return rows.select(
        "page_id", F.col("n").alias("pre_index"), "code", label.alias("label"), "heading", text_before.alias("text_before"),
        F.substring("at", 1, BEFORE).alias("text_after"),
        F.substring(strip(F.concat(tail, F.lit(" "), F.col("at"))), 1, SURROUNDING).alias("surrounding_text"))
