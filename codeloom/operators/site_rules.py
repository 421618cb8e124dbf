"""Site rules that users make: rows of a table, compiled at run time to what the page jobs take.

A rule has a name, a domain and selectors for blocks, labels and message containers. Changes of rules are rows too:
the newest row of a rule holds, and one marked ``deleted`` takes the rule away until it is saved again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.selectors import chain_pattern
from codeloom.rules.sites import SITES, SiteRule

SELECTORS = ["block_selectors", "label_selectors", "container_selectors"]
RULE = "rule_id string, name string, domain string, " + ", ".join(f"{s} array<string>" for s in SELECTORS)
FORMAT, VERSION = "codeloom-site-rule", "1.0.0"
#: Rules that one job compiles at most; a table with more raises, since every page is tested against each.
MOST_RULES = 1000


def current(changes: DataFrame) -> DataFrame:
    """Rules after all changes (``RULE`` columns, ``seq``, ``deleted``), with the ``seq`` of their newest row."""
    columns = ["rule_id", "name", "domain", *SELECTORS]
    newest = F.max_by(F.struct(*columns, "deleted"), "seq").alias("r")
    rows = changes.groupBy("rule_id").agg(newest, F.max("seq").alias("seq"))
    return rows.where("NOT coalesce(r.deleted, false)").select("r.*", "seq").drop("deleted")


def findings(rules: DataFrame) -> DataFrame:
    """What keeps a rule from being used, one row per finding."""
    none = [F.coalesce(F.size(F.filter(s, lambda x: F.trim(x) != "")), F.lit(0)) <= 0 for s in SELECTORS]
    checks = F.array(
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("no name")), F.when(F.trim(F.coalesce("domain", F.lit(""))) == "", F.lit("no domain")),
        F.when(none[0] & none[1] & none[2], F.lit("no selector")))
    return rules.select("rule_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("finding"))


def to_json(rules: DataFrame) -> DataFrame:
    """One document a rule, as text lines."""
    body = F.struct(*[F.col(c) for c in ("name", "domain", *SELECTORS)])
    return rules.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), body.alias("rule"))).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """Rules of such lines under new ids, with ``problem`` for lines that hold none.

    The id is made of the line's content, so a line that is imported again gives the same rule.
    """
    body = f"name string, domain string, {', '.join(f'{s} array<string>' for s in SELECTORS)}"
    parsed = lines.select("value", F.from_json("value", f"format string, version string, rule struct<{body.replace(' ', ':').replace(',:', ',')}>").alias("j"))
    problem = F.when(F.coalesce(F.col("j.format"), F.lit("")) != FORMAT, F.lit("not a site rule")).when(F.col("j.rule").isNull(), F.lit("no rule in it"))
    return parsed.select(F.concat(F.lit("imported-"), F.substring(F.sha2(F.coalesce("value", F.lit("")), 256), 1, 16)).alias("rule_id"),
                         *[F.col(f"j.rule.{c}").alias(c) for c in ("name", "domain", *SELECTORS)], problem.alias("problem"))


def _pattern(domain: str) -> str:
    """URLs of the domain and of what lies below it."""
    return rf"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:[^/?#:]*\.)?{re.escape(domain.strip().lower())}(?:[:/?#]|$)"


def compiled(rules: DataFrame) -> list[SiteRule]:
    """The usable rules, newest first, ahead of the built-in ones; selectors are checked by compiling them."""
    usable = rules.join(findings(rules).select("rule_id").distinct(), "rule_id", "left_anti")
    rows = usable.orderBy(F.desc("seq"), "rule_id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} site rules")
    own = []
    for r in rows:
        blocks, labels, containers = (tuple(s.strip() for s in r[c] or [] if s and s.strip()) for c in SELECTORS)
        for selector in (*blocks, *labels, *containers):
            re.compile(chain_pattern(selector).replace(r"\z", r"\Z"))
        own.append(SiteRule(r["name"].strip(), _pattern(r["domain"]), blocks, labels, containers))
    return [*own, *SITES]


def by_url(rules: list[SiteRule], value) -> Column:
    """``value(rule)`` of the first rule that the page's URL meets, else ``value(None)``."""
    chain = F.when(F.lit(False), value(None))
    for rule in rules:
        chain = chain.when(F.col("url").rlike(rule.pattern), value(rule))
    return chain.otherwise(value(None))
