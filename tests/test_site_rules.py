"""Rules that users make: changes, exchange, and the pages they apply to."""

import pytest

from codeloom.operators import elements as E, site_rules as SR
from codeloom.plans import CHECKS
from codeloom.rules.sites import SITES

PAGE = ('<html><body><h3 class="cap">First</h3><div class="snip" id=a>alpha beta gamma</div><div class="cap">  </div><section data-x="1"><span>'
        '<b>Second name</b></span><div class="other snip">delta epsilon zeta</div></section><pre><code>built in code</code></pre></body></html>')


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("r1", "One", "site.test", ["div.snip"], [".cap", "span > b"], ["section[data-x]"], 1, False),
            ("r2", "", "x.test", ["pre"], [], [], 2, False), ("r3", "Three", "three.test", ["pre"], None, [], 3, False),
            ("r3", None, None, None, None, None, 4, True), ("r4", "Four", "four.test", [" "], None, [], 5, True), ("r4", "Four", "four.test", ["pre"], None, [], 6, False),
            ("r5", "Mine", "claude.ai", ["b"], [], [], 7, None)]
    return spark.createDataFrame(rows, SR.RULE + ", seq long, deleted boolean")


def test_changes_findings_and_compiling(spark, rules):
    now = SR.current(rules)
    assert sorted(r["rule_id"] for r in now.collect()) == ["r1", "r2", "r4", "r5"]
    assert [tuple(r) for r in SR.findings(now).collect()] == [("r2", "no name")]
    own = SR.compiled(now)
    assert [r.site for r in own[:3]] == ["Mine", "Four", "One"] and own[3:] == SITES
    none = SR.findings(spark.createDataFrame([("e", None, " ", None, [], [""])], SR.RULE))
    assert sorted(r["finding"] for r in none.collect()) == ["no domain", "no name", "no selector"]


def test_too_many_rules(rules, monkeypatch):
    monkeypatch.setattr(SR, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        SR.compiled(SR.current(rules))


def test_exchange_gives_the_same_rules_under_new_ids(spark, rules):
    now = SR.current(rules)
    lines = SR.to_json(now)
    back = SR.from_json(lines.unionByName(spark.createDataFrame([("{",), ('{"format":"codeloom-site-rule"}',), (None,)], "value string")))
    problems = sorted((r["problem"] or "") for r in back.collect())
    assert problems == ["", "", "", "", "no rule in it", "not a site rule", "not a site rule"]
    columns = ["name", "domain", *SR.SELECTORS]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, back.where("problem IS NULL").select(columns).collect())) == sorted(map(key, now.select(columns).collect()))
    assert back.where("rule_id LIKE 'imported-%'").count() == back.count()


def test_pages_of_the_domain(spark, rules):
    pages = spark.createDataFrame([(1, "https://www.site.test/a", PAGE), (2, "https://notsite.test/a", PAGE), (3, "http://claude.ai/x", PAGE), (4, "https://site.test:80", PAGE)],
                                  "page_id long, url string, html string")
    own = SR.compiled(SR.current(rules))
    blocks = {(r["page_id"], r["site"], r["code"], r["label"]) for r in E.site_blocks(pages, own).collect()}
    both = {(p, "One", c, n) for p in (1, 4) for c, n in (("alpha beta gamma", "First"), ("delta epsilon zeta", "Second name"))}
    assert blocks == both | {(3, "Mine", "Second name", None)}
    found = {(r["page_id"], r["tag"]) for r in E.message_containers(pages.where("page_id IN (1, 2, 4)"), own).collect()}
    assert {(1, '<section data-x="1">'), (4, '<section data-x="1">')} <= found and {t for p, t in found if p == 1} == {'<section data-x="1">'}
    assert {r["site"] for r in E.site_blocks(pages).collect()} == {"Claude"}


def test_checks_have_rows(duck):
    for name in ("x1_own_rule_blocks", "x1_own_rule_containers", "x1_own_rules_on_code_pages", "x2_saved_rules"):
        assert duck.execute(f"SELECT count(*) FROM ({CHECKS[name]})").fetchone()[0] > 0
