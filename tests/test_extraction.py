"""Block extraction, entities, sites and trees on hand-worked inputs."""

from pyspark.sql import functions as F

from codeloom.functions import html as H
from codeloom.functions.selectors import chain_pattern
from codeloom.operators import blocks as B, elements as E, trees as T
import re


def pages(spark, *html, url="https://example.org/a"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id bigint, url string, html string")


def code(spark, html):
    return [(r.code, r.language) for r in B.extract_code_blocks(pages(spark, html)).orderBy("block_index").collect()]


def test_code_and_language(spark):
    got = code(spark, '<pre><code class="language-python">import flask\napp = Flask(__name__)</code></pre>')
    assert got == [("import flask\napp = Flask(__name__)", "python")]


def test_entities_are_decoded_once(spark):
    got = code(spark, "<pre><code>&lt;div&gt;Hello &amp; &amp;lt; &#233;&lt;/div&gt;</code></pre>")
    assert got == [("<div>Hello & &lt; é</div>", "text")]


def test_empty_and_short_blocks_are_dropped(spark):
    assert code(spark, "<pre><code></code></pre><pre><code>   </code></pre><pre>short</pre>") == []


def test_pre_and_code_count_once_and_keep_indentation(spark):
    text = 'def hello():\n    print("world")\n    return True'
    assert code(spark, f'<pre>\n<code class="hljs language-js">{text}</code></pre>') == [(text, "javascript" if False else "js")]


def test_three_blocks_in_order_and_hidden_ones_skipped(spark):
    html = ("<script>'<pre>not this one</pre>'</script><!-- <pre>nor this one</pre> -->"
            + "".join(f"<pre><code>block number {i}</code></pre>" for i in range(3)))
    assert [c for c, _ in code(spark, html)] == ["block number 0", "block number 1", "block number 2"]


def test_unclosed_paragraphs_end_at_the_next_block_tag(spark):
    html = "<p>first paragraph<p>second <b>paragraph</b></p><ul><li>one list item<li>another list item</ul>tail"
    got = [r.code for r in B.extract_prose_blocks(pages(spark, html)).orderBy("block_index").collect()]
    assert got == ["first paragraph", "second paragraph", "one list item", "another list item"]


def test_fences(spark):
    df = spark.createDataFrame([(1, "a\n```python\nx = 1\n```\nb\n```\nplain\n```\n```open\nnever closed")], "id int, text string")
    got = [(r.block_index, r.language, r.code) for r in B.fenced_blocks(df).orderBy("block_index").collect()]
    assert got == [(0, "python", "x = 1\n"), (1, "text", "plain\n")]


def test_sites(spark):
    urls = {"https://chat.openai.com/c/1": "ChatGPT", "https://claude.ai/chat": "Claude", "https://poe.com/x": "Poe",
            "https://notpoe.example/": "Generic", "https://stackoverflow.com/q/1": "Stack Overflow"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.site for r in B.route_sites(df).collect()} == urls


def test_selectors():
    chain = '<div class="code-box x"><section><pre class="a language-js"><code data-lang="js">'
    for selector, expected in [("pre > code", True), ("pre code", True), ("section > code", False), ('div[class*="code"] pre > code', True),
                               ('div[class*="code"] > pre', False), ("[data-lang]", True), (".language-js code", True), (".language code", False)]:
        assert bool(re.search(chain_pattern(selector).replace(r"\z", r"\Z"), chain)) is expected, selector


def test_site_rules_use_ancestors_and_priority(spark):
    html = '<div class="code-block"><code class="language-go">package main; func main</code></div><pre><code>second block text</code></pre>'
    got = E.site_blocks(pages(spark, html, url="https://claude.ai/x")).orderBy("block_index").collect()
    assert [(r.code, r.language) for r in got] == [("second block text", "text"), ("package main; func main", "go")]


def test_generic_rules_keep_one_of_equal_texts(spark):
    html = '<div class="highlight"><pre><code>def first_one(): pass</code></pre></div><td><code>def first_one(): pass</code></td><pre>tiny</pre>'
    assert [r.code for r in E.generic_blocks(pages(spark, html)).collect()] == ["def first_one(): pass"]


def test_conversation_authors_repeats_and_fallback(spark):
    html = ('<body><div class="message user">hi</div><div class="message bot">hello</div><div class="message user">hi</div>'
            '<div class="msg">who</div></body>')
    got = {(r.page_id, r.author, r.text) for r in E.conversation(pages(spark, html, "<body><p>plain</p></body>")).collect()}
    assert got == {(0, "User", "hi"), (0, "Assistant", "hello"), (0, "Unknown", "who"), (1, "Unknown", "plain")}


def test_answer_and_bot_labels(spark):
    so = '<div class="answer"><span class="vote-count">42</span><pre><code>select 1 from dual</code></pre></div>'
    poe = '<div class="Message"><b class="botName">Helper</b><i class="filename">a.py</i><pre><code>print("hello")</code></pre></div>'
    assert E.block_contexts(pages(spark, so, url="https://stackoverflow.com/q")).first().label == "Answer (score: 42)"
    assert E.block_contexts(pages(spark, poe, url="https://poe.com/c")).first().label == "Helper: a.py"


def test_context_has_nearest_heading(spark):
    html = "<h2>Setup</h2><p>intro</p><pre><code>first block here</code></pre><p>between</p><pre><code>second block here</code></pre>after"
    got = E.block_contexts(pages(spark, html)).orderBy("pre_index").collect()
    assert [(r.heading, r.text_before, r.text_after) for r in got] == [
        ("Setup", "Setup\nSetup\nintro", "between"), ("Setup", "Setup\nbetween", "after")]


TREE = "project/\n├── src/\n│   ├── app.py  # main\n│   └── utils/\n│       └── helper.py\n└── README.md"


def test_tree_paths(spark):
    df = spark.createDataFrame([(1, "intro\n" + TREE + "\nend\n├── alone")], "text_id int, text string")
    nodes = T.tree_nodes(T.tree_lines(df)).orderBy("pos").collect()
    assert [(n.path, n.is_leaf) for n in nodes] == [
        ("src/", False), ("src//app.py  # main", True), ("src//utils/", False), ("src//utils//helper.py", True), ("README.md", True)]


def test_no_tree_in_code(spark):
    df = spark.createDataFrame([(1, 'def hello():\n    print("world")\n    return True')], "text_id int, text string")
    assert T.tree_lines(df).count() == 0


def test_drawn_tree(spark):
    df = spark.createDataFrame([("p", "a/b.py", 1), ("p", "a/c/d.py", 2), ("p", "e.md", 3)], "project_id string, path string, file_id bigint")
    lines = [r.line for r in T.drawn_tree(df).orderBy("sort_key").collect()]
    assert lines == ["├── a/", "│   ├── b.py", "│   └── c/", "│       └── d.py", "└── e.md"]


def test_numeric_entities_and_html_escape_round_trip(spark):
    df = spark.createDataFrame([("<a href=\"x\">it's & done</a>",)], "t string")
    assert df.select(H.decode_entities(H.escape(F.col("t")))).first()[0] == "<a href=\"x\">it's & done</a>"


def test_elements_without_end_tags(spark):
    html = ('<html><body><div class="message user-turn"><p>please write it<div class="message bot-reply"><p>here it is'
            '<pre><code>def written_out(): pass</body>')
    got = {(r.author, r.text) for r in E.conversation(pages(spark, html)).collect()}
    assert {a for a, _ in got} == {"User", "Assistant"}
    assert [r.code for r in E.site_blocks(pages(spark, html, url="https://claude.ai/x")).collect()] == ["def written_out(): pass"]
    nested = "<div class='message'>one<section><div class='message'>two</section>after</div>tail"
    texts = {r.text for r in E.elements(pages(spark, nested), E.CONTAINERS).collect()}
    assert texts == {"onetwoafter", "two"}


def test_generic_blocks_differ_after_the_first_hundred_characters(spark):
    same = "x = 1\n" * 30
    html = f"<pre><code>{same}a</code></pre><pre><code>{same}b</code></pre><pre><code>{same}a</code></pre>"
    assert len(E.generic_blocks(pages(spark, html)).collect()) == 2


def test_numeric_references_of_all_planes(spark):
    df = spark.createDataFrame([("a&#65;&#233;&#8364;&#128512;&#x1F600;&#X41;&#x20ac;&#0;&#55296;&#1114112;&#9;",)], "t string")
    assert df.select(H.decode_entities(F.col("t"))).first()[0] == "aAé€😀😀A€���\t"


def test_fence_code_is_cut_from_its_own_fence(spark):
    """Marks inside and beside a fence; code without a line, with backticks, and of several lines."""
    texts = ["```py\na`b``\n```", "```\n```", "```x y\n```\nz```", "````\nfour````", "```js\r\nno```", "```a\nunclosed ``", None, "```é\nq```\nr\n``````\ns```"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = B.fenced_blocks(df)
    assert "[\\s\\S]" not in got._jdf.queryExecution().optimizedPlan().toString()  # the slow search, once more for each fence
    pattern = re.compile(r"```(\w+)?\n([\s\S]*?)```", re.ASCII)
    want = [(i, n, m[1] or "text", m[2]) for i, t in enumerate(texts) for n, m in enumerate(pattern.finditer(t or ""))]
    assert sorted((r.id, r.block_index, r.language, r.code) for r in got.collect()) == want


def test_conversation_takes_pages_apart_once(spark):
    html = '<body><p class="x">a</p><di<!-- -->v class="message user">hi</div></body>'
    got = E.conversation(pages(spark, html, '<body class="message-list"><p>plain</p></body>', "no tags", None))
    assert "<[^>]*>|[^<]+" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page_id, r.author, r.text) for r in got.collect()) == [(0, "User", "hi"), (1, "Unknown", "plain"), (2, "Unknown", "no tags")]
