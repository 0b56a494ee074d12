"""HTML extraction: parsing, the style tree against brute force, and what it does and doesn't remove."""

import collections
import math
import time

from leafmill.llm import site_style as S

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string"


def left(html, removed=None):
    """What a tree of this one page leaves of it; `removed` in place of its kinds."""
    page = S.Page(html)
    kinds = {n for n, p in zip(page.node, page.prior, strict=True) if p < S.LEAST and p != S.PRIORS["word in article"]}
    columns = (page.outer, page.path, page.kind, page.inside, page.owner, page.text, page.beside)
    return "\n\n".join(S.left_of(*columns, dict(zip(page.node, page.say, strict=True)), frozenset(kinds if removed is None else removed)))


def test_extraction():
    page = "<html><head><title>t</title></head><body><header>site</header><nav><a>m</a></nav><article><header><h1>A &amp; B</h1></header><p>one <b>two<p>three<br>four</p>"
    page += '<div class="comments"><div class="comment"><p>no</p></div></div><aside>no</aside></article><footer>&copy;</footer>'
    assert left(page) == "A & B\n\none two\n\nthree four"
    assert left("") == "" and left("plain &lt;text") == "plain <text"
    assert left('<script>if(a<b){"</p>"}</script><p>x</p><style>p{}') == "x"
    assert left(page, ()) == "site\n\nm\n\nA & B\n\none two\n\nthree four\n\nno\n\nno\n\n©"


def test_class_words_drop_no_article_text():
    inside = '<p class="share-price">price</p><p id="alert-levels">levels</p><div class="related-work"><p>work</p></div><p class="notice">notice</p>'
    assert left(f"<article><p>x</p>{inside}</article>") == "x\n\nprice\n\nlevels\n\nwork\n\nnotice"
    for name in ("layout has-sidebar", "with-sidebar", "no-sidebar", "comments-open", "sidebar"):
        assert left(f'<div class="{name}"><article>{"a " * 30}</article></div><div class="ad-box">buy</div>') == " ".join("a" * 30)
    assert left('<form><article>text</article></form><div class="site-header">menu</div>') == "text"
    assert left('<div class="sidebar"><article>teaser</article></div><article>the main text</article>') == "the main text"
    assert left('<div class="cookie-notice">we use</div><div>text</div><ul class="nav-menu"><li>a</ul>') == "text"


def pages_of_a_host(n):
    """Neutral boilerplate outside of and inside the article, a notice that looks alike, and text of many forms."""
    for i in range(n):
        note = "Every page says this." if i % 10 else f"Only page {i} says this."
        yield (
            f"<body><div class='top'>Welcome to the site</div><article><h1>Title {i}</h1><p>page {i} says {i * 7}</p><div class='end'>{note}</div>"
            f"<p class='notice'>warning {i}</p></article><div class='more'>Read {i} of {n}</div></body>"
        )


def test_tree_equals_brute_force_and_decides(spark):
    htmls = list(pages_of_a_host(40))
    rows = [(i, f"http://h.example/{i}", h, "x") for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, SCHEMA)
    named = df.selectExpr("page_id", "url", "'h.example' AS host", "html")
    tree = {r.node: (r.importance, r.n_pages) for r in S.style_tree(S.parsed_pages(named)).collect()}
    counts = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    prior = {}
    for h in htmls:
        page = S.Page(h)
        for node, p, show, say in zip(page.node, page.prior, page.show, page.say, strict=True):
            counts[node][0][show] += 1
            counts[node][1][say] += 1
            prior[node] = p

    def entropy(c):
        n = sum(c.values())
        return -sum(k / n * math.log(k / n) for k in c.values()) / math.log(n) if n > 1 else 1.0

    assert set(tree) == set(counts)
    for node, (shows, says) in counts.items():
        want = ((1 - S.CONTENT_SHARE) * entropy(shows) + S.CONTENT_SHARE * entropy(says)) * prior[node]
        assert abs(tree[node][0] - want) < 1e-8 and tree[node][1] == sum(says.values())
    got = {r.page_id: r.text for r in S.extract_text(df).collect()}
    for i in range(40):
        # the notice looks alike on all pages; the note stays where it isn't the one that pages repeat
        assert got[i] == f"Title {i}\n\npage {i} says {i * 7}" + ("" if i % 10 else f"\n\nOnly page {i} says this.")


def test_nothing_is_removed_without_the_tree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    named = pages.select("page_id", "url", S.host_of(pages.url).alias("host"), "html")
    parsed = S.written(S.parsed_pages(named), "test-parsed")
    removed = S.removed_branches(parsed)
    with_tree = {r.page_id: r.text for r in S._left(parsed, removed).collect()}
    without = {r.page_id: r.text for r in S._left(parsed, removed.where("false")).collect()}
    assert with_tree == {r.page_id: r.text for r in S.op9_html_extraction(spark, SF).collect()}
    assert all(len(without[i]) > len(t) for i, t in with_tree.items())
    for r in pages.collect():  # an own rule for these pages: what stands in the article element
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert with_tree[r.page_id] == left(inner, ())


def test_edges(spark):
    page = lambda i: f"<body><div class='top'>Welcome to the site</div><div class='text'><p>page {i} says {i * 7}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(30)] + [(99, None, None, "x"), (None, "http://one.example/", "<p>alone</p>", "x"), (1, "http://h.example/1", page(1), "x")]
    rows += [(200, "http://h.example/b", "<body><div class='top'>Welcome to the site</div></body>", None)]
    rows += [(300 + i, f"http://copies.example/{i}", page(5), "x") for i in range(15)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.extract_text(df).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.url and "h.example" in r.url} == {f"page {i} says {i * 7}" for i in range(30)} | {""}
    assert [r.text for r in got if r.page_id is None] == ["alone"] and [r.n_chars for r in got if r.page_id == 99] == [0]
    assert {r.text for r in got if r.url and "copies" in r.url} == {"Welcome to the site\n\npage 5 says 35"}
    assert S.extract_text(df.where("false")).count() == 0


def test_hot_host_is_salted(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_A_SALT", 8)
    monkeypatch.setattr(S, "HOT_HOSTS", 2)
    df = spark.createDataFrame([(i, f"http://{'hot' if i % 3 else i}.example/{i}", h, "x") for i, h in enumerate(pages_of_a_host(60))], SCHEMA)
    got = {r.page_id: r.text for r in S.extract_text(df).collect()}
    assert len(got) == 60 and all(got[i].startswith(f"Title {i}\n\npage {i} says {i * 7}") for i in got)


def test_deep_pages_are_linear():
    began = time.time()
    page = S.Page("<div>" * 50_000 + "x")
    assert page.text == ["x"] and len(page.path) == 50_001
    S.Page("<b>x<span>" * 20_000 + "<div>x</b></i>" * 10_000 + "<li>" * 10_000)
    assert time.time() - began < 20
