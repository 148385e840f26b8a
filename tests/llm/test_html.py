import html
import re

from pyspark.sql import functions as F

from marketmood.llm import html_template as H

NONE = H.Template(None)


def article(source):
    """Brute force for the fixture's pages: the article's blocks."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def text(source):
    return H.main_text(H.Page(source), NONE)


def test_query_against_brute_force(spark):
    from marketmood.llm.queries import QUERIES
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op6_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    assert {k: (r["url"], r["text"]) for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_boilerplate_kinds():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
      <div id=cookie-notice>We use</div><div class="side-bar sidebar">s</div><nav>n</nav><main><header><h1>A &amp; B</h1></header>
      <p>One<p>Two <em>x</em>y&nbsp; z &lt;b&gt; &#8364;<ul><li>i1<li>i2</ul><aside>side</aside><form><input> name</form>
      <div class='advertBox ad'>buy</div><section id="comments"><h2>Comments</h2><p>nice</p></section><pre>a
      b</pre>tail</main><footer>f</footer><script>if (a<b) {"</p>"}</script><div"""
    assert text(page) == "A & B\nOne\nTwo xy z <b> €\ni1\ni2\na b\ntail"


def test_malformed_and_empty():
    assert text(None) == text("") == text("<p>") == ""
    assert text("plain & simple") == "plain & simple"
    assert text("a < b <c") == "a < b"
    assert text("<p>x<script>never closed <p>y") == "x"
    assert text("<article><p>one<b>two</article><footer>three") == "onetwo"
    assert text('<p title="a > b">t</p><!-- c > --><p>u') == "t\nu"
    assert text("<!-- open") == "" and text("</div></p>z") == "z"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("<p>" * 3000 + "deep") == "deep" and text("<div>" * 3000 + "deep") == "deep"


def pages(spark, n=6):
    made = [(i, f"http://g.test/{i}", f"<body><div class=top><a href=/>Home</a><a href=/x>X</a></div><div id=n1>Terms apply</div>"
             f"<div class=c>Body {i} differs <p>more {i * i}</div><div class=l><a href=1>{i}</a></div></body>") for i in range(n)]
    odd = [(90, "http://g.test/odd", "<body><div class=c>One</div><div class=c>Two</div></body>"), (None, None, None), (91, "x", "")]
    return spark.createDataFrame(made + odd + made[:1], "page_id long, url string, html string")


def test_template_of_a_host_without_semantic_tags(spark):
    df = pages(spark).filter("page_id IS NULL OR page_id <> 90")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got[3] == "Body 3 differs\nmore 9" and got[None] == got[91] == ""
    stats = H.token_stats(df.select(F.lit("g").alias("host"), F.concat_ws("|", "page_id", "url").alias("page_key"), F.col("html").alias("t"))
                          .filter("page_id < 90"))
    t = H.Template(H.templates(stats).first()["template"])
    assert {"/body", "/body/div.top", "/body/div.#.n", "/body/div.c"} <= t.frame
    assert t.nested["/body/div.top"] == [["/body/div.top/a"]] and "/body/div.#.n" in t.boilerplate


def test_page_off_the_frame_and_clashing_columns(spark):
    df = pages(spark).selectExpr("*", "'x' AS text", "0 AS page_host", "'y' AS HOST")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "page_host", "HOST", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == df.count()
    assert {r["text"] for r in rows if r["page_id"] == 90} == {"One\nTwo"}
    assert H.extract(df.limit(0)).count() == 0


def test_vectors_merge_over_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    keyed = df.select(H.host_of(F.col("url")).alias("host"), F.col("page_id").cast("string").alias("page_key"), F.col("html").alias("t"))
    a = {tuple(r) for r in H.token_stats(keyed).collect()}
    b = {tuple(r) for r in H.token_stats(keyed.repartition(9), flush=50).collect()}
    assert a == b and len(a) > 100


def test_template_decides_inside_marked_articles(spark):
    made = [(i, f"http://m.test/{i}", f"<body><article>Site line<h1>Title {i}</h1><p>Body {i}</p><p>with <a href=/s>a link {i}</a> in a sentence</p>"
             f"<div class=cta>Read us daily</div><div class=k>Twice</div><ul class=more>{'<li><a href=/a>Other</a><li><a href=/b>page %d</a>' % i}</ul>"
             f"<div class=k>Twice</div></article></body>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nBody {i}\nwith a link {i} in a sentence" for i in range(5)}


def test_words_never_judge_the_main_slot():
    for page in ('<article class="post tag-social"><p>A</article>', '<main class="has-sidebar"><p>A</main>', '<div class="content no-ads"><p>A</div>',
                 '<div id="search-results"><article><p>A</article></div>', '<div id="search-results"><ul><li>A</ul></div>',
                 '<main class="has-sidebar"><p>A<div class=sidebar>a menu longer than A</div></main>',
                 '<article class="post tag-social"><p>A, the longer</article><article class=teaser>B</article>'):
        assert text(f"<body><nav>Home, a menu</nav>{page}<footer>All rights</footer></body>").startswith("A"), page
        assert "menu" not in text(f"<body><nav>Home, a menu</nav>{page}</body>"), page
    assert text('<article>The article itself<p>text</article><section id=comments><article class=comment>Nice</article></section>') == "The article itself\ntext"
    assert text('<div class=c>Short</div><div class="ad">An advert longer than the text</div>') == "Short"
    assert text('<p>See</p><p><a href=/x>the whole list</a></p>') == "See\nthe whole list"


def test_copies_of_an_article_are_not_boilerplate(spark):
    def page(host, i, ad, n):
        body = f"<h1>Title {n}</h1><p>One paragraph {n}</p><div class=note>Terms apply</div>"
        return (i, f"http://{host}.test/{i}", f"<body><div class=ad>{ad}</div><div class=c>{body}</div></body>")
    copies = [page("c", i, "same", 1) for i in range(4)] + [page("v", i, f"ad {i}", 1) for i in range(10, 14)]
    two = [page("t", i, "same", i % 2) for i in range(20, 26)]  # two articles, three copies each
    three = [page("d", i, "same", i % 3) for i in range(30, 36)]
    rows = spark.createDataFrame(copies + two + three, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(rows).collect()}
    whole = lambda n: f"Title {n}\nOne paragraph {n}\nTerms apply"
    assert all(got[i] == whole(1) for i in [*range(4), *range(10, 14)])
    assert all(got[i] == whole(i % 2) for i in range(20, 26))
    assert all(got[i] == f"Title {i % 3}\nOne paragraph {i % 3}" for i in range(30, 36))


def hosted(spark, make, n=5, host="h"):
    rows = [(i, f"http://{host}.test/{i}", make(i)) for i in range(n)]
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


LONG = "A sentence of the article that goes on for a while, number {}. " * 4


def test_template_decides_without_marks_and_against_misleading_ones(spark):
    def page(i):
        body = LONG.format(i, i + 1, i + 2, i + 3).strip()
        return (f"<body><div class=qa><a href=/>Home {i}</a></div><article class=teaser>Teaser of another article {i}</article>"
                f"<div class=qb><div class=qc>Bought by {i}</div></div><div class=qd><h2>Title {i}</h2><div class=qe>{body}</div>"
                f"<h3>Ingredients</h3><ul class=qf>{''.join(f'<li>thing {i} {k}</li>' for k in range(i + 1))}</ul>"
                f"<h3>Elsewhere</h3><ul class=qg><li><a href=/p{i}>More {i}</a></li></ul></div><div class=qh>Written in {i} minutes</div></body>")

    def want(i):
        return "\n".join([f"Title {i}", LONG.format(i, i + 1, i + 2, i + 3).strip(), "Ingredients", *[f"thing {i} {k}" for k in range(i + 1)]])
    assert hosted(spark, page) == {i: want(i) for i in range(5)}
    assert hosted(spark, page, 2) == {i: want(i) + "\nElsewhere" for i in range(2)}  # two pages don't show that it is fixed


def test_a_first_heading_beside_the_main_slot_stays(spark):
    got = hosted(spark, lambda i: f"<body><div class=t>Site {i}</div><h1>Title {i}</h1><div class=c>{LONG.format(i, 2, 3, 4)}</div><div>End {i}</div></body>")
    assert got == {i: f"Title {i}\n{LONG.format(i, 2, 3, 4).strip()}" for i in range(5)}


COMMENTS = [
    '<ol class="comment-list"><li><article class="comment-body"><b>Ann</b><p>{}</p></article></li></ol>',
    '<div class="post-comments"><div><span>Ann</span><p>{}</p></div></div>',
    '<section id="responses"><article class="entry"><time>1</time><p>{}</p></article></section>',
    '<div class=c1><div class="reply"><div class=who>Ann</div><p>{}</p></div><div class="reply"><div class=who>Bob</div><p>{}</p></div></div>',
    '<ul><li class="comment"><div>Ann</div><p>{}</p></li></ul>', '<div id="disqus_thread"><p>{}</p></div>']


def test_comments_longer_than_the_article_go(spark):
    said = "What a reader says about it at great length. " * 20
    for comments in COMMENTS:
        for article in ("<article><h1>T</h1><p>Short.</p>%s</article>", "<article><h1>T</h1><p>Short.</p></article>%s",
                        "<div class=c><h1>T</h1><p>Short.</p></div>%s", "<main><h1>T</h1><p>Short.</p>%s</main>"):
            page = f"<body>{article % comments.format(said, said)}</body>"
            assert text(page) == "T\nShort.", page
            many = hosted(spark, lambda i: page.replace("Short.", f"Short {i}. {i} words."), 4) if article.startswith("<div") else {}
            assert many == {i: f"T\nShort {i}. {i} words." for i in many}


def test_names_that_only_hold_a_word_of_boilerplate_stay():
    for name in ("social-science", "share-price", "reply", "ad-hoc", "comment", "has-notice-board", "menuItalian", "tag-footerless"):
        assert text(f'<article><h1>T</h1><p>a</p><div class="{name}">b</div><p id={name}>c</p></article>') == "T\na\nb\nc", name
    for name in ("ad", "share-buttons", "cookieNotice", "newsletter signup", "author-box", "side-bar sidebar", "Menu_Left"):
        assert text(f'<article><h1>T</h1><p>a</p><div class="{name}">b</div></article>') == "T\na", name


def test_deep_and_long_pages_take_bounded_memory():
    import tracemalloc
    for source in ("<b>" * 20_000 + "x", "<div class='some long name'>" * 20_000 + "x", "<article>" * 20_000 + "x", "<p>y</p>" * 50_000):
        tracemalloc.start()
        page = H.Page(source)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6 and H.main_text(page, NONE) in ("x", "\n".join("y" * 50_000)), (source[:20], peak)


def test_deduced_template_alone_finds_the_articles(spark):
    """Given pages without any mark or telling name: what stays is the slots that the template leaves."""
    given = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plain = given
    for old, new in (("<article>", '<div class="k">'), ("</article>", "</div>"), ("<nav>", '<div class="m">'), ("</nav>", "</div>"),
                     ("<footer>", '<div class="z">'), ("</footer>", "</div>"), ('<div class="ad">', '<div class="y">')):
        plain = plain.withColumn("html", F.replace("html", F.lit(old), F.lit(new)))
    assert plain.filter("html LIKE '%<article%' OR html LIKE '%<nav%'").count() == 0
    want = {r["page_id"]: article(r["html"]) for r in given.collect()}
    assert {r["page_id"]: r["text"] for r in H.extract(plain).collect()} == want
