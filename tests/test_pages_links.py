"""Page extraction and link jobs."""
import html as stdhtml

from pyspark.sql import functions as F

from linkspark.functions import html as H
from linkspark.operators import links as L
from linkspark.operators import pages as P
from linkspark.sources import sinks

PAGE = """<html><head><title> A &amp;
 B</title><style>p{}</style><script>var x="<a href='/no'>no</a>";</script></head><body>
<!-- <a href="/gone">c</a> --><header>top</header><p>a</p><p>b</p><nav><a href="/n" rel=nofollow>N <b>x</b></a></nav>
<a class="x>y" href='/q?a=1&amp;b=2&copy=3'> T &lt;b&gt;
 </a><a name=z>k</a><a href="">e</a><A HREF=/u>U</A><footer>f</footer> end&nbsp;&amp;lt;</body></html>"""


def _extract(spark, *docs):
    df = spark.createDataFrame([(i, f"https://h.com/{i}", d) for i, d in enumerate(docs)], "i int, url string, html string")
    return P.extract_pages(df).orderBy("i").collect()


def test_extract(spark):
    page, empty, error = _extract(spark, PAGE, "plain <b>text</b>", None)
    assert page.title == "A & B"
    assert page.content == "ab T <b> keU end &lt;"
    assert [tuple(l) for l in page.links] == [
        (1, "/n", "N x", "nofollow"), (2, "/q?a=1&b=2&copy=3", "T <b>", ""), (3, "/u", "U", "")]
    assert page.links_count == 3
    assert (empty.title, empty.content, empty.links) == ("", "plain text", [])
    assert (error.title, error.content, error.links, error.links_count) == (None, None, [], 0)


HARD = [  # (html, title, text, hrefs)
    ("<body>a<!-- <script src=old> -->b<a href='/x'>t</a></body>", "", "abt", ["/x"]),
    ("<script>x <!-- y</script><body>a<style>/*</body>*/</style>b", "", "ab", []),
    ("<body><nav-bar>b</nav-bar>tail<header-banner>q</header-banner></body>", "", "btailq", []),
    ("<body><nav>1<nav>2</nav>3</nav>b<header><nav>x</header>c</nav>d<footer>z</body>", "", "bcd", []),
    ("<!-- <title>old</title> --><title lang=x>new</title><body>x</body>", "new", "x", []),
    ("<body><a data-u=\" href='/evil'\" href=\"/good\">k</a><A HREF = /w&amp;x title='>'>z</A><a\nhref>n</a><abbr href=/no>m</abbr></body>", "",
     "kznm", ["/good", "/w&x"]),
    ("<body>&#00000065;&#x000000041;&#99999999999;</body>", "", "AA\ufffd", []),
    ("<body>open <!-- never closed <a href=/x>", "", "open", []),
]


def test_hard_markup(spark):
    for (html, title, text, hrefs), page in zip(HARD, _extract(spark, *[h[0] for h in HARD])):
        assert (page.title, page.content, [l.href for l in page.links]) == (title, text, hrefs), html


def test_base_href(spark):
    pages = ["<base target=x><base href='/deep/er/'><base href=/late/><a href=p>1</a><a href=/q>2</a>", "<base href='//cdn.tarn.no/'><a href=p>1</a>",
             "<!-- <base href=/no/> --><a href=p>1</a>"]
    df = spark.createDataFrame([(i, "http://tarn.no/a/b", h) for i, h in enumerate(pages)], "i int, url string, html string")
    edges = L.page_edges(L.page_links(P.extract_pages(df)), "i").collect()
    assert sorted((e.i, e.target_url, e.category) for e in edges) == [
        (0, "http://tarn.no/deep/er/p", "internal"), (0, "http://tarn.no/q", "internal"), (1, "http://cdn.tarn.no/p", "external"),
        (2, "http://tarn.no/a/p", "internal")]


def test_text_is_cut_only_at_the_page_limit(spark):
    long = "<body>" + "word " * 20_000 + "</body>"
    (page,) = _extract(spark, long)
    assert len(page.content) == H.MAX_CONTENT
    assert _extract(spark, "<body>" + "x" * 100 + "</body>")[0].content == "x" * 100


def test_huge_markup_does_not_exhaust_the_stack(spark):
    tag = "<a " + " ".join(f'data-{i}="{i}"' for i in range(20_000)) + ' href="/deep">x</a>'
    url = "/" + "s/" * 20_000
    (page,) = _extract(spark, f'<body>{tag}<a href="{url}">y</a></body>')
    assert [l.href for l in page.links] == ["/deep", url]


def test_entities_like_the_standard_library(spark):
    texts = ["&amp;lt; x", "a&copy;b", "a&copy b &copyx &notit; &notin; &#65; &#x41;z &#128; &#0; &#xD800; &bogus; & &&amp;",
             "&NotEqualTilde;&fjlig;", "plain", "&middot;&quot;&lt;", "&;", "&#;", "&#x;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.expr(H.decode_entities("t")).alias("d")).collect():
        assert r.d == stdhtml.unescape(r.t)


def _links(spark, base, *hrefs, **options):
    rows = [(base, [(i, h, f"t{i}", "") for i, h in enumerate(hrefs, 1)])]
    df = spark.createDataFrame(rows, "url string, links " + P.LINKS)
    out = L.page_edges(L.page_links(df, **options)).collect()
    found = {c: [] for c in L.CATEGORIES}
    for e in sorted(out, key=lambda e: (e.category, e.rank)):
        found[e.category].append(e.canonical or e.target_url)
    return found


BASE = "https://example.com/blog"


def test_categories(spark):
    found = _links(spark, "http://tarn.no/maps/", "north.svg", "../legend?x=1", "//cdn.tarn.no/a", "HTTP://tarn.no/legend?x=1#k", "", " ",
                   "sms:+471", "data:text/plain,x", "gopher://old.tarn.no/", "https://kiosk.fi:443/", "http://[kiosk/", "http://y/" + "b" * 2100)
    assert found["internal"] == ["http://tarn.no/maps/north.svg", "http://tarn.no/legend?x=1"]
    assert found["external"] == ["http://cdn.tarn.no/a", "https://kiosk.fi/"]
    assert sorted(map(len, found["invalid"])) == [14, 2109]


def test_first_position_wins_and_order_is_kept(spark):
    rows = [(BASE, [(1, "/z", "a", ""), (2, "/b", "b", ""), (3, "/z/", "c", ""), (4, "/a", "d", "")])]
    df = spark.createDataFrame(rows, "url string, links " + P.LINKS)
    edges = L.page_edges(L.page_links(df)).orderBy("rank").collect()
    assert [(e.pos, e.canonical, e.anchor_text) for e in edges] == [
        (1, "https://example.com/z", "a"), (2, "https://example.com/b", "b"), (4, "https://example.com/a", "d")]


def test_same_domain_only(spark):
    found = _links(spark, "http://tarn.no/maps/", "//kiosk.fi/x", "a", "b", "http://cdn.tarn.no/", same_domain_only=True)
    assert found["external"] == [] and len(found["internal"]) == 2


def test_quirks_kept(spark):
    # the page's default port is compared with the canonical host, so own links look external
    assert _links(spark, "https://h:443/", "/a")["external"] == ["https://h/a"]
    # an upper-case scheme survives joining only where it differs from the page's scheme
    assert _links(spark, "http://h/", "HTTP://X/")["external"] == ["http://x/"]
    assert _links(spark, "https://h/", "HTTP://X/") == {"internal": [], "external": [], "invalid": []}


def test_filter_and_cap(spark):
    urls = ["http://tarn.no/maps/2024/north.svg", "http://tarn.no/", "http://tarn.no/print?map=3", "http://kiosk.fi/maps"]
    df = spark.createDataFrame([(u,) for u in urls], "canonical string")

    def left(**rules):
        return [u for u in urls if u in {r.canonical for r in L.filter_links(df, **rules).collect()}]
    assert left() == urls
    assert left(exclude=["print", ".svg"]) == [urls[1], urls[3]]
    assert left(include=["kiosk", "?map="]) == urls[2:]
    assert left(include=["maps"], max_depth=1) == [urls[3]]
    assert left(max_depth=0) == [urls[1]]
    edges = L.page_edges(L.page_links(spark.createDataFrame(
        [(BASE, [(i, f"/p{i}", "", "") for i in range(1, 151)])], "url string, links " + P.LINKS)))
    kept = L.cap_links(edges).collect()
    assert sorted(e.pos for e in kept) == list(range(1, 101))


def test_extraction_does_not_shuffle(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    edges = L.page_edges(L.page_links(P.extract_pages(pages)))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    titles = P.extract_pages(pages).select("page_id", "title")._jdf.queryExecution().executedPlan().toString()
    assert "struct<page_id:bigint,html:string>" in titles


def test_messages_round_trip(spark):
    from linkspark.sources.tables import parse_link_jobs
    df = spark.createDataFrame([(BASE, [(1, "/own", "", ""), (2, "https://b.org/1", "", ""), (3, "https://c.org/2", "", "")]),
                                ("https://lonely.com/", [(1, "/x", "", "")])], "url string, links " + P.LINKS)
    sent = sinks.publish_link_jobs(L.page_links(df), F.lit("job"), F.lit(2))
    assert sent.count() == 1 and sent.first()["key"] == "job"
    broken = spark.createDataFrame([("k", "{not json"), ("k", '{"job_id": "j", "target_urls": "no list"}'), ("k", None)],
                                   "key string, value string")
    good, rejected = parse_link_jobs(sent.unionByName(broken))
    assert [(r.job_id, r.source_url, r.depth, r.pos, r.target_url) for r in good.orderBy("pos").collect()] == [
        ("job", BASE, 2, 1, "https://b.org/1"), ("job", BASE, 2, 2, "https://c.org/2")]
    assert rejected.count() == 3
