"""Robots rules against the standard library's parser, on hand-written and random texts."""
import random
import urllib.robotparser

from pyspark.sql import functions as F

from linkspark.operators import robots as R

TEXTS = [
    "User-agent: *\nDisallow: /private\nAllow: /private/open\n",
    "User-agent: linkspark\nDisallow: /a\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: other\nUser-agent: LINK\nDisallow: /x\nAllow: /\nCrawl-delay: 0\n",
    "Disallow: /early\nUser-agent: *\n\nDisallow: /late\nUser-agent: *\nDisallow: /kept\nCrawl-delay: soon\n",
    "User-agent: *\nDisallow:\n", "", "# nothing\n\n", "User-agent: *\nDisallow: *\n",
    "User-agent: *\r\nDisallow: /caf%C3%A9\r\nDisallow: /a b\r\nDisallow: /q?x=1 # note\r\nCrawl-delay: 2\r\nRequest-rate: 1/5\r\n",
    "User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\n",
]
URLS = ["/", "/private", "/private/open", "/a", "/x", "/early", "/late", "/kept", "/café", "/caf%C3%A9/z", "/a b", "/a%20b",
        "/q?x=1", "/q?x=12", "/q", "", "/one", "/two", "/private;p?q#f", "/a//b", "/%zz"]


def _random_text(rnd):
    lines = []
    for _ in range(rnd.randrange(14)):
        lines.append(rnd.choice([
            "", "", "   ", "# c", "User-agent: *", "User-agent: linkspark", "user-agent : Link", "User-agent: other",
            "User-agent: other # x", "Sitemap: http://x", "Crawl-delay: 4", "crawl-delay: 0", "Request-rate: 3/9", "junk",
            f"Disallow: {rnd.choice(URLS)}", f"Allow: {rnd.choice(URLS)}", "Disallow:", "Allow:"]))
    return "\n".join(lines)


def test_verdicts_and_delays(spark):
    rnd = random.Random(7)
    texts = TEXTS + [_random_text(rnd) for _ in range(150)]
    robots = spark.createDataFrame([(f"h{i}.com", 200, t) for i, t in enumerate(texts)], R_SCHEMA)
    urls = spark.createDataFrame([(f"http://h{i}.com{u}",) for i in range(len(texts)) for u in URLS], "url string")
    groups = R.robots_groups(robots)
    parsers = {}
    for i, t in enumerate(texts):
        parsers[f"h{i}.com"] = p = urllib.robotparser.RobotFileParser()
        p.parse(t.splitlines())
    for r in R.robots_allowed(urls, groups).collect():
        host = r.url.split("/")[2].split("?")[0]
        assert r.allowed == parsers[host].can_fetch(R.DEFAULT_AGENT, r.url), (r.url, texts[int(host[1:-4])])
    hosts = spark.createDataFrame([(h,) for h in parsers], "host string")
    for r in R.crawl_delays(hosts, groups, default=1.5).collect():
        assert r.crawl_delay == float(parsers[r.host].crawl_delay(R.DEFAULT_AGENT) or 1.5), texts[int(r.host[1:-4])]


R_SCHEMA = "host string, status int, body string"


def test_fail_open(spark):
    robots = spark.createDataFrame([("gone.com", 404, "User-agent: *\nDisallow: /"), ("ok.com", 200, "User-agent: *\nDisallow: /")], R_SCHEMA)
    urls = spark.createDataFrame([("http://gone.com/x",), ("http://none.com/x",), ("http://OK.com/x",)], "url string")
    groups = R.robots_groups(robots)
    assert {r.url: r.allowed for r in R.robots_allowed(urls, groups).collect()} == {
        "http://gone.com/x": True, "http://none.com/x": True, "http://OK.com/x": False}
    assert all(r.allowed for r in R.robots_allowed(urls, groups, respect=False).collect())


def test_rule_table(spark):
    robots = spark.createDataFrame([("h.com", TEXTS[1])], "host string, body string")
    rows = R.robots_rules(robots).orderBy("seq").collect()
    assert [(r.grp, r.agents, r.allow, r.path, r.crawl_delay) for r in rows] == [
        (1, ["linkspark"], False, "/a", 3), (2, ["*"], False, "/", None)]


def test_robots_source_and_one_text_per_host(spark, tmp_path):
    from linkspark.schemas import ROBOTS
    from linkspark.sources.tables import read_robots
    path = str(tmp_path / "robots")
    rows = [("a.no", 200, "User-agent: *\nDisallow: /x"), ("b.no", 404, "User-agent: *\nDisallow: /"), ("c.no", 200, None)]
    spark.createDataFrame(rows, ROBOTS).write.parquet(path)
    robots = read_robots(spark, path, ROBOTS)
    assert sorted(r.host for r in robots.collect()) == ["a.no", "c.no"]
    urls = spark.createDataFrame([(u,) for u in ("http://a.no/x", "http://a.no/y", "http://b.no/x", "http://c.no/x")], "url string")
    out = {r.url: r.allowed for r in R.robots_allowed(urls, R.robots_groups(robots)).collect()}
    assert out == {"http://a.no/x": False, "http://a.no/y": True, "http://b.no/x": True, "http://c.no/x": True}
    two = spark.createDataFrame([("a.no", "User-agent: *\nDisallow: /old", 1), ("a.no", "User-agent: *\nAllow: /old/new\nDisallow: /old", 2)],
                                "host string, body string, fetched_at int")
    assert [(r.seq, r.allow, r.path) for r in R.robots_rules(two).orderBy("seq").collect()] == [
        (1, True, "/old/new"), (2, False, "/old")]


def test_many_rules_on_one_host(spark):
    """Ten thousand rules: the first in file order that fits decides, and no URL carries them."""
    rnd = random.Random(8)
    paths = ["/" + "".join(rnd.choice("abc/") for _ in range(rnd.randrange(0, 7))) for _ in range(10_000)]
    rules = [(rnd.choice(["Allow", "Disallow"]), p) for p in paths]
    body = "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rules)
    robots = spark.createDataFrame([("h.com", body), ("star.com", "User-agent: *\nAllow: /x\nDisallow: *\n")], "host string, body string")
    urls = [f"http://h.com/{''.join(rnd.choice('abcd/') for _ in range(rnd.randrange(0, 9)))}" for _ in range(300)]
    urls += urls[:5] + ["http://star.com/x1", "http://star.com/y", "http://other.com/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "i int, url string, rules int")
    groups = R.robots_groups(robots)
    out = R.robots_allowed(df, groups)
    assert out.columns == ["i", "url", "rules", "allowed"]
    got = {r.i: r.allowed for r in out.collect()}
    for i, u in enumerate(urls):
        if "star" in u or "other" in u:
            assert got[i]  # a star is quoted like any other character, so it fits nothing here
            continue
        target = "/" + u.split("/", 3)[3]
        want = next((k == "Allow" for k, p in rules if target.startswith(p)), True)
        assert got[i] == want, u
    first, lengths = R.prefix_index(groups)
    assert lengths.agg(F.max(F.size("_lengths"))).first()[0] <= 8 and 1000 < first.filter("_host = 'h.com'").count() <= len(set(paths))
