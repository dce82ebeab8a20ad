"""URL lists: brute force over all rules, hard rows, filters that let everything pass."""
import random

import pytest
from pyspark.sql import functions as F

from linkspark.llm import urlfilter as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAGE = "page_id long, url string, host int, rule string, _row string, _keys string, kept string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(LOWER), path[:min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fit = [(len(h) + len(p), len(h), v == "block", h, p, v) for v, h, p in
           ((v, h.translate(LOWER), p) for v, h, p in rules if None not in (v, h, p))
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    *_, h, p, v = max(fit)
    return host, path, h + p, v


def judged(spark, urls, rules, **more):
    rows = spark.createDataFrame([(i, u, 7, "r", "x", "y", "k") for i, u in enumerate(urls)], PAGE).repartition(3)
    listed = spark.createDataFrame(rules, "verdict string, host string, path string")
    found = U.UrlList(listed, **more).judge(rows).collect()
    assert sorted(found[0].asDict()) == sorted(["page_id", "url", "host", "path", "rule", "verdict", "_row", "_keys", "kept"])
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(found, key=lambda r: r.page_id)]


HARD = [None, "", "no scheme", "://", "x://h", "x://H.Com", "x://a.com?q=/en/", "x://a.com#/en/", "x://com/", "x://a..com/en/b",
        "x://com./", "x://.com/", "a://b.com/://c.net/", "x://u@b.com/", "x://b.com:80/", "x://" + "a." * 3000 + "com/en/x",
        "x://" + "b" * 9000 + ".com/", "x://b.com/" + "en/" * 5000, "x://b.com/ünï/中", "x://É.com/", "x://b.com/a\nb?c"]


def test_hard_urls(spark):
    rules = [("allow", "com", "/"), ("block", "Com", "/en/"), ("allow", "b.com", ""), ("block", "b.com", "/ünï"), ("block", "é.com", "/"),
             ("block", "", ""), ("block", "com", "/"), ("block", None, "/"), ("allow", "b.com", None), ("allow", "b.com", "/en/en/e")]
    assert judged(spark, HARD, rules) == [verdict(u, rules) for u in HARD]


@pytest.mark.parametrize("most", [U.MOST_WORDS, 8])
def test_brute_force(spark, most, monkeypatch):
    if most == 8:  # the filter can't grow: nearly all pass, the join decides
        monkeypatch.setattr(U, "GROUP", 8)
    rnd = random.Random(5)
    labels, steps = ["a", "b", "cc", "com", "net"], ["x", "y", "zz", ""]

    def host():
        return ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))

    def path():
        return "".join("/" + rnd.choice(steps) for _ in range(rnd.randint(0, 4)))
    rules = [(rnd.choice(["allow", "block"]), host(), path()) for _ in range(120)]
    urls = [f"http://{host()}{path()}{rnd.choice(['', '?q', '#f/x', '?a://b'])}" for _ in range(600)]
    urls += urls[:20] * 10
    assert judged(spark, urls, rules, most_words=most) == [verdict(u, rules) for u in urls]


def test_the_filter_drops_most_of_what_is_not_listed(spark):
    rules = spark.range(3000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("host"),
                                     F.lit("/p").alias("path"))
    urls = spark.range(3000, 9000).select(F.concat(F.lit("http://h"), F.col("id"), F.lit(".org/p")).alias("url"))
    asked = U.UrlList(rules).possible(urls.select(U.host_of("url").alias("_host"), U.path_of("url").alias("_path")))
    assert asked.filter(F.size("_keys") > 0).count() < 60
    found = U.judge_urls(urls, rules)
    assert found.filter("verdict = 'block'").count() == 0 and found.count() == 6000


def test_empty_list_and_empty_table(spark):
    rules = spark.createDataFrame([("block", "com", "/")], "verdict string, host string, path string")
    urls = spark.createDataFrame([("x://com/",), (None,)], "url string")
    assert [tuple(r) for r in U.judge_urls(urls, rules.limit(0), default="block").orderBy("host").collect()] == \
        [(None, "", "", None, "block"), ("x://com/", "com", "/", None, "block")]
    assert U.judge_urls(urls.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark, sf):
    from linkspark.llm.queries import QUERIES
    plan = QUERIES["op11_url_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
