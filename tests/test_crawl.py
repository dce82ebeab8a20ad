"""The crawl against a queue-driven walk of the same graph."""
import hashlib
import random
from collections import Counter

import pytest

from linkspark.operators import crawl as C
from linkspark.operators import links as L
from linkspark.operators import pages as P
from linkspark.operators import robots as R

JOBS = "job_id string, url string, max_depth int, max_pages int, respect_robots_txt boolean, status string"


def _graph(seed, n=60):
    """Every third link leads to the same page; some targets do not exist, some pages fail."""
    rnd = random.Random(seed)
    pages = {}
    for i in range(n):
        targets = [0 if rnd.random() < 0.33 else rnd.randrange(n + 8) for _ in range(rnd.randrange(6))]
        links = [f"http://s.com/p{t}" for t in targets]
        if rnd.random() < 0.3:
            links.append("http://else.com/x")
        pages[f"http://s.com/p{i}"] = (links, "boom" if rnd.random() < 0.15 and i else None)
    return pages


def _site(spark, pages, parts):
    rows = [(i, url, error, [(k, h, "", "") for k, h in enumerate(links, 1)], len(links))
            for i, (url, (links, error)) in enumerate(pages.items())]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, f"page_id int, url string, error string, links {P.LINKS}, links_count int")
    return C.crawl_site(L.page_links(df.repartition(parts)))


def _walk(pages, seed, max_depth, max_pages, allowed):
    """One queue, level by level; the gates in the order budget, visited, robots."""
    visited, count, outcomes, tree = set(), 0, Counter(), {}
    queue = [(seed, None)]
    for depth in range(max_depth + 1):
        following = []
        for url, parent in queue:
            if count >= max_pages:
                outcomes["max_pages_reached"] += 1
                continue
            if url in visited:
                outcomes["already_visited"] += 1
                continue
            visited.add(url)
            if not allowed(url):
                outcomes["robots_denied"] += 1
                continue
            links, error = pages.get(url, ([], "missing"))
            outcomes["error" if error else "success"] += 1
            tree[url] = (depth, parent)
            if error:
                continue
            count += 1
            if depth < max_depth:
                inside = [u for u in dict.fromkeys(links) if u.startswith("http://s.com/")]
                following += [(u, url) for u in inside[:100]]
        queue = following
    return outcomes, tree


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5)])
def test_like_a_queue(spark, seed, parts):
    pages = _graph(seed)
    jobs = [("all", "http://s.com/p0", 3, 1000, False), ("few", "http://S.com:80/p1#x", 4, 7, False),
            ("one", "http://s.com/p2", 2, 1, False), ("polite", "http://s.com/p3", 4, 12, True),
            ("nothing", "http://s.com/p999", 2, 5, False), ("exact", "http://s.com/p0", 1, 2, False)]
    text = "User-agent: *\nDisallow: /p1\nDisallow: /p0\n"
    groups = R.robots_groups(spark.createDataFrame([("s.com", text)], "host string, body string"))
    table = spark.createDataFrame([(*j, "IN_PROGRESS") for j in jobs] + [
        ("stopped", "http://s.com/p0", 3, 9, False, "CANCELLED"), ("broken", "ftp://s.com/", 3, 9, False, "IN_PROGRESS")], JOBS)
    result = C.crawl(table, _site(spark, pages, parts), groups).cache()
    got = {}
    for r in C.crawl_outcomes(result, "job_id").collect():
        got.setdefault(r.job_id, {})[r.outcome] = r.attempts
    assert got.pop("stopped") == {"cancelled": 1} and got.pop("broken") == {"invalid_url": 1}
    trees = {}
    for r in C.crawled_urls(result).collect():
        trees.setdefault(r.job_id, {})[r.url] = (r.depth, r.parent_url)
    for name, start, depth, budget, polite in jobs:
        start = start.replace("S.com:80", "s.com").split("#")[0]
        denied = ("http://s.com/p1", "http://s.com/p0")
        outcomes, tree = _walk(pages, start, depth, budget, lambda u: not (polite and u.startswith(denied)))
        assert got[name] == dict(outcomes), name
        assert trees.get(name, {}) == tree, name


def test_link_cap_and_deep_order(spark):
    pages = {"http://s.com/p0": ([f"http://s.com/c{i}" for i in range(150)], None)}
    pages |= {f"http://s.com/c{i}": ([], None) for i in range(150)}
    jobs = spark.createDataFrame([("j", "http://s.com/p0", 2, 1000, False, "IN_PROGRESS")], JOBS)
    out = C.crawled_urls(C.crawl(jobs, _site(spark, pages, 2)))
    assert {r.url for r in out.collect()} == {"http://s.com/p0"} | {f"http://s.com/c{i}" for i in range(100)}
    chain = {f"http://s.com/p{i}": ([f"http://s.com/p{i + 1}"], None) for i in range(15)}
    jobs = spark.createDataFrame([("deep", "http://s.com/p0", 10, 1000, False, "IN_PROGRESS")], JOBS)
    out = C.crawl(jobs, _site(spark, chain, 2)).collect()
    assert sorted(r.depth for r in out) == list(range(11))
    assert out[0].url_hash == hashlib.sha256(out[0].url.encode()).hexdigest()


def test_a_round_reads_visited_keys_once(spark, monkeypatch):
    """Rounds after the first read one folder of narrow keys, and no earlier level."""
    reads, real = [], C._Visited.read

    def counted(self):
        reads.append(self.schema)
        return real(self)
    monkeypatch.setattr(C._Visited, "read", counted)
    pages = {f"http://h.com/{i}": ([f"http://h.com/{i + 1}", f"http://h.com/{max(0, i - 1)}"], None) for i in range(6)}
    jobs = spark.createDataFrame([("j", "http://h.com/0", 4, 100, True, "IN_PROGRESS")], JOBS)
    site = _site(spark, pages, 2)
    rows = C.crawled_urls(C.crawl(jobs, site)).collect()
    assert sorted((r.url, r.depth) for r in rows) == [(f"http://h.com/{i}", i) for i in range(5)]
    assert reads[0] is None and len(reads) == 5 and all(s.names == ["job_id", "url_hash"] for s in reads[1:])
