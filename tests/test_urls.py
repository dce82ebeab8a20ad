"""URL rules: golden rows, and random strings against the standard library."""
from urllib.parse import quote, unquote, urljoin, urlparse, urlunparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.functions.sql import let
from linkspark.operators import urls as O

CANONICAL = [
    ("http://Wiki.Novak.CZ:80/Mapa/Praha/?lang=cs&b=2&a=1#nahoru", "http://wiki.novak.cz/Mapa/Praha?a=1&b=2&lang=cs"),
    ("\thttps://kiosk.fi:443", "https://kiosk.fi/"),
    ("https://kiosk.fi:80/", "https://kiosk.fi:80/"),
    ("http://10.0.0.7:9200/_cat/?v", "http://10.0.0.7:9200/_cat?v"),
    ("https://tarn.no//x//", "https://tarn.no//x/"),
    ("https://tarn.no/list/;page=2", "https://tarn.no/list;page=2"),
    ("HTTPS://u:P@Tarn.NO/A b?&&Q=1", "https://u:p@tarn.no/A b?&&Q=1"),
    ("https://tarn.no?#", "https://tarn.no/"),
    ("gopher://tarn.no/1", None), ("//tarn.no/x", None), ("tarn.no/x", None), ("http://[::1/x", None), ("", None), (None, None),
]


def test_canonical_golden(spark):
    df = spark.createDataFrame(CANONICAL, "url string, want string")
    for row in O.canonicalize(df).collect():
        assert row.canonical == row.want, row
        assert (row.reason is None) == (row.want is not None)


def test_validity_and_audit(spark):
    cases = [("http://example.com", None), ("https://example.com/path?q=1", None), ("ftp://example.com", "scheme"),
             ("", "scheme"), ("example.com", "scheme"), ("https://example.com/" + "a" * 2048, "length"),
             ("http://localhost:8000/api", None), ("http:///x", "netloc"), (None, "null")]
    df = spark.createDataFrame(cases, "url string, want string")
    for row in O.with_validity(df).collect():
        assert row.invalid_reason == row.want, row
    counts = {r.outcome: r.urls for r in O.audit_urls(df).collect()}
    assert counts == {"ok": 3, "scheme": 3, "length": 1, "netloc": 1, "null": 1}


def test_strict_filter(spark):
    good = ["http://tarn.no", "HTTPS://a-b.kiosk.museum/?k=v#f", "http://10.0.0.7:9200", "https://localhost/", "http://x.y.z.io:1/%20"]
    bad = ["gopher://tarn.no", "tarn.no", "http://-tarn.no", "http://tarn.computers", "http://tarn", "http://tarn.no:port/"]
    df = spark.createDataFrame([(u,) for u in good + bad], "url string")
    assert {r.url for r in O.filter_strict_urls(df).collect()} == set(good)


def test_site_keys_and_same_site(spark):
    df = spark.createDataFrame([("https://EXAMPLE.com:8443/path",), ("http://localhost:8000/api/v1",)], "url string")
    rows = {(r.host, r.base) for r in O.with_site(df).collect()}
    assert rows == {("example.com:8443", "https://EXAMPLE.com:8443"), ("localhost:8000", "http://localhost:8000")}
    pairs = [("https://example.com/a", "https://example.com/b", True), ("https://example.com", "https://other.com", False),
             ("https://EXAMPLE.COM/a", "https://example.com/b", True),
             ("https://www.example.com", "https://api.example.com", False), ("http://example.com", "https://example.com", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.same_site == r.want for r in O.same_site(df, "a", "b").collect())


def test_dedupe_keeps_first_and_counts(spark):
    rows = [(3, "http://a.com/x/"), (1, "http://A.com/x"), (2, "http://a.com/x#f"), (4, "ftp://a.com")]
    out = O.dedupe_urls(spark.createDataFrame(rows, "i int, url string"), "i").collect()
    assert [(r.i, r.canonical, r.copies) for r in out] == [(1, "http://a.com/x", 3)]
    assert len(out[0].url_hash) == 64


def _canonical(url):
    p = urlparse(url.strip())
    if p.scheme not in ("http", "https"):
        return None
    host = p.netloc.lower()
    default = {"http": ":80", "https": ":443"}[p.scheme]
    host = host.removesuffix(default)
    path = p.path if p.path == "/" else p.path[:-1] if p.path.endswith("/") else p.path
    return urlunparse((p.scheme, host, path or "/", p.params, "&".join(sorted(p.query.split("&"))), ""))


pieces = st.sampled_from([
    "http", "https", "HTTP", ":", "//", "/", "a", "B", ".", "..", "?", "#", ";", "&", "=", "x=1", "%41", "%zz",
    "ex.com", "EX.com:80", ":443", " ", "é", "@", "mailto", "+", "~", "*"])
hrefs = st.builds(lambda head, parts: head + "".join(parts),
                  st.sampled_from(["", "http://ex.com/", "https://H.com:443/", "http://h.com:80", "/", "../", "//x.org/"]),
                  st.lists(pieces, max_size=9))
bases = st.sampled_from(["http://ex.com/a/b?q=1#f", "https://ex.com", "http://EX.com:80/x/;p", "https://ex.com/a/b/../c/",
                         "https://h.de//d//e;z?b&a"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(bases, hrefs), min_size=150, max_size=200))
def test_like_the_standard_library(spark, cases):
    df = spark.createDataFrame(cases, "base string, u string")
    rows = df.select(
        "base", "u", F.expr(U.split_url("u")).alias("parts"), F.expr(U.canonical("u")).canonical.alias("canonical"),
        F.expr(let(U.base_parts("base"), lambda b: U.resolve(b, "u"))).alias("resolved"),
        F.expr(U.quote(U.unquote("u"))).alias("quoted")).collect()
    for r in rows:
        if urlparse(r.u).scheme in ("", "http", "https"):
            assert tuple(r.parts) == tuple(urlparse(r.u)), r.u
        assert r.canonical == _canonical(r.u), r.u
        assert r.resolved == urljoin(r.base, r.u), (r.base, r.u)
        assert r.quoted == quote(unquote(r.u)), r.u
