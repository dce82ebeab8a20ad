"""Links of a page: resolve, validate, canonicalise, deduplicate, categorise.

A page carries its links as one array, so everything about one page happens inside its row:
no explode, no grouping, no shuffle. :func:`page_edges` unrolls the array at the very end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.functions.sql import lam, let, struct

CATEGORIES = ("internal", "external", "invalid")
MAX_CHILD_LINKS = 100


def _resolved(links: str, base: str) -> str:
    """struct(c, url, pos, href, anchor_text, rel) of the http(s) links; c is NULL for invalid ones."""
    trimmed = lam(lambda l: struct(pos=f"{l}.pos", href=U.strip(f"{l}.href"), anchor_text=f"{l}.text", rel=f"{l}.rel"))
    given = f"filter(transform({links}, {trimmed}), {lam(lambda l: f"{l}.href != ''")})"
    absolute = lam(lambda l: struct(url=U.resolve(base, f"{l}.href"), link=l))
    # the prefix test is case sensitive and comes after joining
    web = lam(lambda l: f"startswith({l}.url, 'http://') OR startswith({l}.url, 'https://')")
    checked = lam(lambda l: struct(
        c=f"IF({U.invalid_reason(f'{l}.url')} IS NULL, {U.canonical(f'{l}.url')}, NULL)", url=f"{l}.url",
        **{f: f"{l}.link.{f}" for f in ("pos", "href", "anchor_text", "rel")}))
    return f"transform(filter(transform({given}, {absolute}), {web}), {checked})"


def _classified(resolved: str, host: str) -> str:
    """Category of each link; valid ones keep only their first position per canonical URL."""
    def rows(category) -> str:
        return lam(lambda l: struct(
            pos=f"{l}.pos", href=f"{l}.href", url=f"{l}.url", canonical=f"{l}.c.canonical",
            category=category(l), anchor_text=f"{l}.anchor_text", rel=f"{l}.rel"))

    def first_only(ordered: str) -> str:
        keep = lam(lambda x, i: f"{i} = 0 OR get({ordered}, {i} - 1).canonical != {x}.canonical", 2)
        return f"filter({ordered}, {keep})"

    def split(links: str) -> str:
        valid = f"filter({links}, {lam(lambda l: f'{l}.c.canonical IS NOT NULL')})"
        invalid = f"filter({links}, {lam(lambda l: f'{l}.c.canonical IS NULL')})"
        # sorted by (canonical, pos): the first of each run is the first in the document
        keyed = lam(lambda l: struct(canonical=f"{l}.c.canonical", **{f: f"{l}.{f}" for f in (
            "pos", "c", "url", "href", "anchor_text", "rel")}))
        unique = let(f"sort_array(transform({valid}, {keyed}))", first_only)
        inside = rows(lambda l: f"IF({l}.c.netloc = {host}, 'internal', 'external')")
        outside = rows(lambda l: "'invalid'")
        return f"sort_array(concat(transform({unique}, {inside}), transform({invalid}, {outside})))"

    return let(resolved, split)


def page_links(pages: DataFrame, same_domain_only: bool = False) -> DataFrame:
    """Replace ``links`` by resolved, deduplicated, categorised links, in document order.

    Needs ``url`` and ``links array<struct<pos,href,text,rel>>``; links are relative to ``base_href`` where the
    table has one that isn't empty, which is relative to ``url`` itself. Each link gets ``rank``, its
    1-based place among the links of the same category on that page, so "first n internal
    links" is a plain filter later on.
    """
    wanted = [c for c in CATEGORIES if not (same_domain_only and c == "external")]

    def of_category(links: str, category: str) -> str:
        own = lam(lambda l: f"{l}.category = '{category}'")
        ranked = lam(lambda l, i: struct(
            pos=f"{l}.pos", href=f"{l}.href", url=f"{l}.url", canonical=f"{l}.canonical",
            url_hash=U.url_hash(f"{l}.canonical"), category=f"{l}.category", rank=f"{i} + 1",
            anchor_text=f"{l}.anchor_text", rel=f"{l}.rel"), 2)
        return f"transform(filter({links}, {own}), {ranked})"

    def against(page: str) -> str:
        host = f"lower({page}.netloc)"
        if "base_href" not in pages.columns:
            return _classified(_resolved("links", page), host)
        start = f"IF(coalesce(base_href, '') = '', {page}, {U.base_parts(U.resolve(page, 'base_href'))})"
        return let(start, lambda b: _classified(_resolved("links", b), host))

    found = let(U.base_parts("url"), against)
    ranked = let(found, lambda links: f"concat({', '.join(of_category(links, c) for c in wanted)})")
    return pages.withColumn("links", F.expr(ranked))


def page_edges(linked: DataFrame, *keep: str) -> DataFrame:
    """One row per link of :func:`page_links` output.

    ``explode_outer`` plus a test on the result: a plain ``explode`` makes the optimizer test the
    size of the array first, which would run the whole extraction twice.
    """
    rows = linked.select(*keep, F.col("url").alias("source_url"), F.explode_outer("links").alias("_l"))
    return rows.filter("_l is not null").select(
        *keep, "source_url", F.col("_l.pos").alias("pos"), F.col("_l.href").alias("href"),
        F.col("_l.url").alias("target_url"), F.col("_l.canonical").alias("canonical"),
        F.col("_l.url_hash").alias("url_hash"), F.col("_l.category").alias("category"),
        F.col("_l.rank").alias("rank"), F.col("_l.anchor_text").alias("anchor_text"),
        F.col("_l.rel").alias("rel"))


def categorize_links(edges: DataFrame, *by: str) -> DataFrame:
    """Links per category, one column each."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    return edges.groupBy(*by).agg(*counts)


def filter_links(df: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = (),
                 max_depth: int | None = None, col: str = "canonical") -> DataFrame:
    """Substring rules and a limit on the number of path segments."""
    url = F.col(col)
    if exclude:
        df = df.filter(~reduce(lambda a, b: a | b, [url.contains(p) for p in exclude]))
    if include:
        df = df.filter(reduce(lambda a, b: a | b, [url.contains(p) for p in include]))
    if max_depth is not None:
        segments = f"filter(split({U.split_url(col)}.path, '/'), {lam(lambda s: f"{s} != ''")})"
        df = df.filter(f"size({segments}) <= {max_depth}")
    return df


def cap_links(edges: DataFrame, n: int = MAX_CHILD_LINKS) -> DataFrame:
    """The first ``n`` internal links of each page, in document order."""
    return edges.filter((F.col("category") == "internal") & (F.col("rank") <= n))
