"""URL jobs over a table with a URL column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.functions.sql import let


def canonicalize(df: DataFrame, col: str = "url") -> DataFrame:
    """Add ``canonical`` and ``reason``; failures keep their row with a NULL canonical form."""
    return (df.withColumn("_c", F.expr(U.canonical(col)))
            .withColumn("canonical", F.col("_c.canonical"))
            .withColumn("reason", F.col("_c.reason")).drop("_c"))


def dedupe_urls(df: DataFrame, order: str, col: str = "url") -> DataFrame:
    """First row (by ``order``) per canonical URL, with its SHA-256 key; bad URLs are left out.

    ``min_by`` is combined before the shuffle, so a URL that fills a third of the table is cheap.
    """
    first = canonicalize(df, col).groupBy("canonical").agg(
        F.min_by(F.struct(*df.columns), F.col(order)).alias("_first"),
        F.count("*").alias("copies")).filter("canonical is not null")
    return first.select("_first.*", "canonical", F.expr(U.url_hash("canonical")).alias("url_hash"), "copies")


def with_validity(df: DataFrame, col: str = "url") -> DataFrame:
    return df.withColumn("invalid_reason", F.expr(U.invalid_reason(col)))


def audit_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Row counts per outcome: ``ok`` or the first broken rule."""
    return (with_validity(df, col)
            .groupBy(F.coalesce("invalid_reason", F.lit("ok")).alias("outcome"))
            .agg(F.count("*").alias("urls")))


def filter_strict_urls(df: DataFrame, col: str = "url") -> DataFrame:
    return df.filter(F.col(col).rlike(U.STRICT_URL))


def with_site(df: DataFrame, col: str = "url") -> DataFrame:
    """Add ``host`` (lower-cased, with port) and ``base`` (scheme and host as written)."""
    return (df.withColumn("_u", F.expr(U.split_url(col)))
            .withColumn("host", F.lower("_u.netloc"))
            .withColumn("base", F.concat("_u.scheme", F.lit("://"), "_u.netloc"))
            .drop("_u"))


def pages_per_host(df: DataFrame, col: str = "url") -> DataFrame:
    return df.groupBy(F.expr(U.host(col)).alias("host")).agg(F.count("*").alias("pages"))


def same_site(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``same_site``: equal host and port, whatever the scheme."""
    return df.withColumn("same_site", F.expr(f"{U.host(a)} = {U.host(b)}"))


def resolve_links(df: DataFrame, base: str = "base_url", href: str = "href") -> DataFrame:
    """Add ``resolved``: every href made absolute against its page."""
    return df.withColumn("resolved", F.expr(let(U.base_parts(base), lambda b: U.resolve(b, href))))
