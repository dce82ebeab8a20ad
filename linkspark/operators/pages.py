"""Page extraction: one pass over the snapshot, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import html as H
from linkspark.functions import urls as U

NO_RESPONSE = "No response received"
LINKS = "array<struct<pos:int,href:string,text:string,rel:string>>"


def extract_pages(pages: DataFrame, max_content: int | None = H.MAX_CONTENT,
                  max_anchor_text: int | None = H.MAX_ANCHOR_TEXT) -> DataFrame:
    """Add ``title``, ``content``, ``links``, ``links_count`` and ``base_href`` to a table with ``html``.

    Content and anchor texts are kept up to a length, as page records have them; None keeps them whole.
    Columns nobody reads are pruned, so asking for titles only costs the title pattern only.
    Pages without html (errors) get NULL title and content and no links.
    """
    return (pages.withColumn("title", F.expr(H.title("html")))
            .withColumn("content", F.expr(H.main_text("html", max_content)))
            .withColumn("links", F.expr(f"coalesce({H.anchors('html', max_anchor_text)}, CAST(array() AS {LINKS}))"))
            .withColumn("links_count", F.size("links"))
            .withColumn("base_href", F.expr(H.base_href("html"))))


def build_page_records(extracted: DataFrame, job_id: Column, depth: Column, crawled_at: Column) -> DataFrame:
    """Rows of ``crawled_pages``; URLs that have no canonical form are left out."""
    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in extracted.columns else F.lit(None).cast(kind)

    return (extracted.withColumn("normalized_url", F.expr(f"{U.canonical('url')}.canonical"))
            .filter("normalized_url is not null")
            .select(
                job_id.alias("job_id"), "url", "normalized_url",
                F.expr(U.url_hash("normalized_url")).alias("url_hash"),
                "title", "content", depth.cast("int").alias("depth"),
                given("status_code", "int").alias("status_code"),
                given("content_type", "string").alias("content_type"),
                F.col("links_count").cast("int").alias("links_count"),
                crawled_at.alias("crawled_at")))
