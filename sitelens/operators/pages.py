"""Page-level operators: O10 last_wins, O34 last_modified_lookup,
O40 media_report, O41 crawl_tally, O42 union_sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import DEFAULT, AuditConfig
from .elements import admit_pages, is_redirect, one_page_per_url


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              values: Sequence[str]) -> DataFrame:
    """Map-put semantics, the entry latest in ``order`` wins per key.

    ``max_by`` over a struct of the order columns is a partial aggregate:
    each task keeps one row per key before the shuffle, so a key repeated
    across a large share of the input is not a hot group.
    """
    o = F.struct(*order)
    v = F.struct(*values)
    return (df.groupBy(*keys).agg(F.max_by(v, o).alias("_v"))
            .select(*keys, *[F.col("_v")[c].alias(c) for c in values]))


def last_modified_lookup(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """Exact url lookup, null on a miss. ``dates`` has one row per url
    (after O10); AQE picks broadcast or sort-merge from its measured size."""
    return facts.join(dates.select("url", "last_modified"), "url", "left")


def union_sources(*parts: DataFrame) -> DataFrame:
    """Union of listing sources by column name (duplicates kept; apply
    O10 afterwards for map semantics)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def media_report(listing: DataFrame, pages: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O40 (+ O8, O9, O33): (sheet, url, template_ids) for listed pages that
    were read and have at least one media id; one row per url in a sheet
    (last wins: the same page gives the same ids). Pure native plan.
    """
    ids = (admit_pages(one_page_per_url(pages))
           .select("url", fn.media_ids(fn.join_lines("html"), cfg.media_prefix, cfg.media_suffixes).alias("ids"))
           .where(F.size("ids") > 0))
    return (listing.select("sheet", "url").distinct().join(ids, "url")
            .select("sheet", "url", fn.show_set("ids").alias("template_ids")))


def crawl_tally(listing: DataFrame, pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per index document: pages listed, processed (listed minus
    redirected) and ignored (redirected). ``documents`` (index_url) adds a line
    of zeros for each document that lists no page."""
    # both sides reduced to one row per key before the join: a url listed
    # very often, or fetched more than once, is never a hot join key
    st = one_page_per_url(pages).select("url", "status")
    listed = listing.groupBy("index_url", "url").agg(F.count(F.lit(1)).alias("times"))
    j = listed.join(st, "url", "left")
    red = is_redirect(F.col("status")).cast("long") * F.col("times")
    tally = (j.groupBy("index_url")
             .agg(F.sum("times").alias("listed"),
                  F.coalesce(F.sum(red), F.lit(0)).alias("ignored")))
    if documents is not None:
        tally = documents.select("index_url").distinct().join(tally, "index_url", "left").na.fill(0)
    return (tally.select("index_url", "listed", (F.col("listed") - F.col("ignored")).alias("processed"),
                    "ignored"))
