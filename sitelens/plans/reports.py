"""The ten whole reports as DataFrame plans.

Each takes the fetched pages table ``pages(url, status, html)`` plus its
url source (workbook cells, query-index documents, or sitemap documents)
and returns the report DataFrame; nothing is collected. ``elements`` may be
a ``FactStore`` built once for a crawl; otherwise the listed pages are
parsed for this report. Column names are
snake_case; ``sinks.write_report`` renames them to the report headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..operators import blocks, links, pages as pg
from ..sources import listing as src
from .store import FactStore, materialize, parsed_elements


Facts = "DataFrame | FactStore | None"


def _elements(pages, listing, cfg, elements) -> FactStore:
    """The page facts for ``listing``: a given ``FactStore`` (or element
    table) of already-parsed pages, or the listed pages parsed now. Every
    report joins the per-page facts to its listing, so a store covering more
    pages than the listing is fine."""
    if isinstance(elements, FactStore):
        return elements
    if elements is None:
        elements = parsed_elements(pages, listing, cfg)
    return FactStore(elements, cfg)


# P1 -------------------------------------------------------------------------
def report_block_matrix(cells: DataFrame, pages: DataFrame, cfg: AuditConfig = DEFAULT,
                        elements: Facts = None) -> DataFrame:
    """Page x vocabulary count matrix for the workbook urls.
    O1 > O8 > O9 > O16 > O11 > O17 > O13 > O25 > O24."""
    listing = src.cells_to_urls(cells)
    els = _elements(pages, listing, cfg, elements)
    return blocks.block_matrix(listing, None, cfg.vocab, counts=els.block_counts)


# P2 / P3 / P4 ---------------------------------------------------------------
def report_blocks_from_cells(spark: SparkSession, cells: DataFrame, index_docs: DataFrame,
                             pages: DataFrame, cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """block/variant/layout counts for workbook urls, dates from the
    query indexes. A url listed twice counts twice."""
    listing = src.cells_to_urls(cells)
    dates = materialize(src.index_dates(src.query_index_listing(spark, index_docs, cfg)), "dates")
    els = _elements(pages, listing, cfg, elements)
    return blocks.block_variant_layout_report(listing, None, dates, cfg, counts=els.layout_counts)


def report_blocks_from_index(spark: SparkSession, index_docs: DataFrame, pages: DataFrame,
                             cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """As P2 for the query-index urls (each url once)."""
    dates = materialize(src.index_dates(src.query_index_listing(spark, index_docs, cfg)), "dates")
    listing = dates.select("url")
    els = _elements(pages, listing, cfg, elements)
    return blocks.block_variant_layout_report(listing, None, dates, cfg, counts=els.layout_counts)


def report_blocks_from_sitemap(index_urls: DataFrame, sitemap_docs: DataFrame, pages: DataFrame,
                               cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """As P2 for the sitemap urls; the date is the lastmod text."""
    sm = materialize(src.sitemap_pages(index_urls, sitemap_docs, mode="map"), "listing")
    dates = sm.select("url", F.col("lastmod").alias("last_modified"))
    listing = sm.select("url")
    els = _elements(pages, listing, cfg, elements)
    return blocks.block_variant_layout_report(listing, None, dates, cfg, counts=els.layout_counts)


# P5 / P6 --------------------------------------------------------------------
def report_brand_links_all(cells: DataFrame, pages: DataFrame, cfg: AuditConfig = DEFAULT,
                           elements: Facts = None) -> DataFrame:
    """P5: brand links per workbook page, repeats kept."""
    listing = src.cells_to_urls(cells)
    els = _elements(pages, listing, cfg, elements)
    return links.brand_links_report(listing, None, cfg, dedupe=False, links=els.links)


def report_brand_links(spark: SparkSession, index_docs: DataFrame, pages: DataFrame,
                       cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """Brand links per query-index page, substring-deduplicated."""
    listing = materialize(src.query_index_listing(spark, index_docs, cfg).select("url"), "listing")
    els = _elements(pages, listing, cfg, elements)
    return links.brand_links_report(listing, None, cfg, dedupe=True, links=els.links)


# P7 -------------------------------------------------------------------------
def report_links(index_urls: DataFrame, sitemap_docs: DataFrame, pages: DataFrame,
                 cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """One row per (listed page, link) for the sitemap pages, a page
    listed twice giving its rows twice."""
    listing = materialize(src.sitemap_pages(index_urls, sitemap_docs, mode="list").select("url", "page_seq"), "listing")
    els = _elements(pages, listing, cfg, elements)
    return links.link_rows(listing, None, links=els.links, cfg=cfg)


# P8 / P9 --------------------------------------------------------------------
def report_domains_from_index(spark: SparkSession, index_docs: DataFrame, pages: DataFrame,
                              cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """Links and brand / non-brand origins per query-index page."""
    listing = materialize(src.query_index_listing(spark, index_docs, cfg).select("url"), "listing")
    els = _elements(pages, listing, cfg, elements)
    return links.page_domain_report(listing, None, cfg, links=els.links)


def report_domains_from_sitemap(index_urls: DataFrame, sitemap_docs: DataFrame, pages: DataFrame,
                                cfg: AuditConfig = DEFAULT, elements: Facts = None) -> DataFrame:
    """As P8 for the sitemap pages."""
    listing = materialize(src.sitemap_pages(index_urls, sitemap_docs, mode="list").select("url"), "listing")
    els = _elements(pages, listing, cfg, elements)
    return links.page_domain_report(listing, None, cfg, links=els.links)


# P10 ------------------------------------------------------------------------
def report_media(cells: DataFrame, pages: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """P10: media ids per workbook page, by sheet. No parse needed."""
    listing = src.cells_to_urls(cells)
    return pg.media_report(listing, pages, cfg)
