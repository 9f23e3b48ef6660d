"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame``
per operator of SURVEY section 2 and per whole report (section 2.10).

Every query reads the driver's tables (``pages`` through the fixture view
and the documents derived from it) over their whole extent. Column names
and types equal those of the DuckDB oracles in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import DEFAULT
from ..operators import blocks, elements as el, links, pages as pg
from ..session import app_id, apply_session_conf, checkpoint_dir
from ..sources import fixture as fx
from ..sources import listing as src
from . import reports as R
from .store import parsed_elements, write_table

cfg = DEFAULT


_INPUTS: dict[tuple[str, str, str], str] = {}
TASK_ELEMENTS = 250_000  # elements numbered by one task, about


class Fixture:
    """The fixture input tables of one scale factor.

    The inputs (site pages, workbook cells, index and sitemap documents) are
    derived from the driver's ``pages`` table and written once per Spark
    application and scale factor under the checkpoint folder, as a crawl
    stores its fetched tables; every query then reads them like any table.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        apply_session_conf(spark)
        self.spark = spark
        self.sf = sf_dir

    def _input(self, name: str, build) -> DataFrame:
        key = (app_id(self.spark), self.sf, name)
        path = _INPUTS.get(key)
        if path is None:
            path = _INPUTS[key] = write_table(build(), f"input-{name}")
        return self.spark.read.parquet(path)

    @property
    def pages(self) -> DataFrame:
        return self._input("pages", lambda: fx.site_pages(self.spark, self.sf))

    @property
    def fetched(self) -> DataFrame:
        """The pages as a crawl stores them: some urls with a failed copy."""
        stale = self.pages.where("page_id % 13 = 4").select(
            "page_id", "url", F.lit(404).alias("status"), F.lit('<a href="/stale" class="banner">media_old.png</a>').alias("html"))
        return self._input("fetched", lambda: self.pages.unionByName(stale.select(self.pages.columns)))

    @property
    def crawled(self) -> DataFrame:
        """``fetched`` with gaps: no status, no markup, no page at all."""
        status = F.when(F.col("page_id") % 19 != 3, F.col("status"))
        html = F.when(F.col("page_id") % 23 != 5, F.col("html"))
        return self._input("crawled", lambda: self.fetched.where("page_id % 29 != 7").select(
            "page_id", "url", status.alias("status"), html.alias("html")))

    @property
    def cells(self) -> DataFrame:
        return self._input("cells", lambda: fx.sheet_cells(self.spark, self.sf))

    @property
    def index_docs(self) -> DataFrame:
        return self._input("index_docs", lambda: fx.index_documents(self.spark, self.sf, cfg))

    @property
    def sitemap_docs(self) -> DataFrame:
        return self._input("sitemap_docs", lambda: fx.sitemap_documents(self.spark, self.sf, cfg))

    @property
    def sitemap_index(self) -> DataFrame:
        return self._input("sitemap_index", lambda: fx.sitemap_index_urls(self.spark, self.sf, cfg))

    def qi_listing(self) -> DataFrame:
        return src.query_index_listing(self.spark, self.index_docs, cfg)

    def elements(self, persist: bool = False) -> DataFrame:
        """The fact rows (O16) of every admitted page, parsed where they are read, or
        parsed once and stored, for what reads them several times."""
        return parsed_elements(self.fetched, None, cfg, persist=persist)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.parquet(write_table(df, name))


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


# -- sources ------------------------------------------------------------------
def q_cells_to_urls(spark, sf):
    return src.cells_to_urls(Fixture(spark, sf).cells).select("sheet", "row_num", "col_num", "url")


def q_admit_pages(spark, sf):
    return el.admit_pages(Fixture(spark, sf).pages).select("page_id", "url", "status")


def q_rejects(spark, sf):
    return el.rejects(Fixture(spark, sf).pages)


def q_listing_reconciled(spark, sf):
    """O45 over a run: all listings against a crawl in which some pages have no
    status or no markup and some were never fetched."""
    f = Fixture(spark, sf)
    listing = pg.union_sources(src.cells_to_urls(f.cells).select("url"), f.qi_listing().select("url"),
                               src.sitemap_pages(f.sitemap_index, f.sitemap_docs, mode="list").select("url"))
    return el.reconciled(listing, f.crawled)


def q_join_lines(spark, sf):
    p = el.admit_pages(Fixture(spark, sf).pages)
    j = fn.join_lines("html")
    return p.select("page_id", F.length(j).cast("long").alias("n_chars"), F.md5(j).alias("html_md5"))


def q_admit_index_docs(spark, sf):
    f = Fixture(spark, sf)
    urls = src.expand_index_urls(spark, cfg).select("index_url")
    return (src.admit_index_docs(f.index_docs).join(F.broadcast(urls), "index_url")
            .select("index_url", _long("part")))


def q_index_doc_rejects(spark, sf):
    return src.index_doc_rejects(spark, Fixture(spark, sf).index_docs, cfg).select(
        "index_url", _long("part"), "status", "reason")


def q_index_entry_rejects(spark, sf):
    return src.index_entry_rejects(spark, Fixture(spark, sf).index_docs, cfg).select(
        "index_url", _long("part"), _long("pos"), "reason")


def q_read_query_index(spark, sf):
    return Fixture(spark, sf).qi_listing().select(
        "index_url", "url", fn.format_epoch("last_modified_raw").alias("last_modified"))


def q_format_epoch(spark, sf):
    return Fixture(spark, sf).qi_listing().select(
        "url", "last_modified_raw", fn.format_epoch("last_modified_raw").alias("last_modified"))


def q_last_wins(spark, sf):
    return src.index_dates(Fixture(spark, sf).qi_listing())


def _sitemap_index_docs(f: Fixture) -> DataFrame:
    return (f.sitemap_docs.join(f.sitemap_index.select(F.col("index_url").alias("doc_url")), "doc_url")
            .withColumnRenamed("doc_url", "index_url"))


def q_read_sitemap_index(spark, sf):
    return src.read_sitemap_index(_sitemap_index_docs(Fixture(spark, sf))).select(
        "index_url", _long("child_pos"), "sitemap_url")


def q_read_sitemap_urls(spark, sf):
    return src.read_sitemap_urls(Fixture(spark, sf).sitemap_docs, mode="map").select(
        "doc_url", _long("pos"), "loc", "lastmod")


def q_read_sitemap_files(spark, sf):
    """O5 over documents stored as files, cut by the text source."""
    f = Fixture(spark, sf)
    docs = f.sitemap_docs.withColumn("file", F.md5("doc_url"))
    key = (app_id(spark), sf, "sitemap-files")
    if key not in _INPUTS:
        path = f"{checkpoint_dir(spark).rstrip('/')}/input-sitemap-files-{uuid.uuid4().hex}"
        docs.select("file", F.col("body").alias("value")).write.partitionBy("file").text(path)
        _INPUTS[key] = path
    rows = src.read_sitemap_files(spark, _INPUTS[key], docs.drop("body"), mode="map")
    place = F.row_number().over(Window.partitionBy("doc_url").orderBy("pos")) - 1
    return rows.select("doc_url", place.cast("long").alias("pos"), "loc", "lastmod")


def q_sitemap_doc_rejects(spark, sf):
    f = Fixture(spark, sf)
    return src.sitemap_doc_rejects(f.sitemap_index, f.sitemap_docs)


def q_sitemap_pages(spark, sf):
    f = Fixture(spark, sf)
    return src.sitemap_pages(f.sitemap_index, f.sitemap_docs, mode="map")


def q_sitemap_listing(spark, sf):
    f = Fixture(spark, sf)
    return src.sitemap_pages(f.sitemap_index, f.sitemap_docs, mode="list").select("url", "doc_url")


def q_union_sources(spark, sf):
    f = Fixture(spark, sf)
    return pg.union_sources(
        src.cells_to_urls(f.cells).select(F.lit("cells").alias("source"), "url"),
        f.qi_listing().select(F.lit("query_index").alias("source"), "url"),
        src.sitemap_pages(f.sitemap_index, f.sitemap_docs, mode="map")
        .select(F.lit("sitemap").alias("source"), "url"))


def q_page_language(spark, sf):
    return Fixture(spark, sf).pages.select("url", fn.page_language("url", cfg.site_prefix).alias("language"))


# -- elements -----------------------------------------------------------------
def q_class_elements(spark, sf):
    """Each element with a class attribute, by its place among those of the page."""
    w = Window.partitionBy("page_key").orderBy("pre")
    return el.class_elements(Fixture(spark, sf).elements()).select(
        "url", F.row_number().over(w).cast("long").alias("n"), "tag", F.array_join("classes", " ").alias("classes"))


def q_href_elements(spark, sf):
    return el.href_elements(Fixture(spark, sf).elements()).select("url", "href")


def q_class_tokens(spark, sf):
    return (el.class_elements(Fixture(spark, sf).elements())
            .select("url", F.explode("classes").alias("token"))
            .groupBy("url", "token").agg(F.count(F.lit(1)).alias("n")))


def q_block_counts(spark, sf):
    return blocks.block_counts(Fixture(spark, sf).elements(), cfg.vocab)


def q_primary_block(spark, sf):
    return (blocks.block_elements(Fixture(spark, sf).elements(), cfg)
            .groupBy("url", "block", "variant").agg(F.count(F.lit(1)).alias("n")))


def q_chain_label(spark, sf):
    return blocks.block_elements(Fixture(spark, sf).elements(), cfg).select("url", "block", "variant", "chain")


def q_section_scope(spark, sf):
    return blocks.block_facts(Fixture(spark, sf).elements(persist=True), cfg).select(
        "url", "block", "variant", _long("n_sections"))


def q_section_terms(spark, sf):
    els = Fixture(spark, sf).elements(persist=True)
    st = blocks.section_terms(els, cfg).join(els.where("pre = 0").select("page_key", "url"), "page_key")
    w = Window.partitionBy("page_key").orderBy("pre")
    return st.select("url", F.row_number().over(w).cast("long").alias("section_no"),
                     "has_desktop", "has_mobile")


def q_layout_label(spark, sf):
    return blocks.block_facts(Fixture(spark, sf).elements(persist=True), cfg).select("url", "block", "variant", "layout")


# -- links --------------------------------------------------------------------
def q_substring_dedupe(spark, sf):
    return (links.page_links(Fixture(spark, sf).elements())
            .select("url", F.posexplode(fn.substring_dedupe("hrefs")).alias("i", "link"))
            .select("url", _long("i"), "link"))


def _abs_hrefs(spark, sf):
    return el.href_elements(Fixture(spark, sf).elements()).where(fn.is_absolute_url("href", cfg.url_schemes))


def q_absolute_url_filter(spark, sf):
    return _abs_hrefs(spark, sf).select("url", "href")


def q_url_origin(spark, sf):
    return _abs_hrefs(spark, sf).select("url", "href", fn.url_origin("href").alias("origin"))


def q_classify_origin(spark, sf):
    o = _abs_hrefs(spark, sf).select(fn.url_origin("href").alias("origin")).distinct()
    return o.select("origin", fn.is_brand("origin", cfg.brand).alias("is_brand"))


def q_unique_domains(spark, sf):
    f = Fixture(spark, sf)
    listing = f.qi_listing()
    els = parsed_elements(f.fetched, listing, cfg)
    return links.unique_domains(listing, els, cfg, by="family")


def q_unique_domains_run(spark, sf):
    """O39 over a whole run: the sitemap's pages."""
    f = Fixture(spark, sf)
    listing = src.sitemap_pages(f.sitemap_index, f.sitemap_docs, mode="list")
    return links.unique_domains(listing, f.elements(), cfg, by=None)


# -- pages --------------------------------------------------------------------
def q_media_ids(spark, sf):
    p = el.admit_pages(Fixture(spark, sf).pages)
    ids = fn.media_ids(fn.join_lines("html"), cfg.media_prefix, cfg.media_suffixes)
    return p.select("url", ids.alias("ids")).where(F.size("ids") > 0).select(
        "url", fn.show_set("ids").alias("template_ids"))


def q_last_modified_lookup(spark, sf):
    f = Fixture(spark, sf)
    listed = src.cells_to_urls(f.cells).select("url").distinct()
    read = listed.join(el.admit_pages(f.pages).select("url"), "url", "left_semi")
    dates = src.index_dates(f.qi_listing())
    return pg.last_modified_lookup(read, dates).select("url", "last_modified")


def q_crawl_tally(spark, sf):
    f = Fixture(spark, sf)
    urls = src.expand_index_urls(spark, cfg).select("index_url")
    documents = src.admit_index_docs(f.index_docs).join(F.broadcast(urls), "index_url")
    return pg.crawl_tally(f.qi_listing(), f.fetched, documents)


# -- operator forms (listing = every page of the site) --------------------------
def q_known_block_filter(spark, sf):
    return blocks.known_block_tokens(Fixture(spark, sf).elements(), cfg.vocab).select("url", "block")


def q_brand_link_filter(spark, sf):
    h = el.href_elements(Fixture(spark, sf).elements())
    return h.where(fn.is_brand("href", cfg.brand)).select("url", "href")


def q_extract_elements(spark, sf):
    """Each element by its place on the page, with its parent's place. Left out are
    b and br, so that the places can be told from the markup alone; an element that
    was put into a b would have no parent here."""
    els = write_and_read(parsed_elements(Fixture(spark, sf).fetched, None, cfg, persist=False, keep="all")
                         .where(~F.col("tag").isin("b", "br")).select("page_key", "url", "pre", "parent_pre", "tag"), "all-elements")
    # as many tasks as the rows need, not as AQE makes of their well packed bytes
    by_page = Window.partitionBy("page_key")
    placed = els.repartition(els.count() // TASK_ELEMENTS + 1, "page_key").withColumn(
        "n", F.row_number().over(by_page.orderBy("pre")).cast("long"))
    # each element stands at its own place and, without a number, at its parent's, right after that
    own = F.struct(F.col("pre").alias("at"), F.col("n").alias("own"))
    parent = F.struct(F.col("parent_pre").alias("at"), F.lit(None).cast("long").alias("own"))
    both = placed.select("page_key", "url", "n", "tag", F.inline(F.array(own, parent)))
    before = by_page.orderBy("at", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("own").isNotNull(), F.col("at")), ignorenulls=True).over(before)
    found = both.select("url", "n", "tag", "at", "own", last.alias("last"), F.last("own", ignorenulls=True).over(before).alias("last_n"))
    return found.where("own IS NULL").select("url", "n", F.when(F.col("last") == F.col("at"), F.col("last_n")).alias("parent_n"), "tag")


def q_variant_name(spark, sf):
    return blocks.block_elements(Fixture(spark, sf).elements(), cfg).select("url", "variant")


def q_join_links(spark, sf):
    return links.page_links(Fixture(spark, sf).elements()).select(
        "url", fn.join_links("hrefs").alias("href_links"))


def q_split_star(spark, sf):
    return (el.href_elements(Fixture(spark, sf).elements())
            .select("url", F.explode(fn.split_star("href")).alias("part")))


def q_block_matrix(spark, sf):
    f = Fixture(spark, sf)
    return blocks.block_matrix(f.pages.select("url"), f.elements(), cfg.vocab)


def q_block_variant_layout_report(spark, sf):
    f = Fixture(spark, sf)
    return blocks.block_variant_layout_report(f.pages.select("url"), f.elements(persist=True), None, cfg)


def q_brand_links_report(spark, sf):
    f = Fixture(spark, sf)
    return links.brand_links_report(f.pages.select("url"), f.elements(), cfg, dedupe=True)


def q_link_rows(spark, sf):
    f = Fixture(spark, sf)
    listing = f.pages.select("url", F.col("page_id").alias("page_seq"))
    return links.link_rows(listing, f.elements()).select("url", _long("i"), _long("j"), "link")


def q_page_domain_report(spark, sf):
    f = Fixture(spark, sf)
    return links.page_domain_report(f.pages.select("url"), f.elements(), cfg)


def q_media_report(spark, sf):
    f = Fixture(spark, sf)
    return pg.media_report(f.pages.select(F.lit("site").alias("sheet"), "url"), f.fetched, cfg)


def q_write_report(spark, sf):
    """O43 round trip: the P5 report written as CSV with its headers, read back."""
    from ..sinks import read_report, write_report
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-links-{uuid.uuid4().hex}"
    write_report(q_report_brand_links_all(spark, sf), path, "links")
    return read_report(spark, path, "`URL` string, `HREF LINKS` string")


def q_write_report_by_sheet(spark, sf):
    """O44 round trip: the P10 report written one folder per sheet, read back."""
    from ..sinks import read_report, write_report_by_sheet
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-media-{uuid.uuid4().hex}"
    write_report_by_sheet(q_report_media(spark, sf), path, "media")
    return read_report(spark, path, "`Url` string, `Template Ids` string, sheet string")


# -- whole reports --------------------------------------------------------------
def q_report_block_matrix(spark, sf):
    f = Fixture(spark, sf)
    return R.report_block_matrix(f.cells, f.fetched, cfg)


def q_report_blocks_from_cells(spark, sf):
    f = Fixture(spark, sf)
    return R.report_blocks_from_cells(spark, f.cells, f.index_docs, f.fetched, cfg)


def q_report_blocks_from_index(spark, sf):
    f = Fixture(spark, sf)
    return R.report_blocks_from_index(spark, f.index_docs, f.fetched, cfg)


def q_report_blocks_from_sitemap(spark, sf):
    f = Fixture(spark, sf)
    return R.report_blocks_from_sitemap(f.sitemap_index, f.sitemap_docs, f.fetched, cfg)


def q_report_brand_links_all(spark, sf):
    f = Fixture(spark, sf)
    return R.report_brand_links_all(f.cells, f.fetched, cfg)


def q_report_brand_links(spark, sf):
    f = Fixture(spark, sf)
    return R.report_brand_links(spark, f.index_docs, f.fetched, cfg)


def q_report_links(spark, sf):
    f = Fixture(spark, sf)
    return R.report_links(f.sitemap_index, f.sitemap_docs, f.fetched, cfg).select(
        "url", _long("i"), _long("j"), "link")


def q_report_domains_from_index(spark, sf):
    f = Fixture(spark, sf)
    return R.report_domains_from_index(spark, f.index_docs, f.fetched, cfg)


def q_report_domains_from_sitemap(spark, sf):
    f = Fixture(spark, sf)
    return R.report_domains_from_sitemap(f.sitemap_index, f.sitemap_docs, f.fetched, cfg)


def q_report_media(spark, sf):
    f = Fixture(spark, sf)
    return R.report_media(f.cells, f.fetched, cfg)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn_ for name, fn_ in sorted(globals().items()) if name.startswith("q_") and callable(fn_)
}

# Reports timed by bench.py (the headline workload).
HEADLINE = [
    "report_block_matrix", "report_blocks_from_cells", "report_blocks_from_index",
    "report_blocks_from_sitemap", "report_brand_links_all", "report_brand_links", "report_links",
    "report_domains_from_index", "report_domains_from_sitemap", "report_media",
]
