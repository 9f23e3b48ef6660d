"""Parse once, read many: the element table is written as Parquet in the
shared checkpoint folder and every consumer reads it back.

A report reads the element table several times (blocks, sections, terms,
links); without this each read would re-run the Python parse. A written
table also cuts the lineage: a lost executor re-reads files instead of
re-parsing pages.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, AuditConfig
from ..operators.elements import extract_elements, one_page_per_url, page_bodies
from ..session import checkpoint_dir, delete_folder

# the folder that a report's intermediate tables go to, inside ``temporary_tables``
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under the shared checkpoint folder; return the path."""
    parts = [checkpoint_dir(df.sparkSession).rstrip("/"), _FOLDER.get(), f"{name}-{uuid.uuid4().hex}"]
    path = "/".join(p for p in parts if p)
    df.write.mode("overwrite").parquet(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that ``write_table`` makes inside the block go to a folder of its own,
    which is deleted when the block ends: for callers that have written their result
    by then. Blocks in other threads have other folders."""
    folder = f"report-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        delete_folder(spark, f"{checkpoint_dir(spark).rstrip('/')}/{folder}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.parquet(write_table(df, name))


def listed_pages(pages: DataFrame, listing: DataFrame | None) -> DataFrame:
    """Pages (url, html with joined lines) to parse for ``listing`` (None: the
    whole crawl): the listed ones, one copy per url, admitted. Spark broadcasts
    the distinct urls where they are small and sort-merges beyond that; the
    result is the same."""
    if listing is not None:
        pages = pages.join(listing.select("url").distinct(), "url", "left_semi")
    return page_bodies(one_page_per_url(pages))


def parsed_elements(pages: DataFrame, listing: DataFrame | None, cfg: AuditConfig = DEFAULT,
                    persist: bool = True, keep: str = "facts") -> DataFrame:
    """O8 > O9 > O16 for the listed pages (all admitted pages when
    ``listing`` is None), written once when ``persist``. The reports need
    only the fact rows (keep='facts'); keep='all' gives the whole table.

    The result holds one copy per url, chosen before the parse, as the
    url-keyed programs read one page per url.
    """
    els = extract_elements(listed_pages(pages, listing), cfg, keep=keep)
    return materialize(els, "elements") if persist else els


class FactStore:
    """Per-page fact tables of one crawl, the inputs of every report:

    * ``elements``: the element table (one parsed copy per url);
    * ``layout_counts``: (url, block, variant, layout, n) (O18-O23);
    * ``block_counts``: (url, block, n) (O13, O25);
    * ``links``: (url, hrefs) for every page read, in document order, and the link
      facts that are found by comparing them (``operators.links.link_facts``).

    Each table depends on one page only, so all reports over a crawl are
    joins of these tables with their listings. Tables not written are
    derived from ``elements`` when first used.
    """

    def __init__(self, elements: DataFrame, cfg: AuditConfig = DEFAULT, layout_counts=None,
                 block_counts=None, links=None):
        self.elements = elements
        self.cfg = cfg
        self._layout_counts = layout_counts
        self._block_counts = block_counts
        self._links = links

    @property
    def layout_counts(self) -> DataFrame:
        if self._layout_counts is None:
            from ..operators.blocks import block_variant_layout_counts
            self._layout_counts = block_variant_layout_counts(self.elements, self.cfg)
        return self._layout_counts

    @property
    def block_counts(self) -> DataFrame:
        if self._block_counts is None:
            from ..operators.blocks import block_counts
            self._block_counts = block_counts(self.elements, self.cfg.vocab)
        return self._block_counts

    @property
    def links(self) -> DataFrame:
        if self._links is None:
            from ..operators.links import link_facts, read_page_links
            self._links = link_facts(read_page_links(self.elements), self.cfg)
        return self._links

    @classmethod
    def build(cls, pages: DataFrame, listing: DataFrame | None = None,
              cfg: AuditConfig = DEFAULT) -> "FactStore":
        """Parse once and write every fact table once (shared checkpoint dir)."""
        lazy = cls(parsed_elements(pages, listing, cfg), cfg)
        # the three tables depend on the element table only: write them as
        # concurrent jobs so their stages share the executors
        from concurrent.futures import ThreadPoolExecutor
        jobs = {"layout_counts": (lazy.layout_counts, "layout-counts"),
                "block_counts": (lazy.block_counts, "block-counts"),
                "links": (lazy.links, "page-links")}
        with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            done = {k: pool.submit(copy_context().run, materialize, df, name) for k, (df, name) in jobs.items()}
            tables = {k: f.result() for k, f in done.items()}
        return cls(lazy.elements, cfg, **tables)
