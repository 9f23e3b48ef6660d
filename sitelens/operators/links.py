"""Link operators: O14, O15, O28-O32 applied per page, and the link reports
O36 brand_links_report, O37 link_rows, O38 page_domain_report,
O39 unique_domains.

Element tables hold one parsed copy per url (``plans.store``).
A page's links are gathered once into an array ordered by element position
(one group per page, bounded by that page's markup); everything after that
is higher-order array functions on the row, with no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import DEFAULT, AuditConfig
from .elements import href_elements


def read_page_links(elements: DataFrame) -> DataFrame:
    """(url, hrefs) for every page that was read, in document order; a page
    without links has an empty array. The per-page input of every link
    report (a fact store keeps it written)."""
    roots = elements.where(F.col("pre") == 0).select("page_key", "url")
    grouped = (href_elements(elements).groupBy("page_key")
               .agg(F.array_sort(F.collect_list(F.struct("pre", "href"))).alias("_l")))
    return (roots.join(grouped, "page_key", "left")
            .select("url", F.coalesce(F.transform("_l", lambda s: s["href"]),
                                      F.array().cast("array<string>")).alias("hrefs")))


def page_links(elements: DataFrame) -> DataFrame:
    """(url, hrefs array<string>) in document order, for pages with links."""
    return (href_elements(elements)
            .groupBy("page_key", "url")
            .agg(F.array_sort(F.collect_list(F.struct("pre", "href"))).alias("_l"))
            .select("url", F.transform("_l", lambda s: s["href"]).alias("hrefs")))


def link_facts(links: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Every per-page link fact, for (url, hrefs) rows:

    * ``links``: hrefs after O28;
    * ``brand_links``: brand hrefs (O14) after O28;
    * ``kept``: absolute hrefs (O15) after O28, ``origins`` theirs in order (O29),
      ``brand`` / ``non_brand`` the origins of each class after O28 (O30).

    A fact store writes this once, so each link is compared once and not by every
    report. Rows that are link facts already are given back as they are.
    """
    if "origins" in links.columns:
        return links
    step = links.select(
        "url", "hrefs",
        fn.substring_dedupe("hrefs").alias("links"),
        fn.substring_dedupe(F.filter("hrefs", lambda h: fn.is_brand(h, cfg.brand))).alias("brand_links"),
        fn.substring_dedupe(F.filter("hrefs", lambda h: fn.is_absolute_url(h, cfg.url_schemes))).alias("kept"))
    step = step.withColumn("origins", F.transform("kept", fn.url_origin))
    return step.select(
        "*",
        fn.substring_dedupe(F.filter("origins", lambda o: fn.is_brand(o, cfg.brand))).alias("brand"),
        fn.substring_dedupe(F.filter("origins", lambda o: ~fn.is_brand(o, cfg.brand))).alias("non_brand"))


def brand_links(links: DataFrame, cfg: AuditConfig = DEFAULT, dedupe: bool = False) -> DataFrame:
    """O14 (+ O28 when ``dedupe``): (url, links) brand links in order."""
    if dedupe:
        return link_facts(links, cfg).select("url", F.col("brand_links").alias("links"))
    return links.select("url", F.filter("hrefs", lambda h: fn.is_brand(h, cfg.brand)).alias("links"))


def brand_links_report(listing: DataFrame, elements: DataFrame | None, cfg: AuditConfig = DEFAULT,
                       dedupe: bool = False, links: DataFrame | None = None) -> DataFrame:
    """O36 (+ O10 by page, O31): one row per listed page that was read:
    (url, href_links); '' when the page has no brand link. ``listing`` is
    reduced to distinct urls first (the programs key their map by url)."""
    pages = listing.select("url").distinct()
    pl = links if links is not None else read_page_links(elements)
    bl = brand_links(pl, cfg, dedupe)
    return pages.join(bl, "url").select("url", fn.join_links("links").alias("href_links"))


# A url with more than this share of a listing, and more rows than this, is hot.
HOT_SHARE, HOT_ROWS = 1_000, 10_000


def hot_urls(listing: DataFrame, share: int = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """(url, salts) of the urls that make up more than 1 / ``share`` of the listing
    and over ``rows`` of its rows: at most ``share`` of them. ``salts`` parts of such
    a url are each about as large as the bound."""
    counts = listing.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    bound = F.greatest(F.lit(rows), F.expr(f"total div {share}"))
    return (counts.where(F.col("n") > rows).join(F.broadcast(total)).where(F.col("n") > bound)
            .select("url", F.ceil(F.col("n") / bound).cast("int").alias("salts")))


def salted_join(listing: DataFrame, facts: DataFrame, hot: DataFrame) -> DataFrame:
    """``listing`` joined to one row of ``facts`` per url. The rows of a hot url are
    dealt over its salts, and its facts repeated for each, so that no task gets more
    of them than of any other url, whatever the session's adaptive settings."""
    names = listing.columns
    hot = F.broadcast(hot.select("url", "salts"))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(*[F.col(c) for c in names], F.monotonically_increasing_id()), F.col("salts")).cast("int"))
    dealt = listing.join(hot, "url", "left").withColumn("_salt", salt).drop("salts")
    copies = facts.join(hot, "url", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, ["url", "_salt"]).drop("_salt")


def link_rows(listing: DataFrame, elements: DataFrame | None,
              links: DataFrame | None = None, cfg: AuditConfig = DEFAULT,
              share: int = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """O37 (+ O28, O32): one row per (listed page, link) after substring
    dedupe and the split on ``*`` runs. ``listing`` has (url, page_seq): a
    url listed twice gives its rows twice; pages without links are absent.

    Each listing entry meets its page's array of links, in a join salted for the
    urls that dominate the listing; the links are spread out after it.
    """
    from ..plans.store import materialize
    pl = link_facts(links if links is not None else page_links(elements), cfg).select("url", "links")
    listing = listing.select("url", "page_seq")
    hot = materialize(hot_urls(listing, share, rows), "hot-urls")
    return (salted_join(listing, pl, hot)
            .select("page_seq", "url", F.posexplode("links").alias("i", "raw"))
            .select("page_seq", "url", "i", F.posexplode(fn.split_star("raw")).alias("j", "link")))


def page_domain_report(listing: DataFrame, elements: DataFrame | None, cfg: AuditConfig = DEFAULT,
                       links: DataFrame | None = None) -> DataFrame:
    """O38 (+ O10 by page, O31): (url, href_links, brand_domains,
    non_brand_domains) for each distinct listed page that was read."""
    pages = listing.select("url").distinct()
    dl = link_facts(links if links is not None else read_page_links(elements), cfg)
    return (pages.join(dl.select("url", "kept", "brand", "non_brand"), "url")
            .select("url",
                    fn.join_links("kept").alias("href_links"),
                    fn.join_links("brand").alias("brand_domains"),
                    fn.join_links("non_brand").alias("non_brand_domains")))


def unique_domains(listing: DataFrame, elements: DataFrame | None, cfg: AuditConfig = DEFAULT,
                   by: str | None = "family", links: DataFrame | None = None) -> DataFrame:
    """Distinct origins of kept links, per ``by`` column of the listing
    (index family in the query-index run) or over the whole run (by=None). A page
    brings each of its origins once to the join."""
    dl = link_facts(links if links is not None else page_links(elements), cfg)
    origins = dl.select("url", F.explode(F.array_distinct("origins")).alias("origin"))
    if by is None:
        return origins.join(listing.select("url").distinct(), "url", "left_semi").select("origin").distinct()
    return (listing.select("url", by).distinct().join(origins, "url")
            .select(by, "origin").distinct())
