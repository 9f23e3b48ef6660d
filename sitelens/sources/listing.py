"""URL sources: workbook cells (O1), query indexes (O2, O3, O7) and
sitemaps (O4, O5, O6).

Every source yields a *listing*: one row per time a url is listed, with the
columns that say where it came from and an explicit order (documents have
no row order in Spark, so positions are carried as columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import DEFAULT, INDEX_OK_STATUS, AuditConfig

QUERY_INDEX_SCHEMA = "data array<struct<path: string, lastModified: string>>"
SITEMAP_INDEX_SCHEMA = "sitemap array<struct<loc: array<string>>>"
URLSET_SCHEMA = "url array<struct<loc: array<string>, lastmod: array<string>>>"
_XML_OPTS = {"ignoreSurroundingSpaces": "false"}


# -- O1 ---------------------------------------------------------------------
def cells_to_urls(cells: DataFrame) -> DataFrame:
    """O1: every non-blank cell of every sheet below the header row (row 0)
    is one listed url: (sheet, row_num, col_num, url, page_seq)."""
    return (cells.where((F.col("row_num") != 0) & F.col("value").rlike(r"\S"))
            .select("sheet", "row_num", "col_num", F.col("value").alias("url"),
                    F.xxhash64("sheet", "row_num", "col_num").alias("page_seq")))


# -- O2 / O7 / O3 -------------------------------------------------------------
def expand_index_urls(spark: SparkSession, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O2: every family template formatted with each of its locales:
    (family, family_seq, locale, locale_seq, index_url). A url listed twice
    is kept once (its first place)."""
    rows = []
    for fi, fam in enumerate(cfg.families):
        for li, loc in enumerate(fam.locales):
            rows.append((fam.name, fi, loc, li, fam.template.format(root=cfg.site_root, locale=loc)))
    # literal rows, planned in the JVM (no Python data source to scan)
    lit_rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(fi).alias("family_seq"),
                                  F.lit(lo).alias("locale"), F.lit(li).alias("locale_seq"),
                                  F.lit(u).alias("index_url")) for f, fi, lo, li, u in rows])
    df = spark.range(1).select(F.inline(lit_rows))
    first = F.min(F.struct("family_seq", "locale_seq", "family", "locale"))
    return (df.groupBy("index_url").agg(first.alias("f"))
            .select(F.col("f.family"), F.col("f.family_seq"), F.col("f.locale"),
                    F.col("f.locale_seq"), "index_url"))


def admit_index_docs(docs: DataFrame, status: str = "status", body: str = "body",
                     require_text: bool = True) -> DataFrame:
    """index/sitemap documents count only with status 200 and, for
    JSON, a body that is not blank."""
    cond = F.col(status) == INDEX_OK_STATUS
    if require_text:
        cond = cond & F.col(body).rlike(r"\S")
    return docs.where(cond)


def index_doc_rejects(spark: SparkSession, docs: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O45 for index documents: (index_url, part, status, reason) of each
    configured index document that yields no entries: a status other than
    200, a blank body, or JSON without a ``data`` array."""
    urls = expand_index_urls(spark, cfg).select("index_url")
    j = F.from_json("body", QUERY_INDEX_SCHEMA, {"mode": "PERMISSIVE"})
    reason = (F.when(F.col("status") != INDEX_OK_STATUS, F.lit("http_status"))
              .when(~F.col("body").rlike(r"\S"), F.lit("blank"))
              .when(j.isNull() | j["data"].isNull(), F.lit("no_data")))
    return (docs.join(F.broadcast(urls), "index_url")
            .select("index_url", "part", "status", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def _index_entries(docs: DataFrame) -> DataFrame:
    """(index_url, part, pos, path, last_modified_raw, reason) of every entry;
    ``reason`` is null for a readable one."""
    parsed = docs.select("index_url", "part",
                         F.from_json("body", QUERY_INDEX_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))
    entry = parsed.select("index_url", "part", F.posexplode("j.data").alias("pos", "e")).select(
        "index_url", "part", "pos", F.col("e.path").alias("path"), F.col("e.lastModified").alias("last_modified_raw"))
    date = F.col("last_modified_raw")
    return entry.withColumn("reason", F.when(F.col("path").isNull(), F.lit("no_path")).when(
        date.isNotNull() & date.try_cast("bigint").isNull(), F.lit("bad_date")))


def read_query_index(docs: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O3: parse each admitted document and explode ``data``:
    (index_url, part, pos, url, last_modified_raw). A document without
    ``data`` or not JSON gives no rows; entries without a path or with a date
    that is no number are rejected (``index_entry_rejects``)."""
    return (_index_entries(docs).where("reason is null")
            .select("index_url", "part", "pos",
                    F.concat(F.lit(cfg.site_root), F.col("path")).alias("url"), "last_modified_raw"))


def index_entry_rejects(spark: SparkSession, docs: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O45 for the entries of admitted index documents: (index_url, part, pos,
    reason) of each entry that is not read."""
    urls = expand_index_urls(spark, cfg).select("index_url")
    admitted = admit_index_docs(docs).join(F.broadcast(urls), "index_url")
    return _index_entries(admitted).where("reason is not null").select("index_url", "part", "pos", "reason")


def query_index_listing(spark: SparkSession, docs: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O2 > O7 > O3: the pages listed by the configured query indexes, with
    their family and order: (family, family_seq, locale_seq, index_url,
    part, pos, url, last_modified_raw, page_seq)."""
    urls = expand_index_urls(spark, cfg)
    # the index url list is bounded by the configuration: broadcast it
    admitted = admit_index_docs(docs).join(F.broadcast(urls), "index_url")
    entries = read_query_index(admitted.select("index_url", "part", "body"), cfg)
    keyed = entries.join(F.broadcast(urls.select("index_url", "family", "family_seq", "locale_seq")),
                         "index_url")
    return keyed.withColumn("page_seq", F.xxhash64("index_url", "part", "pos"))


def index_dates(listing: DataFrame) -> DataFrame:
    """O27 + O42 + O10: url -> formatted last-modified date, the entry read
    last (family, locale, part, position order) winning."""
    from ..operators.pages import last_wins
    dated = listing.select("url", "family_seq", "locale_seq", "part", "pos",
                           fn.format_epoch("last_modified_raw").alias("last_modified"))
    return last_wins(dated, ["url"], ["family_seq", "locale_seq", "part", "pos"], ["last_modified"])


# -- O4 / O5 / O6 -------------------------------------------------------------
# Documents are parsed where they lie; only their small rows are joined, so no
# document body is shuffled.
def read_sitemap_index(docs: DataFrame) -> DataFrame:
    """``sitemap`` elements of each admitted sitemap-index document ->
    child sitemap urls: (index_url, child_pos, sitemap_url)."""
    parsed = admit_index_docs(docs, require_text=False).select(
        "index_url", F.from_xml("body", SITEMAP_INDEX_SCHEMA, _XML_OPTS).alias("x"))
    return (parsed.select("index_url", F.posexplode("x.sitemap").alias("child_pos", "s"))
            .select("index_url", "child_pos", F.posexplode("s.loc").alias("k", "sitemap_url"))
            .select("index_url", "child_pos", "sitemap_url"))


def read_sitemap_urls(docs: DataFrame, mode: str = "map") -> DataFrame:
    """``url`` elements -> (doc_url, pos, loc, lastmod).

    mode='map': the last ``loc`` and last ``lastmod`` of an element, a
    missing date as ''. mode='list': every ``loc`` is a row, no date; ``pos`` is
    then the struct (element, place in the element).
    """
    parsed = admit_index_docs(docs, require_text=False).select(
        "doc_url", F.from_xml("body", URLSET_SCHEMA, _XML_OPTS).alias("x"))
    items = parsed.select("doc_url", F.posexplode("x.url").alias("pos", "u"))
    if mode == "map":
        return (items.where(F.size("u.loc") > 0)
                .select("doc_url", "pos",
                        F.try_element_at("u.loc", F.lit(-1)).alias("loc"),
                        F.coalesce(F.try_element_at("u.lastmod", F.lit(-1)), F.lit("")).alias("lastmod")))
    return (items.select("doc_url", "pos", F.posexplode("u.loc").alias("k", "loc"))
            .select("doc_url", F.struct("pos", "k").alias("pos"), "loc",
                    F.lit(None).cast("string").alias("lastmod")))


def read_sitemap_files(spark: SparkSession, folder: str, docs: DataFrame, mode: str = "map") -> DataFrame:
    """O5 for documents that are stored as files, however large: the same rows as
    ``read_sitemap_urls``, but ``pos`` is (place of the split in the file, place in
    the split, [place in the element]), which orders alike.

    ``docs`` is (doc_url, status, file): the files lie under ``folder``, each in a
    folder named ``file=...`` (as a partitioned writer leaves them) or directly. The
    text source cuts the files after each ``url`` element, so one document is read
    by as many tasks as its size needs; every element is parsed on its own. A
    document of which an element, or the end, isn't well formed gives no rows, as if
    it had been parsed whole.
    """
    records = spark.read.option("lineSep", "</url>").text(folder)
    name = F.col("file") if "file" in records.columns else F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    records = records.select(
        name.alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), "value")
    # what precedes an element in its record: the document's head, comments
    inner = F.regexp_extract("value", r"(?is)^.*?(<url[\s>].*)$", 1)
    unprefixed = F.regexp_replace(inner, r"<(/?)([A-Za-z_][\w.-]*):", "<$1$2_")
    # a record that runs to the document's end tag is the last of its file; it holds
    # no element, or elements in other letter case, which are parsed together
    end_tag = r"(?is)</urlset\s*>(?:\s|<!--.*?-->)*$"
    is_end = F.rlike("value", F.lit(end_tag))
    whole = F.concat(F.lit("<urlset>"), unprefixed, F.lit("</url></urlset>"))
    rest = F.concat(F.lit("<urlset>"), F.regexp_replace(unprefixed, end_tag, "</urlset>"))
    parsed = records.select(
        "file", "split", "row", is_end.alias("is_end"), (inner != "").alias("holds"),
        F.when(inner != "", F.from_xml(F.when(is_end, rest).otherwise(whole), URLSET_SCHEMA, _XML_OPTS)).alias("x"))
    bad = parsed.where("x.url is null and (holds or not is_end)").select("file").distinct()
    admitted = admit_index_docs(docs, require_text=False).select("doc_url", "file")
    items = (parsed.where("x.url is not null").join(bad, "file", "left_anti").join(admitted, "file")
             .select("doc_url", "split", "row", F.posexplode("x.url").alias("k", "u")))
    at = F.struct("split", "row", "k")
    if mode == "map":
        return items.where(F.size("u.loc") > 0).select(
            "doc_url", at.alias("pos"), F.try_element_at("u.loc", F.lit(-1)).alias("loc"),
            F.coalesce(F.try_element_at("u.lastmod", F.lit(-1)), F.lit("")).alias("lastmod"))
    return (items.select("doc_url", at.alias("at"), F.posexplode("u.loc").alias("j", "loc"))
            .select("doc_url", F.struct("at", "j").alias("pos"), "loc", F.lit(None).cast("string").alias("lastmod")))


def sitemap_doc_rejects(index_urls: DataFrame, docs: DataFrame) -> DataFrame:
    """O45 for sitemaps: (doc_url, level, status, reason) of each listed
    sitemap-index or child document that yields no entries: not fetched, a
    status other than 200, or no ``sitemap``/``url`` element (malformed XML
    included)."""
    state = docs.select(
        "doc_url", "status",
        F.from_xml("body", SITEMAP_INDEX_SCHEMA, _XML_OPTS)["sitemap"].isNotNull().alias("index"),
        F.from_xml("body", URLSET_SCHEMA, _XML_OPTS)["url"].isNotNull().alias("child"))

    def rejects(listed: DataFrame, level: str) -> DataFrame:
        reason = (F.when(F.col("status").isNull(), F.lit("not_fetched"))
                  .when(F.col("status") != INDEX_OK_STATUS, F.lit("http_status"))
                  .when(~F.col(level), F.lit("no_entries")))
        return (listed.join(state, "doc_url", "left")
                .select("doc_url", F.lit(level).alias("level"), "status", reason.alias("reason"))
                .where(F.col("reason").isNotNull()))
    idx = index_urls.select(F.col("index_url").alias("doc_url")).distinct()
    children = read_sitemap_index(docs.withColumnRenamed("doc_url", "index_url")).withColumnRenamed("index_url", "doc_url")
    children = children.join(idx, "doc_url", "left_semi").select(F.col("sitemap_url").alias("doc_url")).distinct()
    return rejects(idx, "index").unionByName(rejects(children, "child"))


def sitemap_pages(index_urls: DataFrame, docs: DataFrame, mode: str = "map") -> DataFrame:
    """Sitemap index -> child sitemaps -> pages.

    ``index_urls`` is (index_url, index_seq); ``docs`` is the fetched
    documents (doc_url, status, body). mode='list': every listed page is a
    row (url, page_seq, index_seq, child_pos, pos), duplicates kept.
    mode='map': one row per url with the last date (O10), as (url, lastmod).
    """
    children = read_sitemap_index(docs.withColumnRenamed("doc_url", "index_url")).join(index_urls, "index_url")
    order = children.select(F.col("sitemap_url").alias("doc_url"), "index_seq", "child_pos")
    # each child document is parsed once, however often the indexes list it;
    # its pages are then repeated once per listing (list mode keeps repeats)
    listed = read_sitemap_urls(docs, mode).join(order, "doc_url").select(
        F.col("loc").alias("url"), "lastmod", "index_seq", "child_pos", "pos", "doc_url")
    if mode == "map":
        from ..operators.pages import last_wins
        return last_wins(listed, ["url"], ["index_seq", "child_pos", "pos"], ["lastmod"])
    return listed.withColumn("page_seq", F.xxhash64("doc_url", "index_seq", "child_pos", "pos"))
