"""The test fixture: site tables derived from the driver's ``pages`` table.

``site_pages`` is one SQL text run by both Spark and DuckDB (FIXTURES.md
section 3). The documents the audit reads (workbook cells, query-index JSON,
sitemap XML) are built from it with Spark functions; the DuckDB oracles read
``pages`` directly, so each round trip is checked end to end.

All documents are built in bounded parts (at most ``PART_SIZE`` pages per
part), never as one document per family: no group here grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig

# Pages per index/sitemap document part.
PART_SIZE = 64

SITE_PAGES_SQL = """
select page_id,
  concat('https://www.example.com/',
         case page_id % 4 when 0 then 'express/' when 1 then 'br/express/' when 2 then 'de/express/' else 'p' end,
         cast(page_id as varchar(20))) as url,
  case when page_id % 10 = 7 then 302 when page_id % 50 = 9 then 404 else 200 end as status,
  replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html,
    'href="/d', 'href="https://www.example.com/d'),
    'href="/t', 'href="http://blog.example.com/t'),
    'href="/i', 'href="HTTPS://Cdn.Other.org:8080/i'),
    'href="/l', 'href="mailto:l'),
    'href="/w', 'href="tel:w'),
    '<nav>', '<nav class="seo-nav">'),
    '<ul>', '<ul class="list compact list">'),
    '<article>', '<article class="dark columns marquee wide">'),
    '<div class="ad">',
    case page_id % 5
      when 0 then '<div class="banner"><div>Desktop</div>'
      when 1 then '<div class="banner big"><div><span>MOBILE</span></div>'
      when 2 then '<div class="cards"><p>x</p><div><i>desktop</i></div><div>mobile</div>'
      when 3 then '<div class="steps"><div>Mobile</div><div>desktop</div>'
      else '<div class="ad" classid="z"><img src="media_ab.jpg"><img src="media_cd.png">' end),
    '<footer>',
    case page_id % 3
      when 0 then '<div class="section-metadata"><div>style</div><div>mobile</div></div><footer>'
      when 1 then '<footer>'
      else '<div class="section-metadata"><div>desktop</div><div>Mobile</div></div><div class="Section-Metadata"><div>Desktop x</div></div><footer>' end) as html
from pages
"""

# Workbook cells: two sheets, one URL per row, row 0 is the header, some
# cells blank; URLs with page_id % 17 = 5 are listed a second time on the
# other sheet (a repeated URL must count twice where the programs do).
SHEET_CELLS_SQL = """
select concat('sheet', cast(page_id % 2 as varchar(2))) as sheet,
       cast(floor(page_id / 2) as bigint) as row_num,
       0 as col_num,
       case when page_id % 11 = 3 then '  ' else url end as value
from site_pages
union all
select concat('sheet', cast((page_id + 1) % 2 as varchar(2))) as sheet,
       cast(page_id as bigint) as row_num,
       1 as col_num,
       url as value
from site_pages where page_id % 17 = 5
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(page_id, url, status, html) of the fixture site."""
    pages = read_table(spark, sf_dir, "pages")
    return spark.sql(SITE_PAGES_SQL.replace("from pages", "from {pages}"), pages=pages)


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet_cells(sheet, row_num, col_num, value) as read from a workbook."""
    sp = site_pages(spark, sf_dir).select("page_id", "url")
    return spark.sql(SHEET_CELLS_SQL.replace("from site_pages", "from {sp}"), sp=sp)


def _family_of(page_id, cfg: AuditConfig):
    """Index URL each fixture page is listed under.

    Family and locale are picked by ``page_id % 3``: express root, express
    /br, blog /de.
    """
    fams = cfg.families
    urls = [
        fams[0].template.format(root=cfg.site_root, locale=fams[0].locales[0]),
        fams[0].template.format(root=cfg.site_root, locale=fams[0].locales[1]),
        fams[1].template.format(root=cfg.site_root, locale=fams[1].locales[1]),
    ]
    m = page_id % 3
    return F.when(m == 0, F.lit(urls[0])).when(m == 1, F.lit(urls[1])).otherwise(F.lit(urls[2]))


def index_documents(spark: SparkSession, sf_dir: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Fetched query-index documents: (index_url, part, status, body).

    Each part holds the entries of at most PART_SIZE pages, in page order.
    Part 1 of the blog family answers 500, so its entries are not read (O7).
    Part -1 of each family has a blank body, part -2 JSON without ``data``, part
    -3 an entry without a path and one with a bad date. The /fr index is empty.
    """
    sp = site_pages(spark, sf_dir).select("page_id", "url")
    entries = sp.select(
        _family_of(F.col("page_id"), cfg).alias("index_url"),
        (F.col("page_id") / F.lit(3 * PART_SIZE)).cast("int").alias("part"),
        F.struct(
            F.col("page_id"),
            F.expr(f"substr(url, {len(cfg.site_root) + 1})").alias("path"),
            (F.lit(1700000000) + F.col("page_id")).cast("string").alias("lastModified"),
        ).alias("entry"),
    )
    docs = (entries.groupBy("index_url", "part")
            .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
            .select(
                "index_url", "part",
                F.when((F.col("part") == 1) & F.col("index_url").contains("/blog/"), F.lit(500))
                .otherwise(F.lit(200)).alias("status"),
                F.to_json(F.struct(F.transform("entries", lambda e: F.struct(
                    e["path"].alias("path"), e["lastModified"].alias("lastModified"))).alias("data")))
                .alias("body")))
    first = docs.where("part = 0")
    blank = first.select("index_url", F.lit(-1).alias("part"), F.lit(200).alias("status"),
                         F.lit("  ").alias("body"))
    nodata = first.select("index_url", F.lit(-2).alias("part"), F.lit(200).alias("status"),
                          F.lit('{"items":[]}').alias("body"))
    bad = first.select("index_url", F.lit(-3).alias("part"), F.lit(200).alias("status"),
                       F.lit('{"data":[{"lastModified":"5"},{"path":"/express/x","lastModified":"x1"}]}').alias("body"))
    empty = spark.range(1).select(
        F.lit(cfg.families[0].template.format(root=cfg.site_root, locale="/fr")).alias("index_url"),
        F.lit(0).alias("part"), F.lit(200).alias("status"), F.lit('{"data":[]}').alias("body"))
    return docs.unionByName(blank).unionByName(nodata).unionByName(bad).unionByName(empty)


def sitemap_documents(spark: SparkSession, sf_dir: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Fetched sitemap documents: (doc_url, status, body).

    For each part p (PART_SIZE pages per family), child sitemaps
    ``/sitemap-<page_id % 3>-<p>.xml`` list ``<url><loc>`` with a
    ``<lastmod>`` on even page ids; ``&`` is escaped. Pages with
    ``page_id % 7 = 0`` are listed again in ``/sitemap-extra-<p>.xml`` with a
    later date. The sitemap index ``/sitemap-index-<p>.xml`` lists the
    children of part p, the extra one after the family ones (so map mode
    keeps its date), then ``/sitemap-broken-<p>.xml`` (not parseable) and
    ``/sitemap-gone-<p>.xml`` (404).
    """
    sp = site_pages(spark, sf_dir).select("page_id", "url")
    root = cfg.site_root
    part = (F.col("page_id") / F.lit(3 * PART_SIZE)).cast("int")

    def entries(df, fam_expr, date_expr, rank):
        return df.select(
            part.alias("part"), F.lit(rank).alias("rank"),
            F.concat(F.lit(root + "/sitemap-"), fam_expr, F.lit("-"), part.cast("string"),
                     F.lit(".xml")).alias("doc_url"),
            F.struct(F.col("page_id"), F.concat(
                F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc>"),
                F.when(F.col("page_id") % 2 == 0,
                       F.concat(F.lit("<lastmod>"), date_expr, F.lit("</lastmod>"))).otherwise(F.lit("")),
                F.lit("</url>")).alias("item")).alias("entry"),
        )

    date1 = F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("page_id")), "yyyy-MM-dd")
    date2 = F.date_format(F.timestamp_seconds(F.lit(1800000000) + F.col("page_id")), "yyyy-MM-dd")
    items = entries(sp, (F.col("page_id") % 3).cast("string"), date1, 0).unionByName(
        entries(sp.where("page_id % 7 = 0"), F.lit("extra"), date2, 1))
    children = (items.groupBy("part", "rank", "doc_url")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list("entry")),
                                              lambda e: e["item"]), "").alias("items"))
                .select("part", "rank", "doc_url", F.concat(
                    F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset>'), F.col("items"),
                    F.lit("</urlset>")).alias("body")))
    # per part, a child that does not parse and a child that answers 404,
    # listed last: reading skips them, the rejects report lists them
    parts = items.select("part").distinct()
    bad = (parts.select("part", F.lit(2).alias("rank"),
                        F.concat(F.lit(root + "/sitemap-broken-"), F.col("part").cast("string"),
                                 F.lit(".xml")).alias("doc_url"),
                        F.lit("<urlset><url><loc>").alias("body"))
           .unionByName(parts.select("part", F.lit(3).alias("rank"),
                                     F.concat(F.lit(root + "/sitemap-gone-"), F.col("part").cast("string"),
                                              F.lit(".xml")).alias("doc_url"),
                                     F.lit("<urlset></urlset>").alias("body"))))
    children = children.unionByName(bad)
    index = (children.groupBy("part")
             .agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("rank", "doc_url"))),
                 lambda s: F.concat(F.lit("<sitemap><loc>"), s["doc_url"], F.lit("</loc></sitemap>"))),
                 "").alias("items"))
             .select(F.concat(F.lit(root + "/sitemap-index-"), F.col("part").cast("string"),
                              F.lit(".xml")).alias("doc_url"),
                     F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><sitemapindex>'),
                              F.col("items"), F.lit("</sitemapindex>")).alias("body")))
    status = F.when(F.col("rank") == 3, F.lit(404)).otherwise(F.lit(200))
    return (children.select("doc_url", status.alias("status"), "body")
            .unionByName(index.select("doc_url", F.lit(200).alias("status"), "body")))


def sitemap_index_urls(spark: SparkSession, sf_dir: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The sitemap index URLs a run starts from: (index_url, index_seq)."""
    docs = sitemap_documents(spark, sf_dir, cfg)
    return (docs.where(F.col("doc_url").rlike(r"/sitemap-index-[0-9]+\.xml$"))
            .select(F.col("doc_url").alias("index_url"),
                    F.regexp_extract("doc_url", r"-([0-9]+)\.xml$", 1).cast("long").alias("index_seq")))
