"""Pages and elements: admission (O8, O45), line joining (O9) and the
element extraction (O16) with its two element filters (O11, O12).

The element table is the one intermediate every report reads:

    page_key, url, pre, end, parent_pre, parent_end, depth, tag,
    attrs map<string,string>, own_text, n_children, chain_labels array<string>

``page_key`` identifies one fetched page row; ``pre..end`` is the pre-order
interval of the element's subtree, so subtree and scope questions become
interval arithmetic on native columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..config import DEFAULT, REDIRECT_STATUSES, AuditConfig
from ..session import ship_package
from .htmltree import parse_elements

ELEMENT_SCHEMA = T.StructType([
    T.StructField("page_key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("parent_pre", T.IntegerType()),
    T.StructField("parent_end", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("own_text", T.StringType()),
    T.StructField("n_children", T.IntegerType()),
    T.StructField("chain_labels", T.ArrayType(T.StringType())),
])

_ARROW_SCHEMA = pa.schema([
    ("page_key", pa.string()), ("url", pa.string()), ("pre", pa.int32()), ("end", pa.int32()),
    ("parent_pre", pa.int32()), ("parent_end", pa.int32()), ("depth", pa.int32()),
    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("own_text", pa.string()), ("n_children", pa.int32()),
    ("chain_labels", pa.list_(pa.string())),
])


def is_redirect(status) -> F.Column:
    return F.col(status).isin(*REDIRECT_STATUSES) if isinstance(status, str) else status.isin(*REDIRECT_STATUSES)


def reject_reason(has_markup=None) -> F.Column:
    """Why a page is not read, null for one that is: every page is in exactly one of
    ``admit_pages`` and ``rejects``, whatever is null."""
    status = F.col("status")
    reason = (F.when(status.isNull(), F.lit("no_status"))
              .when(is_redirect("status"), F.lit("redirect"))
              .when(status >= 400, F.lit("http_error")))
    return reason if has_markup is None else reason.when(~has_markup, F.lit("no_markup"))


def _reason_of(pages: DataFrame) -> F.Column:
    return reject_reason(F.col("html").isNotNull() if "html" in pages.columns else None)


def admit_pages(pages: DataFrame) -> DataFrame:
    """Pages whose body is read: a status that is no 301/302/303 redirect and no
    error (>= 400), and markup. 307/308 are read."""
    # plain conditions, which reach the scan: the pages without a ``reject_reason``
    read = ~is_redirect("status") & (F.col("status") < 400)
    return pages.where(read & F.col("html").isNotNull() if "html" in pages.columns else read)


def rejects(pages: DataFrame) -> DataFrame:
    """Pages that are not read, with the reason: the complement of O8."""
    return pages.select("url", "status", _reason_of(pages).alias("reason")).where(F.col("reason").isNotNull())


def reconciled(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """O45 over a whole run: (url, times, status, reason) for every listed url, so
    that listed = read + rejected. ``reason`` is null for a url that was read, and
    ``not_fetched`` for one that no page has; ``times`` is how often it is listed.

    Both sides have one narrow row per url before they meet: listings are counted,
    and no markup is joined.
    """
    listed = listing.groupBy("url").agg(F.count(F.lit(1)).alias("times"))
    chosen = one_page_per_url(pages)
    found = chosen.select(F.col("url").alias("_url"), "status", _reason_of(chosen).alias("reason"), F.lit(True).alias("_found"))
    return listed.join(found, F.col("url").eqNullSafe(F.col("_url")), "left").select(
        "url", "times", "status", F.when(F.col("_found").isNull(), F.lit("not_fetched")).otherwise(F.col("reason")).alias("reason"))


def _extract_batches(labels, keep_terms=None):
    labels = tuple(labels)

    def run(batches):
        for rb in batches:
            keys = rb.column(0).to_pylist()
            urls = rb.column(1).to_pylist()
            htmls = rb.column(2).to_pylist()
            cols = [[] for _ in range(12)]
            for key, url, html in zip(keys, urls, htmls):
                for e in parse_elements(html or "", labels, keep_terms):
                    cols[0].append(key)
                    cols[1].append(url)
                    for k in range(10):
                        v = e[k]
                        if k == 6:
                            v = [x for x in v.items() if keep_terms is None or x[0].startswith(("class", "href"))]
                        cols[k + 2].append(v)
                if len(cols[0]) >= 50000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(cols, _ARROW_SCHEMA)],
                        schema=_ARROW_SCHEMA)
                    cols = [[] for _ in range(12)]
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, _ARROW_SCHEMA)],
                    schema=_ARROW_SCHEMA)
    return run


def extract_elements(pages: DataFrame, cfg: AuditConfig = DEFAULT,
                     partitions: int | None = None, keep: str = "all") -> DataFrame:
    """One row per element of each page (url, html).

    keep='all' emits every element. keep='facts' emits only the rows the
    reports read (the root, elements with ``class...``/``href...``
    attributes, and elements whose own text holds a section term); numbering
    and intervals are the same, and the store shrinks to a fraction of the
    markup (paragraph text is not carried).

    Callers pass admitted pages (O8) with joined lines (O9): filters do not
    push through the Python step, so they must come first. The parse runs
    where the pages are: each page is one row, so no shuffle of markup is
    needed. ``partitions`` spreads the pages first, for an input of few large
    files; it doesn't change any fact.

    ``page_key`` is a 128-bit hash of (url, markup), so a page has the same key
    in every run; per-page windows and groups use it. Callers pass one copy per url
    (``one_page_per_url``).
    """
    spark = pages.sparkSession
    ship_package(spark)
    src = pages.select(F.md5(F.concat_ws("\n", "url", "html")).alias("page_key"), "url", "html")
    if partitions and not pages.isStreaming:
        src = src.repartition(partitions, "page_key")
    terms = None if keep == "all" else tuple(cfg.desktop_terms + cfg.mobile_terms)
    return src.mapInArrow(_extract_batches(cfg.labels, terms), ELEMENT_SCHEMA)


def one_page_per_url(pages: DataFrame) -> DataFrame:
    """One fetched copy per url, chosen by data alone: the latest by column
    ``fetch_seq`` when the table has one, then a page that is read before a
    redirect before an error before one without status or markup, then the largest
    (status, hash of the markup).

    Every report reads its pages through this, so all agree on the copy however
    the table is partitioned. The urls with several copies are found from the
    url column alone and stored; where they are few, Spark broadcasts them and no
    markup moves.
    """
    from ..plans.store import materialize
    several = materialize(pages.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                          .select(F.col("url").alias("_url")), "urls-with-copies")
    same = F.col("url").eqNullSafe(F.col("_url"))
    readable = F.when(_reason_of(pages).isNull(), 3).when(is_redirect("status"), 2).when(F.col("status") >= 400, 1).otherwise(0)
    seq = [F.col("fetch_seq")] if "fetch_seq" in pages.columns else []
    copies = pages.join(several, same, "left_semi").withColumn(
        "_rank", F.struct(*seq, readable.alias("readable"), "status", F.xxhash64("html").alias("hash")))
    best = copies.groupBy(F.col("url").alias("_url")).agg(F.max("_rank").alias("_best"))
    # what is left of a url are equal pages: any of them
    chosen = (copies.join(best, same).where(F.col("_rank") == F.col("_best"))
              .drop("_url", "_best", "_rank").dropDuplicates(["url"]))
    return pages.join(several, same, "left_anti").unionByName(chosen)


def page_bodies(pages: DataFrame) -> DataFrame:
    """Admitted pages with joined lines: (url, html)."""
    return admit_pages(pages).select("url", fn.join_lines("html").alias("html"))


def class_elements(elements: DataFrame) -> DataFrame:
    """O11 + O17: elements with an attribute named ``class...``, with their
    class tokens (an element with only ``classid`` has no tokens)."""
    return (elements.where(fn.has_attr_prefix("attrs", "class"))
            .withColumn("classes", fn.class_tokens(F.col("attrs")["class"])))


def href_elements(elements: DataFrame) -> DataFrame:
    """Elements of any tag with an attribute named ``href...``; the
    value is the raw ``href`` ('' when only e.g. ``hreflang`` is present)."""
    return (elements.where(fn.has_attr_prefix("attrs", "href"))
            .select("page_key", "url", "pre", F.coalesce(F.col("attrs")["href"], F.lit("")).alias("href")))
