"""Incremental audits of newly fetched pages with Structured Streaming.

The audited programs run in batch only; every per-page operator here is
stateless (one page in, its facts out), so the same plans run on a
streaming DataFrame of pages as new crawl files land:

* ``media_stream``: O8 > O9 > O33 as a pure native streaming plan.
* ``element_stream``: O8 > O9 > O16, the element table as a stream.
* ``start_block_audit``: per micro-batch, the batch block plan (O16-O23)
  over the batch's pages, written as one Parquet folder per batch id, so a
  re-run batch overwrites its own output (idempotent under retries).

No streaming state is kept; a page's facts depend on that page alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import functions as fn
from ..config import DEFAULT, AuditConfig
from ..operators import blocks
from ..operators.elements import admit_pages, extract_elements, page_bodies

PAGES_SCHEMA = "url string, status int, html string"


def page_stream(spark: SparkSession, path: str, schema: str = PAGES_SCHEMA,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Pages (url, status, html) from Parquet files arriving under ``path``."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def media_stream(pages: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(url, template_ids) for each read page with media ids."""
    ids = fn.media_ids(fn.join_lines("html"), cfg.media_prefix, cfg.media_suffixes)
    return (admit_pages(pages).select("url", ids.alias("ids")).where(F.size("ids") > 0)
            .select("url", fn.show_set("ids").alias("template_ids")))


def element_stream(pages: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The element table of each read page, as a stream."""
    return extract_elements(page_bodies(pages), cfg)


def start_block_audit(pages: DataFrame, out_path: str, checkpoint: str,
                      cfg: AuditConfig = DEFAULT, available_now: bool = True) -> StreamingQuery:
    """Per micro-batch: (url, block, variant, layout, n) for the batch's
    pages, written to ``out_path/batch_id=<id>``."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch's element table is read by several sub-plans: write it once
        from ..plans.store import parsed_elements, temporary_tables
        with temporary_tables(batch.sparkSession):
            els = parsed_elements(batch, None, cfg)
            (blocks.block_variant_layout_counts(els, cfg)
             .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}"))

    w = pages.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
