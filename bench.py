"""Benchmark: the ten site-audit reports over the fixture site.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8) and prints one JSON line.

Inputs (the fixture pages and the documents derived from them: workbook
cells, query-index JSON, sitemap XML) are written once as Parquet before
timing, as a crawl would store them. An untimed warm-up runs every report once
over a 50-page slice (Python workers started, JVM code compiled). Then two
timed runs:

* ``pipeline``: every admitted page is parsed once and its per-page fact
  tables (elements, block layouts, block counts, link arrays) are written
  once (timed together as ``parse_store``); the ten reports are joins of
  these tables with their listings. This is the designed way to run all
  reports over one crawl; ``value`` is its total.
* ``standalone``: each report parses its own listed pages, as the registered
  queries do (``standalone_total``).

Every report is forced with the ``noop`` sink, so all rows are computed and
none is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitelens.config import DEFAULT as cfg  # noqa: E402
from sitelens.plans import reports as R  # noqa: E402
from sitelens.plans.store import FactStore  # noqa: E402
from sitelens.session import build_session  # noqa: E402
from sitelens.sources import fixture as fx  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="sitelens-bench-")
    spark = build_session(master=f"local[{cpus}]", app="sitelens-bench", shuffle_partitions=cpus,
                          extra={"spark.checkpoint.dir": f"{scratch}/ckpt"})

    # -- inputs, written once (untimed) ---------------------------------------
    def save(df, name):
        path = f"{scratch}/in/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    pages = save(fx.site_pages(spark, sf_dir), "pages")
    cells = save(fx.sheet_cells(spark, sf_dir), "cells")
    index_docs = save(fx.index_documents(spark, sf_dir, cfg), "index_docs")
    sitemap_docs = save(fx.sitemap_documents(spark, sf_dir, cfg), "sitemap_docs")
    sitemap_index = save(fx.sitemap_index_urls(spark, sf_dir, cfg), "sitemap_index")
    def reports(els):
        return {
            "report_block_matrix": lambda: R.report_block_matrix(cells, pages, cfg, els),
            "report_blocks_from_cells": lambda: R.report_blocks_from_cells(
                spark, cells, index_docs, pages, cfg, els),
            "report_blocks_from_index": lambda: R.report_blocks_from_index(
                spark, index_docs, pages, cfg, els),
            "report_blocks_from_sitemap": lambda: R.report_blocks_from_sitemap(
                sitemap_index, sitemap_docs, pages, cfg, els),
            "report_brand_links_all": lambda: R.report_brand_links_all(cells, pages, cfg, els),
            "report_brand_links": lambda: R.report_brand_links(spark, index_docs, pages, cfg, els),
            "report_links": lambda: R.report_links(sitemap_index, sitemap_docs, pages, cfg, els),
            "report_domains_from_index": lambda: R.report_domains_from_index(
                spark, index_docs, pages, cfg, els),
            "report_domains_from_sitemap": lambda: R.report_domains_from_sitemap(
                sitemap_index, sitemap_docs, pages, cfg, els),
            "report_media": lambda: R.report_media(cells, pages, cfg),
        }

    def run(make):
        t = time.time()
        make().write.format("noop").mode("overwrite").save()
        return round(time.time() - t, 3)

    # warm-up (untimed): start the Python workers and let the JVM compile the
    # plan shapes once, on a 50-page slice
    small = spark.read.parquet(f"{scratch}/in/pages").limit(50)
    small_store = FactStore.build(small, None, cfg)
    for make in reports(small_store).values():
        run(make)

    # -- pipeline: parse once, per-page facts once, ten reports over them -----
    t = time.time()
    store = FactStore.build(pages, None, cfg)  # every admitted page, written once
    parse_s = round(time.time() - t, 3)
    pipeline = {name: run(make) for name, make in reports(store).items()}

    # -- standalone: each report parses its own pages ---------------------------
    standalone = {name: run(make) for name, make in reports(None).items()}

    total = round(parse_s + sum(pipeline.values()), 3)
    out = {
        "metric": "site_audit_ten_reports",
        "value": total,
        "unit": "sec",
        "queries": {"parse_store": parse_s, **pipeline},
        "standalone": standalone,
        "standalone_total": round(sum(standalone.values()), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "pages": pages.count(),
    }
    print(json.dumps(out))
    spark.stop()



if __name__ == "__main__":
    main()
