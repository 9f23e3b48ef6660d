"""Scale check: the fixture site replicated N times (urls made distinct),
plus a skewed listing in which one url is a third of all rows.

Prints timings and the plan facts that matter at scale: whether markup is
shuffled before the parse, which joins are broadcast, and how the hot url
is handled.

usage: python tools/scale_check.py [copies] [sf_dir]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sitelens.config import DEFAULT as cfg  # noqa: E402
from sitelens.operators import blocks, links  # noqa: E402
from sitelens.plans.store import parsed_elements  # noqa: E402
from sitelens.session import build_session  # noqa: E402
from sitelens.sources import fixture as fx  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main(argv):
    copies = int(argv[1]) if len(argv) > 1 else 10
    sf = argv[2] if len(argv) > 2 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="sitelens-scale-")
    spark = build_session("local[8]", extra={"spark.checkpoint.dir": f"{scratch}/ckpt"})
    base = fx.site_pages(spark, sf)
    reps = spark.range(copies).withColumnRenamed("id", "copy")
    # replicate: copy k gets urls under /c<k>/ so every page url is distinct
    pages = (base.join(F.broadcast(reps))
             .select(F.concat(F.lit(cfg.site_root + "/c"), F.col("copy").cast("string"),
                              F.expr(f"substr(url, {len(cfg.site_root) + 1})")).alias("url"),
                     "status", "html"))
    pages.write.mode("overwrite").parquet(f"{scratch}/pages")
    pages = spark.read.parquet(f"{scratch}/pages")
    n_pages = pages.count()
    urls = pages.select("url")
    hot = urls.orderBy("url").limit(1)
    n_hot = n_pages // 2  # the hot url is a third of the listing rows
    listing = urls.unionByName(hot.join(F.broadcast(spark.range(n_hot))).select("url"))
    listing.write.mode("overwrite").parquet(f"{scratch}/listing")
    listing = spark.read.parquet(f"{scratch}/listing").withColumn("page_seq", F.monotonically_increasing_id())
    print(f"pages={n_pages} listing_rows={listing.count()} hot_rows={n_hot + 1}", flush=True)

    t = time.time()
    els = parsed_elements(pages, listing, cfg)
    n_el = els.count()
    print(f"parse: {time.time() - t:.2f}s elements={n_el}", flush=True)

    for name, df in [
        ("block_report", blocks.block_variant_layout_report(listing, els, None, cfg)),
        ("block_matrix", blocks.block_matrix(listing, els, cfg.vocab)),
        ("link_rows", links.link_rows(listing, els)),
        ("domain_report", links.page_domain_report(listing, els, cfg)),
    ]:
        t = time.time()
        df.write.format("noop").mode("overwrite").save()
        p = plan_text(df)
        print(f"{name}: {time.time() - t:.2f}s broadcast_joins={p.count('BroadcastHashJoin')} "
              f"smj={p.count('SortMergeJoin')} exchanges={p.count('Exchange')}", flush=True)
    # the parse input: between the pages scan and the Python step there must be
    # no hash exchange (the listing side sits under a BroadcastExchange)
    src_plan = plan_text(parsed_elements(pages, listing, cfg, persist=False))
    pages_side = []
    skip_indent = None
    for line in src_plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip_indent is not None and indent > skip_indent:
            continue
        skip_indent = None
        if "BroadcastExchange" in line:
            skip_indent = indent
            continue
        pages_side.append(line.strip())
    print("pages side of the parse plan:")
    for line in pages_side:
        print("   ", line[:150])
    print("hash exchange on the pages side:", any("hashpartitioning" in x for x in pages_side))
    print("listing filter broadcast:", "BroadcastExchange" in src_plan)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
