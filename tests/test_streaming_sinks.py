"""Streaming runs of the per-page operators equal their batch runs; sinks
write the report headers."""

import os
import tempfile

from sitelens.config import AuditConfig
from sitelens.operators import blocks
from sitelens.plans.store import parsed_elements
from sitelens.sinks import write_report, write_report_by_sheet
from sitelens import streaming as stm

CFG = AuditConfig()
ROWS = [
    ("https://www.example.com/express/a", 200,
     '<div class="banner"><div>Desktop</div></div><img src="media_x.png"><nav class="seo-nav"><a href="/x">x</a></nav>'),
    ("https://www.example.com/de/express/b", 200,
     '<div class="steps big"><div>Mobile</div></div><div class="section-metadata">mobile</div>'),
    ("https://www.example.com/p", 302, '<div class="banner"></div>'),
]


def _pages_dir(spark):
    d = tempfile.mkdtemp(prefix="sitelens-stream-in-")
    spark.createDataFrame(ROWS[:2], stm.PAGES_SCHEMA).write.mode("overwrite").parquet(f"{d}/part1")
    spark.createDataFrame(ROWS[2:], stm.PAGES_SCHEMA).write.mode("overwrite").parquet(f"{d}/part2")
    return d


def test_media_stream_equals_batch(spark):
    d = _pages_dir(spark)
    s = stm.page_stream(spark, f"{d}/*")
    q = (stm.media_stream(s, CFG).writeStream.format("memory").queryName("media_out")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select * from media_out").collect())
    assert got == [("https://www.example.com/express/a", "[x]")]


def test_block_audit_stream_equals_batch(spark):
    d = _pages_dir(spark)
    out = tempfile.mkdtemp(prefix="sitelens-stream-out-")
    ck = tempfile.mkdtemp(prefix="sitelens-stream-ck-")
    q = stm.start_block_audit(stm.page_stream(spark, f"{d}/*"), out, ck, CFG)
    q.awaitTermination(180)
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(out).select(
        "url", "block", "variant", "layout", "n").collect())
    pages = spark.createDataFrame(ROWS, stm.PAGES_SCHEMA)
    els = parsed_elements(pages, pages.select("url"), CFG, persist=False)
    want = sorted(tuple(r) for r in blocks.block_variant_layout_counts(els, CFG).select(
        "url", "block", "variant", "layout", "n").collect())
    assert got == want and len(want) == 3


def test_sinks_write_headers(spark):
    out = tempfile.mkdtemp(prefix="sitelens-sink-")
    df = spark.createDataFrame([("u", "\na\nb")], "url string, href_links string")
    write_report(df, f"{out}/links", "links")
    from sitelens.sinks import read_report
    back = read_report(spark, f"{out}/links", "`URL` string, `HREF LINKS` string")
    assert back.columns == ["URL", "HREF LINKS"]
    assert back.first()["HREF LINKS"] == "\na\nb"
    media = spark.createDataFrame([("s1", "u", "[x]"), ("s2", "v", "[y]")], "sheet string, url string, template_ids string")
    write_report_by_sheet(media, f"{out}/media")
    assert sorted(os.listdir(f"{out}/media"))[-2:] == ["sheet=s1", "sheet=s2"]


def test_element_stream_equals_batch(spark):
    d = _pages_dir(spark)
    s = stm.page_stream(spark, f"{d}/*")
    q = (stm.element_stream(s, CFG).select("url", "pre", "tag", "chain_labels")
         .writeStream.format("memory").queryName("elements_out")
         .trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = sorted((r["url"], r["pre"], r["tag"], tuple(r["chain_labels"]))
                 for r in spark.sql("select * from elements_out").collect())
    pages = spark.createDataFrame(ROWS, stm.PAGES_SCHEMA)
    from sitelens.operators.elements import extract_elements, page_bodies
    want = sorted((r["url"], r["pre"], r["tag"], tuple(r["chain_labels"]))
                  for r in extract_elements(page_bodies(pages), CFG).collect())
    assert got == want and len(want) > 10
