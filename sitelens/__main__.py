"""Run one report end to end, as each audited program does.

    python -m sitelens REPORT --pages P [--cells C] [--index-docs I]
        [--sitemap-docs S --sitemap-index X] --out DIR [--format csv|parquet|json]
        [--site-root URL] [--brand DOMAIN] [--vocab a,b,c]
        [--families '[{"name": .., "template": "{root}{locale}/..", "locales": ["", ..]}, ..]']
        [--set field=JSON ..]   (any other field of AuditConfig)

Inputs are tables (Parquet): pages(url, status, html);
sheet_cells(sheet, row_num, col_num, value); index documents (index_url,
part, status, body); sitemap documents (doc_url, status, body) with the
sitemap index urls (index_url, index_seq). The report is written with its
headers under DIR (the media report one folder per sheet).
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from .config import DEFAULT, IndexFamily
from .plans import reports as R
from .plans.store import temporary_tables
from .session import build_session
from .sinks import write_report, write_report_by_sheet

KINDS = {
    "report_block_matrix": "matrix", "report_blocks_from_cells": "blocks",
    "report_blocks_from_index": "blocks", "report_blocks_from_sitemap": "blocks",
    "report_brand_links_all": "links", "report_brand_links": "links", "report_links": "link_rows",
    "report_domains_from_index": "domains", "report_domains_from_sitemap": "domains",
    "report_media": "media",
}


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="sitelens")
    ap.add_argument("report", choices=sorted(KINDS))
    for a in ("--pages", "--cells", "--index-docs", "--sitemap-docs", "--sitemap-index"):
        ap.add_argument(a)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="csv")
    ap.add_argument("--master", default=None)
    ap.add_argument("--site-root")
    ap.add_argument("--brand")
    ap.add_argument("--vocab")
    ap.add_argument("--families")
    ap.add_argument("--set", action="append", default=[], metavar="FIELD=JSON")
    return ap


def _config(a):
    cfg = DEFAULT
    if a.site_root:
        cfg = dataclasses.replace(cfg, site_root=a.site_root)
    if a.brand:
        cfg = dataclasses.replace(cfg, brand=a.brand)
    if a.vocab:
        cfg = dataclasses.replace(cfg, vocab=tuple(v for v in a.vocab.split(",") if v))
    if a.families:
        cfg = dataclasses.replace(cfg, families=tuple(
            IndexFamily(f["name"], f["template"], tuple(f["locales"])) for f in json.loads(a.families)))
    for pair in a.set:
        name, _, value = pair.partition("=")
        value = json.loads(value)
        cfg = dataclasses.replace(cfg, **{name: tuple(value) if isinstance(value, list) else value})
    return cfg


def run(argv, spark) -> None:
    """Run the report named in ``argv`` on ``spark``, write it, and delete the
    tables it kept on the way."""
    a = _parser().parse_args(argv)
    with temporary_tables(spark):
        _write(a, _config(a), spark)


def _write(a, cfg, spark) -> None:
    read = spark.read.parquet
    pages = read(a.pages)
    r = a.report
    if r == "report_block_matrix":
        df = R.report_block_matrix(read(a.cells), pages, cfg)
    elif r == "report_blocks_from_cells":
        df = R.report_blocks_from_cells(spark, read(a.cells), read(a.index_docs), pages, cfg)
    elif r == "report_blocks_from_index":
        df = R.report_blocks_from_index(spark, read(a.index_docs), pages, cfg)
    elif r == "report_blocks_from_sitemap":
        df = R.report_blocks_from_sitemap(read(a.sitemap_index), read(a.sitemap_docs), pages, cfg)
    elif r == "report_brand_links_all":
        df = R.report_brand_links_all(read(a.cells), pages, cfg)
    elif r == "report_brand_links":
        df = R.report_brand_links(spark, read(a.index_docs), pages, cfg)
    elif r == "report_links":
        df = R.report_links(read(a.sitemap_index), read(a.sitemap_docs), pages, cfg)
    elif r == "report_domains_from_index":
        df = R.report_domains_from_index(spark, read(a.index_docs), pages, cfg)
    elif r == "report_domains_from_sitemap":
        df = R.report_domains_from_sitemap(read(a.sitemap_index), read(a.sitemap_docs), pages, cfg)
    else:
        df = R.report_media(read(a.cells), pages, cfg)
    if KINDS[r] == "media":
        write_report_by_sheet(df, a.out, "media", a.format)
    else:
        write_report(df, a.out, KINDS[r], a.format)


def main(argv=None) -> None:
    a, _ = _parser().parse_known_args(argv)
    spark = build_session(master=a.master)
    try:
        run(argv, spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
