"""The fact-store pipeline equals standalone reports; plan properties that
matter at scale are pinned by reading the physical plans."""

import os

import pytest

from sitelens.config import DEFAULT as cfg
from sitelens.operators.elements import extract_elements, page_bodies
from sitelens.plans import reports as R
from sitelens.plans.store import FactStore, listed_pages
from sitelens.sources import fixture as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def rows(df):
    return sorted(tuple("NULL" if v is None else str(v) for v in r) for r in df.collect())


def test_reports_over_fact_store_equal_standalone(spark):
    pages = fx.site_pages(spark, SF)
    cells = fx.sheet_cells(spark, SF)
    idx = fx.index_documents(spark, SF)
    smd = fx.sitemap_documents(spark, SF)
    smi = fx.sitemap_index_urls(spark, SF)
    store = FactStore.build(pages, None, cfg)
    makers = {
        "p1": lambda e: R.report_block_matrix(cells, pages, cfg, e),
        "p2": lambda e: R.report_blocks_from_cells(spark, cells, idx, pages, cfg, e),
        "p3": lambda e: R.report_blocks_from_index(spark, idx, pages, cfg, e),
        "p4": lambda e: R.report_blocks_from_sitemap(smi, smd, pages, cfg, e),
        "p5": lambda e: R.report_brand_links_all(cells, pages, cfg, e),
        "p6": lambda e: R.report_brand_links(spark, idx, pages, cfg, e),
        "p7": lambda e: R.report_links(smi, smd, pages, cfg, e).drop("page_seq"),
        "p8": lambda e: R.report_domains_from_index(spark, idx, pages, cfg, e),
        "p9": lambda e: R.report_domains_from_sitemap(smi, smd, pages, cfg, e),
    }
    for name, make in makers.items():
        a, b = make(store), make(None)
        assert a.columns == b.columns, name
        assert rows(a) == rows(b), name


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_admission_filters_reach_the_scan(spark):
    pages = fx.site_pages(spark, SF)
    path = os.path.join(spark.conf.get("spark.checkpoint.dir", "/tmp"), "plan-pages")
    pages.write.mode("overwrite").parquet(path)
    plan = _plan(page_bodies(spark.read.parquet(path)))
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    for part in ("IsNotNull(status)", "Not(In(status, [301,302,303]))", "LessThan(status,400)", "IsNotNull(html)"):
        assert part in pushed


def test_parse_input_has_no_hash_exchange_of_pages(spark):
    pages = fx.site_pages(spark, SF)
    listing = pages.select("url")
    plan = _plan(extract_elements(listed_pages(pages, listing), cfg))
    assert "MapInArrow" in plan
    assert "BroadcastExchange" in plan  # the measured url list is broadcast
    # no hash-partitioned exchange carries the markup to the Python step
    assert "hashpartitioning(url" not in plan.split("BroadcastExchange")[0]


def test_command_line_report(spark, tmp_path):
    from sitelens.__main__ import run
    from sitelens.sinks import read_report
    pages = fx.site_pages(spark, SF)
    pages.write.mode("overwrite").parquet(str(tmp_path / "pages"))
    fx.index_documents(spark, SF, cfg).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    run(["report_domains_from_index", "--pages", str(tmp_path / "pages"), "--index-docs",
         str(tmp_path / "docs"), "--out", str(tmp_path / "out")], spark)
    back = read_report(spark, str(tmp_path / "out"),
                       "`URL` string, `HREF LINKS` string, `BRAND DOMAINS` string, `NON-BRAND DOMAINS` string")
    want = R.report_domains_from_index(spark, fx.index_documents(spark, SF, cfg), pages, cfg)
    assert rows(back) == rows(want)


def test_reports_agree_on_the_copy_of_a_url_for_any_partitioning(spark):
    """Copies of one url: blocks, media and tally read the same one."""
    from sitelens.operators import blocks, pages as pg
    from sitelens.plans.store import parsed_elements
    page = '<div class="{}"><p>x</p></div>media_{}.png'
    copies = [("u", 200, page.format("banner", "a")), ("u", 200, page.format("steps", "b")), ("u", 302, page.format("cards", "c")),
              ("u", 404, ""), ("v", 302, ""), ("v", 404, ""), ("w", 200, page.format("cards", "d"))] * 2
    listing = spark.createDataFrame([("s", "i", "u"), ("s", "i", "v"), ("s", "i", "w")], "sheet string, index_url string, url string")
    seen = set()
    for n in (1, 2, 3, 7):
        pages = spark.createDataFrame(copies, "url string, status int, html string").repartition(n)
        els = parsed_elements(pages, listing, cfg)
        b = {r["url"]: r["block"] for r in blocks.block_variant_layout_counts(els, cfg).collect()}
        m = {r["url"]: r["template_ids"] for r in pg.media_report(listing, pages).collect()}
        t = pg.crawl_tally(listing, pages).first()
        assert {"banner": "[a]", "steps": "[b]"}[b["u"]] == m["u"]
        seen.add((b["u"], b["w"], m["w"], t["listed"], t["processed"], t["ignored"]))
    assert len(seen) == 1 and next(iter(seen))[1:] == ("cards", "[d]", 3, 2, 1)
    latest = spark.createDataFrame([("u", 200, "old", 1), ("u", 404, "gone", 2)], "url string, status int, html string, fetch_seq long")
    from sitelens.operators.elements import one_page_per_url
    assert [r["html"] for r in one_page_per_url(latest).collect()] == ["gone"]


def test_report_is_the_same_without_broadcast(spark):
    pages, cells = fx.site_pages(spark, SF), fx.sheet_cells(spark, SF)
    want = rows(R.report_brand_links_all(cells, pages, cfg))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(R.report_brand_links_all(cells, pages, cfg)) == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_sitemap_body_is_shuffled(spark):
    from sitelens.plans.store import materialize
    from sitelens.sources import listing as src
    docs = materialize(fx.sitemap_documents(spark, SF), "sitemaps")
    index = materialize(fx.sitemap_index_urls(spark, SF), "sitemap-index")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (src.sitemap_pages(index, docs), src.sitemap_pages(index, docs, "list"), src.sitemap_doc_rejects(index, docs)):
            lines = _plan(df).split("\n")
            for i, line in enumerate(lines):
                if "Exchange" in line:  # what is exchanged is the output of the line below
                    assert "body" not in lines[i + 1].split("from_xml")[0], lines[i + 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_command_line_takes_families_and_leaves_nothing_behind(spark, tmp_path):
    from sitelens.__main__ import run
    from sitelens.sinks import read_report
    root = "https://other.test"
    spark.createDataFrame([(f"{root}/a", 200, '<div class="hero"><a href="https://x.test/1">x</a></div>')],
                          "url string, status int, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([(f"{root}/i.json", 0, 200, '{"data":[{"path":"/a","lastModified":"0"}]}')],
                          "index_url string, part int, status int, body string").write.parquet(f"{tmp_path}/docs")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    run(["report_blocks_from_index", "--pages", f"{tmp_path}/pages", "--index-docs", f"{tmp_path}/docs", "--out", f"{tmp_path}/out",
         "--site-root", root, "--vocab", "hero", "--families", '[{"name":"all","template":"{root}{locale}/i.json","locales":[""]}]',
         "--set", 'default_layout="Both"'], spark)
    back = read_report(spark, f"{tmp_path}/out", "b string, v string, l string, lang string, n long, d string, u string").first()
    assert (back["b"], back["l"], back["n"], back["d"], back["u"]) == ("hero", "Both", 1, "1970-01-01 00:00:00", f"{root}/a")
    assert {x for x in os.listdir(folder) if not x.startswith("pyfiles")} <= before


def test_session_settings_are_left_to_the_cluster(monkeypatch):
    from pyspark.sql import SparkSession
    from sitelens import session
    given = {}

    class Builder:
        def appName(self, name):
            return self

        def master(self, m):
            given["master"] = m
            return self

        def config(self, k, v):
            given[k] = v
            return self

        def getOrCreate(self):
            return type("S", (), {"sparkContext": type("C", (), {"setLogLevel": lambda *_: None})()})()

    monkeypatch.setattr(SparkSession, "builder", Builder())
    session.build_session()
    assert not {"master", "spark.driver.memory", "spark.sql.shuffle.partitions"} & given.keys()


def test_reports_at_once_delete_their_own_tables_only(spark):
    import threading

    from sitelens.plans import store
    paths, gate = {}, threading.Barrier(2)

    def report(name, hold):
        with store.temporary_tables(spark):
            paths[name] = store.write_table(spark.range(3), "t")
            gate.wait(60)
            if hold:
                other.join(60)  # the other one has ended and deleted its tables
                paths["read"] = spark.read.parquet(paths[name]).count()

    other = threading.Thread(target=report, args=("b", False))
    other.start()
    report("a", True)
    assert paths["read"] == 3 and paths["a"] != paths["b"]
    for name in "ab":
        assert not os.path.exists(paths[name].replace("file:", ""))
    assert os.path.exists(store.write_table(spark.range(1), "kept").replace("file:", ""))


def test_layout_queries_parse_once(spark):
    """Each of them reads the elements several times: stored ones, not the markup."""
    from sitelens.plans.registry import QUERIES
    for name in ("layout_label", "section_scope", "section_terms", "block_variant_layout_report"):
        assert "MapInArrow" not in _plan(QUERIES[name](spark, SF)), name


def test_elements_are_numbered_in_tasks_of_bounded_size(spark, monkeypatch):
    from sitelens.plans import registry as Q
    whole = Q.QUERIES["extract_elements"](spark, SF)
    monkeypatch.setattr(Q, "TASK_ELEMENTS", 100)
    many = Q.QUERIES["extract_elements"](spark, SF)
    assert rows(many) == rows(whole)
    plan = _plan(many).split("Initial Plan")[0]
    n = whole.count()
    assert "Join" not in plan and plan.count("Exchange") == 1 and f", {n // 100 + 1})" in plan


def test_element_places_and_parents(spark, monkeypatch):
    from sitelens.plans import registry as Q
    markup = "<html><body><div><b><i>x</i></b><p>y</p></div><br><p>z</p></body></html>"
    els = spark.createDataFrame([("https://a/1", markup), (None, markup)], "url string, html string")
    monkeypatch.setattr(Q.Fixture, "fetched", els)
    monkeypatch.setattr(Q, "parsed_elements", lambda pages, *a, **k: extract_elements(pages, cfg, keep="all"))
    got = Q.QUERIES["extract_elements"](spark, SF).collect()
    for url in ("https://a/1", None):
        page = sorted((r.n, r.tag, r.parent_n) for r in got if r.url == url)
        assert [(t, p) for _, t, p in page] == [("html", None), ("head", 1), ("body", 1), ("div", 3), ("i", None), ("p", 4), ("p", 3)]
