"""Sources (O1-O7, O42) and link reports (O36-O39) on small inputs."""

from pyspark.sql import functions as F

from sitelens.config import AuditConfig
from sitelens.operators import links, pages as pg
from sitelens.plans.store import parsed_elements
from sitelens.sources import listing as src

CFG = AuditConfig()


def test_cells_header_and_blank(spark):
    cells = spark.createDataFrame(
        [("s", 0, 0, "Url"), ("s", 1, 0, "https://a"), ("s", 2, 0, "   "), ("t", 1, 1, "https://b")],
        "sheet string, row_num int, col_num int, value string")
    got = sorted((r["sheet"], r["url"]) for r in src.cells_to_urls(cells).collect())
    assert got == [("s", "https://a"), ("t", "https://b")]


def test_query_index_parsing(spark):
    root = CFG.site_root
    url = CFG.families[0].template.format(root=root, locale="")
    docs = spark.createDataFrame([
        (url, 0, 200, '{"data":[{"path":"/express/a","lastModified":1700000000},'
                      '{"path":"/express/b","lastModified":"x"}]}'),
        (url, 1, 200, '{"other":[]}'),
        (url, 2, 200, "   "),
        (url, 3, 404, '{"data":[{"path":"/express/c","lastModified":"1"}]}'),
        ("https://elsewhere/query-index.json", 0, 200, '{"data":[{"path":"/z","lastModified":"1"}]}'),
    ], "index_url string, part int, status int, body string")
    qi = src.query_index_listing(spark, docs, CFG)
    got = sorted((r["url"], r["last_modified_raw"]) for r in qi.collect())
    assert got == [(root + "/express/a", "1700000000")]
    bad = src.index_entry_rejects(spark, docs, CFG).collect()
    assert [(r["part"], r["pos"], r["reason"]) for r in bad] == [(0, 1, "bad_date")]
    dates = {r["url"]: r["last_modified"] for r in src.index_dates(qi).collect()}
    assert dates == {root + "/express/a": "2023-11-14 22:13:20"}


def test_expand_index_urls_dedupes(spark):
    from sitelens.config import IndexFamily
    cfg = AuditConfig(families=(IndexFamily("e", "{root}{locale}/q.json", ("", "/in", "/in")),))
    got = [r["index_url"] for r in src.expand_index_urls(spark, cfg).collect()]
    assert sorted(got) == [CFG.site_root + "/in/q.json", CFG.site_root + "/q.json"]


def test_sitemaps_map_and_list(spark):
    idx = "https://s/index.xml"
    docs = spark.createDataFrame([
        (idx, 200, "<sitemapindex><sitemap><loc>https://s/a.xml</loc></sitemap>"
                   "<sitemap><loc>https://s/b.xml</loc></sitemap></sitemapindex>"),
        ("https://s/a.xml", 200, "<urlset><url><loc>https://p/1?x=1&amp;y=2</loc><lastmod>2024-01-01</lastmod></url>"
                                 "<url><loc>https://p/2</loc></url></urlset>"),
        ("https://s/b.xml", 200, "<urlset><url><loc>https://p/1?x=1&amp;y=2</loc><lastmod>2025-01-01</lastmod></url>"
                                 "</urlset>"),
    ], "doc_url string, status int, body string")
    index_urls = spark.createDataFrame([(idx, 0)], "index_url string, index_seq long")
    m = {r["url"]: r["lastmod"] for r in src.sitemap_pages(index_urls, docs, "map").collect()}
    assert m == {"https://p/1?x=1&y=2": "2025-01-01", "https://p/2": ""}
    lst = sorted(r["url"] for r in src.sitemap_pages(index_urls, docs, "list").collect())
    assert lst == ["https://p/1?x=1&y=2", "https://p/1?x=1&y=2", "https://p/2"]


PAGE = ('<a href="/ab">1</a><a href="/a">2</a><a href="">3</a><link href="https://www.example.com/x*y">'
        '<a hreflang="en">4</a><a href="HTTPS://Cdn.Other.org:8080/i">5</a><a href="mailto:m">6</a>'
        '<a href="tel:1">7</a><a href="http://blog.example.com/t">8</a><a href="https://www.example.com/x">9</a>')


def _els(spark, rows):
    pages = spark.createDataFrame(rows, "url string, status int, html string")
    return pages, parsed_elements(pages, pages.select("url"), CFG, persist=False)


def test_link_rows_dedupe_and_star_split(spark):
    pages, els = _els(spark, [("p", 200, PAGE)])
    listing = spark.createDataFrame([("p", 1), ("p", 2)], "url string, page_seq long")
    rows = [r["link"] for r in links.link_rows(listing, els).collect()]
    once = ["/ab", "https://www.example.com/x", "y", "HTTPS://Cdn.Other.org:8080/i", "mailto:m", "tel:1",
            "http://blog.example.com/t"]
    assert sorted(rows) == sorted(once * 2)


def test_brand_links_with_and_without_dedupe(spark):
    pages, els = _els(spark, [("p", 200, PAGE + '<a href="https://www.example.com/x">10</a>'), ("q", 200, "<p>none</p>")])
    listing = pages.select("url")
    keep = {r["url"]: r["href_links"] for r in links.brand_links_report(listing, els, CFG, False).collect()}
    dd = {r["url"]: r["href_links"] for r in links.brand_links_report(listing, els, CFG, True).collect()}
    assert keep["q"] == "" and dd["q"] == ""
    assert keep["p"] == ("\nhttps://www.example.com/x*y\nhttp://blog.example.com/t"
                         "\nhttps://www.example.com/x\nhttps://www.example.com/x")
    assert dd["p"] == "\nhttps://www.example.com/x*y\nhttp://blog.example.com/t"


def test_domain_report_and_unique_domains(spark):
    pages, els = _els(spark, [("p", 200, PAGE)])
    listing = spark.createDataFrame([("p", "express")], "url string, family string")
    r = links.page_domain_report(listing, els, CFG).first()
    assert r["href_links"] == ("\nhttps://www.example.com/x*y\nHTTPS://Cdn.Other.org:8080/i\nmailto:m"
                               "\nhttp://blog.example.com/t")
    assert r["brand_domains"] == "\nhttps://www.example.com\nhttp://blog.example.com"
    assert r["non_brand_domains"] == "\nhttps://Cdn.Other.org\nmailto://"
    ud = sorted(x["origin"] for x in links.unique_domains(listing, els, CFG).collect())
    assert ud == sorted(["https://www.example.com", "https://Cdn.Other.org", "mailto://", "http://blog.example.com"])


def test_media_report_and_tally(spark):
    pages = spark.createDataFrame([("a", 200, "media_x.png media_y.jpeg"), ("b", 200, "none"),
                                   ("c", 301, "media_z.png")], "url string, status int, html string")
    listing = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "c")], "sheet string, url string")
    got = sorted((r["sheet"], r["url"], r["template_ids"]) for r in pg.media_report(listing, pages).collect())
    assert got == [("s1", "a", "[x, y]"), ("s2", "a", "[x, y]")]
    lst = spark.createDataFrame([("i", "a"), ("i", "b"), ("i", "c")], "index_url string, url string")
    t = pg.crawl_tally(lst, pages).first()
    assert (t["listed"], t["processed"], t["ignored"]) == (3, 2, 1)


def test_last_wins(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b"), ("v", 1, "x")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in pg.last_wins(df, ["k"], ["o"], ["v"]).collect()}
    assert got == {"u": "c", "v": "x"}


def test_sitemap_element_quirks(spark):
    docs = spark.createDataFrame([
        ("d1", 200, "<urlset><url><LOC>https://p/A</LOC></url><url><a:loc>https://p/B</a:loc></url>"
                    "<url><loc> https://p/C </loc><lastmod> 2024 </lastmod></url>"
                    "<url><loc>x</loc><loc>y</loc></url></urlset>"),
        ("d2", 200, '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
                    "  <url>\n    <loc>https://p/D</loc>\n  </url>\n</urlset>"),
        ("d3", 404, "<urlset><url><loc>https://p/E</loc></url></urlset>"),
    ], "doc_url string, status int, body string")
    m = sorted((r["loc"], r["lastmod"]) for r in src.read_sitemap_urls(docs, "map").collect())
    # <LOC> matches ignoring case, <a:loc> does not, text is not trimmed,
    # the last loc of an element wins, a non-200 document is not read
    assert m == [(" https://p/C ", " 2024 "), ("https://p/A", ""), ("https://p/D", ""), ("y", "")]
    lst = sorted(r["loc"] for r in src.read_sitemap_urls(docs, "list").collect())
    assert lst == [" https://p/C ", "https://p/A", "https://p/D", "x", "y"]


def test_child_sitemap_listed_twice_is_read_once_per_listing(spark):
    idx = "https://s/index.xml"
    docs = spark.createDataFrame([
        (idx, 200, "<sitemapindex><sitemap><loc>https://s/a.xml</loc></sitemap>"
                   "<sitemap><loc>https://s/a.xml</loc></sitemap></sitemapindex>"),
        ("https://s/a.xml", 200, "<urlset><url><loc>https://p/1</loc></url></urlset>"),
    ], "doc_url string, status int, body string")
    index_urls = spark.createDataFrame([(idx, 0)], "index_url string, index_seq long")
    assert src.sitemap_pages(index_urls, docs, "list").count() == 2
    assert src.sitemap_pages(index_urls, docs, "map").count() == 1


def test_unique_domains_of_a_run_are_those_of_its_listing(spark, make_pages):
    from sitelens.plans.store import parsed_elements
    pages = make_pages([("u", 200, '<a href="https://one.com/a">x</a>'), ("v", 200, '<a href="https://two.com/b">x</a>')])
    listing = pages.where("url = 'u'").select("url")
    for whole in (None, listing):  # a store of the whole crawl, or of the listed pages
        els = parsed_elements(pages, whole, CFG)
        got = links.unique_domains(listing, els, CFG, by=None).collect()
        assert [r["origin"] for r in got] == ["https://one.com"]


def test_list_mode_positions_never_collide(spark):
    body = "<urlset>" + ("<url>" + "<loc>a</loc>" * 1_200 + "</url>") * 3 + "</urlset>"
    docs = spark.createDataFrame([("d", 200, body)], "doc_url string, status int, body string")
    assert src.read_sitemap_urls(docs, "list").select("pos").distinct().count() == 3_600
    assert src.read_sitemap_urls(docs.limit(0), "list").count() == 0


def test_tally_of_an_empty_document_is_a_line_of_zeros(spark):
    pages = spark.createDataFrame([("a", 200, "")], "url string, status int, html string")
    listing = spark.createDataFrame([("i", "a"), ("i", "gone")], "index_url string, url string")
    documents = spark.createDataFrame([("i",), ("i",), ("empty",)], "index_url string")
    got = sorted(map(tuple, pg.crawl_tally(listing, pages, documents).collect()))
    assert got == [("empty", 0, 0, 0), ("i", 2, 2, 0)]


def test_hot_listed_url_is_dealt_out_without_adaptive_help(spark, make_pages):
    """A url that is most of the listing: salted on one side, repeated on the other."""
    pages = make_pages([("u1", 200, '<a href="/a"></a><a href="/b*c"></a>'), ("u2", 200, '<a href="/z"></a>'), ("u3", 200, "<p>")])
    rows = [("u1", i) for i in range(900)] + [("u2", 900), ("u2", 901), ("u3", 902), ("gone", 903)]
    listing = spark.createDataFrame(rows, "url string, page_seq long").repartition(3)
    links_of = links.page_links(parsed_elements(pages, None))
    assert [tuple(r) for r in links.hot_urls(listing, share=1_000, rows=100).collect()] == [("u1", 9)]
    assert links.hot_urls(listing).count() == 0
    got = sorted((r.page_seq, r.i, r.j, r.link) for r in links.link_rows(listing, None, links_of, rows=100).collect())
    want = [(i, k, j, x) for i in range(900) for k, j, x in ((0, 0, "/a"), (1, 0, "/b"), (1, 1, "c"))]
    assert got == want + [(900, 0, 0, "/z"), (901, 0, 0, "/z")]
    # how the hot rows fall: many (url, salt) keys, none with most of them
    hot = links.hot_urls(listing, rows=100)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = links.salted_join(listing, links.link_facts(links_of).select("url", "links"), hot)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p"), "url").count().where("url = 'u1'").collect()]
        assert sum(sizes) == 900 and len(sizes) > 1 and max(sizes) < 700
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_listed_url_is_read_or_rejected(spark):
    from sitelens.operators import elements as el
    rows = [("a", 200, "x"), ("b", None, "x"), ("c", 500, "x"), ("d", 302, None), ("e", 200, None), ("f", None, None),
            ("g", 404, "x"), ("g", None, "y"), ("h", 200, None), ("h", 301, "x"), ("i", None, "x"), ("i", 200, "z"), ("j", 307, "")]
    pages = spark.createDataFrame(rows, "url string, status int, html string")
    assert el.admit_pages(pages).count() + el.rejects(pages).count() == len(rows)
    assert sorted(r.reason for r in el.rejects(pages.where("url in ('b', 'c', 'd', 'e', 'f')")).collect()) == [
        "http_error", "no_markup", "no_status", "no_status", "redirect"]
    listing = spark.createDataFrame([(u,) for u in "aabcdefghijkk"] + [(None,)], "url string")
    got = {r.url: (r.times, r.status, r.reason) for r in el.reconciled(listing, pages).collect()}
    assert got == {"a": (2, 200, None), "b": (1, None, "no_status"), "c": (1, 500, "http_error"), "d": (1, 302, "redirect"),
                   "e": (1, 200, "no_markup"), "f": (1, None, "no_status"), "g": (1, 404, "http_error"), "h": (1, 301, "redirect"),
                   "i": (1, 200, None), "j": (1, 307, None), "k": (2, None, "not_fetched"), None: (1, None, "not_fetched")}
    read = el.admit_pages(el.one_page_per_url(pages)).join(listing.distinct(), "url", "left_semi")
    assert {r.url for r in read.collect()} == {u for u, (_, _, reason) in got.items() if reason is None}


def sitemap_bodies():
    def items(name, n):
        return "".join(f"<url>\n <loc> https://x/{name}/{i}?a=1&amp;b </loc>" + (f"<lastmod>d{i}</lastmod>" if i % 2 else "")
                       + ("<image:image><image:loc>no</image:loc></image:image>" if i % 5 == 0 else "") + "</url>\n" for i in range(n))
    head = '<?xml version="1.0"?>\n<urlset xmlns="s" xmlns:image="http://image">\n'
    return {
        "big": head + items("big", 4_000) + "<!-- done -->\n</urlset>\n",
        "two": head + "<url><loc>p</loc><loc>q</loc></url><url><lastmod>z</lastmod></url></urlset>",
        "upper": "<URLSET><URL><LOC>u</LOC></URL><URL><LOC>v</LOC></URL></URLSET>",
        "none": "<urlset></urlset>",
        "cut": head + items("cut", 50),
        "broken": head + "<url><loc>a</loc></url><url><loc>b</url></urlset>",
        "gone": head + items("gone", 3) + "</urlset>",
    }


def test_sitemap_files_are_split_and_give_the_same_rows(spark, tmp_path):
    bodies = sitemap_bodies()
    status = {n: 404 if n == "gone" else 200 for n in bodies}
    docs = spark.createDataFrame([(f"d/{n}", status[n], b) for n, b in bodies.items()], "doc_url string, status int, body string")
    files = spark.createDataFrame([(f"d/{n}", status[n], n) for n in bodies], "doc_url string, status int, file string")
    for n, b in bodies.items():
        (tmp_path / f"file={n}").mkdir()
        (tmp_path / f"file={n}" / "doc.xml").write_text(b)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for mode in ("map", "list"):
            def rows(df):
                return [(r.doc_url, r.loc, r.lastmod) for r in df.orderBy("doc_url", "pos").collect()]
            split = src.read_sitemap_files(spark, str(tmp_path), files, mode)
            assert rows(split) == rows(src.read_sitemap_urls(docs, mode)) and split.count() > 4_000
        text = spark.read.option("lineSep", "</url>").text(str(tmp_path / "file=big"))
        assert text.rdd.getNumPartitions() > 5  # one document, many tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
