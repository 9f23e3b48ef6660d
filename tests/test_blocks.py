"""Block facts on small hand-written pages."""

from pyspark.sql import functions as F

from sitelens.config import AuditConfig
from sitelens.operators import blocks, elements as el
from sitelens.plans.store import parsed_elements

CFG = AuditConfig(vocab=("seo-nav", "list", "columns", "marquee", "banner", "cards", "steps"))


def facts(spark, make_pages, html, url="https://www.example.com/express/a"):
    pages = make_pages([(url, 200, html)])
    els = parsed_elements(pages, pages.select("url"), CFG, persist=False)
    return {(r["block"], r["variant"]): r for r in blocks.block_facts(els, CFG).collect()}


def test_default_layout_without_sections(spark, make_pages):
    f = facts(spark, make_pages, '<nav class="seo-nav"><ul class="list compact list"><li><a>x</a></li></ul></nav>')
    assert f[("seo-nav", "")]["layout"] == "Desktop Mobile"
    assert f[("list", "compact")]["layout"] == "Desktop Mobile"
    assert f[("list", "compact")]["n_sections"] == 0


def test_sections_in_parent_scope_in_order(spark, make_pages):
    html = ('<main><article class="dark columns marquee wide"><p><b>t</b></p></article>'
            '<div class="section-metadata"><div>desktop</div><div>Mobile</div></div>'
            '<div class="SECTION-METADATA"><div>Desktop x</div></div>'
            '<div class="section-metadata"><div>DESKTOP</div></div></main>')
    f = facts(spark, make_pages, html)
    r = f[("columns", "dark wide")]
    # third section: DESKTOP is not a case-sensitive find of desktop/Desktop
    assert r["n_sections"] == 3
    assert r["layout"] == "Desktop MobileDesktop"


def test_mobile_only_section_is_trimmed(spark, make_pages):
    html = '<div class="banner"><p>x</p></div><div class="section-metadata"><div>mobile</div></div>'
    assert facts(spark, make_pages, html)[("banner", "")]["layout"] == "Mobile"


def test_empty_layout_when_sections_have_no_terms(spark, make_pages):
    html = '<div class="banner"><p>x</p></div><div class="section-metadata"><div>style</div></div>'
    assert facts(spark, make_pages, html)[("banner", "")]["layout"] == ""


def test_parent_itself_can_be_the_section(spark, make_pages):
    html = '<div class="section-metadata"><div class="cards"><p>x</p></div><div>mobile</div></div>'
    r = facts(spark, make_pages, html)[("cards", "")]
    assert r["n_sections"] == 1 and r["layout"] == "Mobile"


def test_sections_outside_parent_do_not_count(spark, make_pages):
    html = ('<nav><ul class="list"><li>a</li></ul></nav>'
            '<div class="section-metadata"><div>desktop</div></div>')
    assert facts(spark, make_pages, html)[("list", "")]["layout"] == "Desktop Mobile"


def test_chain_wins_over_sections(spark, make_pages):
    html = '<div class="steps"><div>Mobile</div><div>desktop</div></div><div class="section-metadata">mobile</div>'
    assert facts(spark, make_pages, html)[("steps", "")]["layout"] == "DesktopMobile"


def test_block_counts_all_tokens_and_classid_only(spark, make_pages):
    html = '<div class="banner cards banner"></div><div classid="z"></div><div class="x">t</div>'
    pages = make_pages([("u", 200, html)])
    els = parsed_elements(pages, pages.select("url"), CFG, persist=False)
    ce = el.class_elements(els).collect()
    assert sorted(len(r["classes"]) for r in ce) == [0, 1, 2]
    counts = {r["block"]: r["n"] for r in blocks.block_counts(els, CFG.vocab).collect()}
    assert counts == {"banner": 1, "cards": 1}
    bf = blocks.block_facts(els, CFG).collect()
    assert [(r["block"], r["variant"]) for r in bf] == [("banner", "")]


def test_block_counts_sum_equals_token_explode(spark, make_pages):
    html = "".join(f'<div class="{c}"><span class="list steps">x</span></div>'
                   for c in ["banner", "cards list", "zz", "steps steps"])
    pages = make_pages([("u1", 200, html), ("u2", 200, html + html)])
    els = parsed_elements(pages, pages.select("url"), CFG, persist=False)
    total = blocks.block_counts(els, CFG.vocab).agg(F.sum("n")).first()[0]
    tokens = blocks.known_block_tokens(els, CFG.vocab).count()
    # per copy: divs banner 1 + cards list 2 + zz 0 + steps 1, and 4 spans x 2
    assert total == tokens == 3 * ((1 + 2 + 0 + 1) + 4 * 2)


def test_block_matrix_keeps_rejected_pages_as_zero_rows(spark, make_pages):
    pages = make_pages([("a", 200, '<div class="cards"></div>'), ("b", 302, '<div class="cards"></div>'),
                        ("c", 500, "")])
    listing = pages.select("url").unionByName(pages.select("url"))  # listed twice: one row
    els = parsed_elements(pages, listing, CFG, persist=False)
    m = {r["url"]: r for r in blocks.block_matrix(listing, els, CFG.vocab).collect()}
    assert set(m) == {"a", "b", "c"}
    assert m["a"]["cards"] == 1 and m["b"]["cards"] == 0 and m["c"]["cards"] == 0


def test_report_counts_a_url_listed_twice_twice(spark, make_pages):
    url = "https://www.example.com/de/express/x"
    pages = make_pages([(url, 200, '<div class="cards"></div><div class="cards"></div>')])
    listing = pages.select("url").unionByName(pages.select("url"))
    els = parsed_elements(pages, listing, CFG, persist=False)
    rep = blocks.block_variant_layout_report(listing, els, None, CFG).collect()
    assert len(rep) == 1
    assert rep[0]["occurrence"] == 4 and rep[0]["language"] == "de" and rep[0]["last_modified"] is None


def test_admission_307_read_303_skipped(spark, make_pages):
    pages = make_pages([("a", 307, "x"), ("b", 303, "x"), ("c", 404, "x"), ("d", 200, "x")])
    assert sorted(r["url"] for r in el.admit_pages(pages).collect()) == ["a", "d"]
    rej = {r["url"]: r["reason"] for r in el.rejects(pages).collect()}
    assert rej == {"b": "redirect", "c": "http_error"}


def test_copies_of_one_url_do_not_mix(spark, make_pages):
    # three fetched copies of one url; each copy alone gives Desktop Mobile
    # for the banner; mixed pre-orders would pull in the other copies' sections
    url = "https://www.example.com/express/dup"
    a = '<div class="banner"><p>x</p></div>'
    b = '<p>y</p><div class="banner"><p>x</p></div><i>z</i>'
    pages = make_pages([(url, 200, a), (url, 200, b), (url, 200, a)])
    assert el.one_page_per_url(pages).count() == 1
    for persist in (False, True):  # lazy table and written store: one copy per url
        els = parsed_elements(pages, None, CFG, persist=persist)
        assert els.where("pre = 0").count() == 1
        rows = blocks.block_variant_layout_counts(els, CFG).collect()
        assert [(r["block"], r["layout"], r["n"]) for r in rows] == [("banner", "Desktop Mobile", 1)]
        counts = blocks.block_counts(els, CFG.vocab).collect()
        assert [(r["block"], r["n"]) for r in counts] == [("banner", 1)]


def test_group_key_is_a_tuple_no_concatenation_collision(spark, make_pages):
    # joined without a separator these two keys would be equal; as a tuple
    # they are two facts
    cfg = AuditConfig(vocab=("quick-action-card", "quick-action-cards"))
    html = '<div class="quick-action-card s"><p>x</p></div><div class="quick-action-cards"><p>y</p></div>'
    pages = make_pages([("https://www.example.com/express/q", 200, html)])
    els = parsed_elements(pages, None, cfg, persist=False)
    rows = sorted((r["block"], r["variant"], r["n"]) for r in blocks.block_variant_layout_counts(els, cfg).collect())
    assert rows == [("quick-action-card", "s", 1), ("quick-action-cards", "", 1)]
