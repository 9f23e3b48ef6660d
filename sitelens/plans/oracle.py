"""DuckDB oracle SQL for every registered query.

Each oracle reads the driver's ``pages`` table, rebuilds the fixture site
with the same SQL text as Spark (``site_pages``), and computes the expected
answer independently: regular expressions over the markup instead of an
element tree, list lambdas instead of Spark arrays, and the hand-derived
layout table of FIXTURES.md section 3 for the tree-walk facts. The Spark
side never runs any of this.
"""

from __future__ import annotations

from ..config import DEFAULT
from ..sources.fixture import PART_SIZE, SITE_PAGES_SQL

ROOT = DEFAULT.site_root
VOCAB = "[" + ", ".join(f"'{v}'" for v in DEFAULT.vocab) + "]"
PART = 3 * PART_SIZE
SCHEMES = "[" + ", ".join(f"'{s}'" for s in DEFAULT.url_schemes) + "]"
IDX0 = f"{ROOT}/express/query-index.json"
IDX1 = f"{ROOT}/br/express/query-index.json"
IDX_EMPTY = f"{ROOT}/fr/express/query-index.json"
IDX2 = f"{ROOT}/de/express/learn/blog/query-index.json"


def _dedupe(a: str) -> str:
    return (f"list_filter({a}, lambda x, i: x <> '' and not coalesce(list_bool_or("
            f"list_transform({a}[1:i-1], lambda y: contains(y, x))), false))")


def _join_links(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: chr(10) || x), '')"


# The parts of a link by plain string functions: scheme before the first colon,
# what stands between // and the next / ? #, without what precedes an @.
def _scheme(h: str) -> str:
    return f"lower(split_part({h}, ':', 1))"


def _host_port(h: str) -> str:
    rest = f"substr({h}, strpos({h}, ':') + 1)"
    auth = f"split_part(split_part(split_part(substr({rest}, 3), '/', 1), '?', 1), '#', 1)"
    return f"(case when starts_with({rest}, '//') then substr({auth}, strpos({auth}, '@') + 1) else '' end)"


def _is_abs(h: str) -> str:
    p = _host_port(h)
    port = f"(case when starts_with({p}, '[') then split_part({p}, ']:', 2) else substr({p}, strpos({p}, ':') + 1) end)"
    return (f"(contains({h}, ':') and list_contains({SCHEMES}, {_scheme(h)}) and "
            f"(not contains({p}, ':') or {port} = '' or try_cast({port} as hugeint) >= 0))")


def _origin(h: str) -> str:
    p = _host_port(h)
    return (f"{_scheme(h)} || '://' || (case when starts_with({p}, '[') then split_part({p}, ']', 1) || ']' "
            f"else split_part({p}, ':', 1) end)")


def _brand(x: str) -> str:
    return f"contains(lower({x}), '{DEFAULT.brand.lower()}')"


CTES: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = sql
    DEPS[name] = deps


cte("site_pages", SITE_PAGES_SQL)
cte("admitted", """select page_id, url, status, regexp_replace(html, '\\r\\n|\\r|\\n', '', 'g') as html
  from site_pages where status not in (301, 302, 303) and status < 400""", "site_pages")
cte("cells", """select concat('sheet', cast(page_id % 2 as varchar(2))) as sheet,
       cast(page_id // 2 as bigint) as row_num, 0 as col_num,
       case when page_id % 11 = 3 then '  ' else url end as value
  from site_pages
  union all
  select concat('sheet', cast((page_id + 1) % 2 as varchar(2))) as sheet,
       cast(page_id as bigint) as row_num, 1 as col_num, url as value
  from site_pages where page_id % 17 = 5""", "site_pages")
cte("cell_urls", """select sheet, row_num, col_num, value as url from cells
  where row_num <> 0 and regexp_matches(value, '\\S')""", "cells")
cte("qi", f"""select page_id, url,
    case page_id % 3 when 0 then '{IDX0}' when 1 then '{IDX1}' else '{IDX2}' end as index_url,
    case page_id % 3 when 2 then 'blog' else 'express' end as family,
    page_id // {PART} as part,
    strftime(make_timestamp((1700000000 + page_id)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') as last_modified
  from site_pages""", "site_pages")
cte("qi_read", "select * from qi where not (page_id % 3 = 2 and part = 1)", "qi")
cte("sm_items", f"""select url, page_id,
    '{ROOT}/sitemap-' || cast(page_id % 3 as varchar) || '-' || cast(page_id // {PART} as varchar) || '.xml' as doc_url,
    0 as rank, page_id // {PART} as part,
    case when page_id % 2 = 0 then strftime(make_timestamp((1700000000 + page_id)::BIGINT * 1000000), '%Y-%m-%d') else '' end as lastmod
  from site_pages
  union all
  select url, page_id,
    '{ROOT}/sitemap-extra-' || cast(page_id // {PART} as varchar) || '.xml' as doc_url,
    1 as rank, page_id // {PART} as part,
    case when page_id % 2 = 0 then strftime(make_timestamp((1800000000 + page_id)::BIGINT * 1000000), '%Y-%m-%d') else '' end as lastmod
  from site_pages where page_id % 7 = 0""", "site_pages")
cte("sm_map", """select url, arg_max(lastmod, rank) as lastmod from sm_items group by url""", "sm_items")
cte("cls", """select url, page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^<>]*?\\sclass="([^"]*)"', 1)) as cv
  from admitted""", "admitted")
cte("cls_t", """select url, page_id,
    list_filter(regexp_split_to_array(trim(cv), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as t0 from cls""", "cls")
cte("cls_d", "select url, page_id, list_filter(t0, lambda x, i: list_position(t0, x) = i) as toks from cls_t",
    "cls_t")
cte("blk", f"""select url, page_id, block, variant,
    case block when 'banner' then (case when variant = 'big' then 'Mobile' else 'Desktop' end)
               when 'cards' then 'Desktop' when 'steps' then 'DesktopMobile' else '' end as chain,
    case block when 'list' then 0 else (case page_id % 3 when 0 then 1 when 1 then 0 else 2 end) end as n_sections
  from (select url, page_id, list_filter(toks, lambda x: list_contains({VOCAB}, x))[1] as block,
               array_to_string(list_filter(toks, lambda x: not list_contains({VOCAB}, x)), ' ') as variant
        from cls_d) where block is not null""", "cls_d")
cte("blk_l", """select url, page_id, block, variant, chain, n_sections,
    case when chain <> '' then chain when n_sections = 0 then 'Desktop Mobile'
         when page_id % 3 = 0 then 'Mobile' else 'Desktop MobileDesktop' end as layout from blk""", "blk")
cte("blk_counts", """select url, block, variant, layout, count(*) as n from blk_l group by all""", "blk_l")
cte("hrefs", """select url, page_id, regexp_extract_all(html, '<[a-zA-Z][^<>]*?\\shref="([^"]*)"', 1) as hs
  from admitted""", "admitted")
cte("dom", f"""select url, page_id, kept, origins,
    {_dedupe(f"list_filter(origins, lambda o: {_brand('o')})")} as brand,
    {_dedupe(f"list_filter(origins, lambda o: not {_brand('o')})")} as non_brand
  from (select url, page_id, kept, list_transform(kept, lambda h: {_origin('h')}) as origins
        from (select url, page_id, {_dedupe('ab')} as kept
              from (select url, page_id, list_filter(hs, lambda h: {_is_abs('h')}) as ab from hrefs)))""",
    "hrefs")
cte("media", """select url, page_id,
    list_sort(list_distinct(regexp_extract_all(html, 'media_(.*?)\\.(png|jpeg|mp4)', 1))) as ids from admitted""",
    "admitted")


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n"


def lang(u: str) -> str:
    prefix = ROOT + "/"
    rest = f"substr({u}, strpos({u}, '{prefix}') + {len(prefix)})"
    seg = f"split_part({rest}, '/', 1)"
    return (f"case when contains({u}, '{prefix}') and contains({rest}, '/') then "
            f"(case when lower({seg}) = 'express' then 'en' else {seg} end) end")


def block_report(listing_cte: str, listing_sql: str, dates_sql: str | None, *extra: str) -> str:
    dates = f", dates as ({dates_sql})" if dates_sql else ""
    lm = "d.last_modified" if dates_sql else "cast(null as varchar)"
    join = "left join dates d on d.url = f.url" if dates_sql else ""
    return (with_("blk_counts", listing_cte, *extra)[:-1] + f", listing as ({listing_sql}){dates}\n"
            f"""select f.block as block_name, f.variant as variant_name, f.layout as layout_name,
       {lang('f.url')} as language, (f.n * t.times)::BIGINT as occurrence, {lm} as last_modified,
       f.url as page_url
from blk_counts f join (select url, count(*) as times from listing group by url) t on t.url = f.url {join}""")


VOCAB_COLS = ",\n       ".join(
    f"coalesce(sum(n) filter (where tok = '{v}'), 0)::BIGINT as \"{v}\"" for v in DEFAULT.vocab)

ORACLES: dict[str, str] = {
    "cells_to_urls": with_("cell_urls") + "select sheet, row_num, col_num, url from cell_urls",
    "admit_pages": with_("site_pages") + """select page_id, url, status from site_pages
        where status not in (301, 302, 303) and status < 400""",
    "rejects": with_("site_pages") + """select url, status,
        case when status in (301, 302, 303) then 'redirect' else 'http_error' end as reason
        from site_pages where status in (301, 302, 303) or status >= 400""",
    "listing_reconciled": with_("cell_urls", "qi_read", "sm_items") + """, listing as (
          select url from cell_urls union all select url from qi_read union all select url from sm_items),
        crawled as (select url, case when page_id % 19 <> 3 then status end as status, page_id % 23 <> 5 as markup
          from (select page_id, url, status from site_pages
                union all select page_id, url, 404 from site_pages where page_id % 13 = 4) where page_id % 29 <> 7),
        judged as (select url, status, case when status is null then 'no_status' when status in (301, 302, 303) then 'redirect'
          when status >= 400 then 'http_error' when not markup then 'no_markup' else 'read' end as reason from crawled),
        chosen as (select * from judged qualify row_number() over (partition by url order by
          case reason when 'read' then 3 when 'redirect' then 2 when 'http_error' then 1 else 0 end desc, status desc nulls last) = 1)
        select l.url, l.times, c.status, case when c.url is null then 'not_fetched' else nullif(c.reason, 'read') end as reason
        from (select url, count(*) as times from listing group by url) l left join chosen c on c.url = l.url""",
    "join_lines": with_("admitted") + "select page_id, length(html)::BIGINT as n_chars, md5(html) as html_md5 from admitted",
    "admit_index_docs": with_("qi") + f"""select distinct index_url, part::BIGINT as part from qi
        where not (page_id % 3 = 2 and part = 1)
        union all select distinct index_url, -2::BIGINT as part from qi where part = 0
        union all select distinct index_url, -3::BIGINT as part from qi where part = 0
        union all select '{IDX_EMPTY}', 0""",
    "index_entry_rejects": with_("qi") + """select distinct index_url, -3::BIGINT as part, 0::BIGINT as pos,
        'no_path' as reason from qi where part = 0
        union all select distinct index_url, -3, 1, 'bad_date' from qi where part = 0""",
    "index_doc_rejects": with_("qi") + """select distinct index_url, part::BIGINT as part, 500 as status,
        'http_status' as reason from qi where page_id % 3 = 2 and part = 1
        union all select distinct index_url, -1::BIGINT, 200, 'blank' from qi where part = 0
        union all select distinct index_url, -2::BIGINT, 200, 'no_data' from qi where part = 0""",
    "read_query_index": with_("qi_read") + "select index_url, url, last_modified from qi_read",
    "format_epoch": with_("qi_read") + """select url, cast(1700000000 + page_id as varchar) as last_modified_raw,
        last_modified from qi_read""",
    "last_wins": with_("qi_read") + "select url, last_modified from qi_read",
    "read_sitemap_index": with_("sm_items") + f"""select '{ROOT}/sitemap-index-' || cast(part as varchar) || '.xml' as index_url,
        (row_number() over (partition by part order by rank, doc_url) - 1)::BIGINT as child_pos, doc_url as sitemap_url
        from (select distinct part, rank, doc_url from sm_items
              union all select distinct part, 2, '{ROOT}/sitemap-broken-' || cast(part as varchar) || '.xml' from sm_items
              union all select distinct part, 3, '{ROOT}/sitemap-gone-' || cast(part as varchar) || '.xml' from sm_items)""",
    "sitemap_doc_rejects": with_("sm_items") + f"""select distinct '{ROOT}/sitemap-broken-' || cast(part as varchar) || '.xml'
        as doc_url, 'child' as level, 200 as status, 'no_entries' as reason from sm_items
        union all select distinct '{ROOT}/sitemap-gone-' || cast(part as varchar) || '.xml', 'child', 404,
        'http_status' from sm_items""",
    "read_sitemap_urls": with_("sm_items") + """select doc_url,
        (row_number() over (partition by doc_url order by page_id) - 1)::BIGINT as pos, url as loc, lastmod from sm_items""",
    "sitemap_pages": with_("sm_map") + "select url, lastmod from sm_map",
    "sitemap_listing": with_("sm_items") + "select url, doc_url from sm_items",
    "union_sources": with_("cell_urls", "qi_read", "site_pages") + """select 'cells' as source, url from cell_urls
        union all select 'query_index' as source, url from qi_read
        union all select 'sitemap' as source, url from site_pages""",
    "page_language": with_("site_pages") + f"select url, {lang('url')} as language from site_pages",
    "class_elements": with_("admitted") + """select url, n::BIGINT as n, lower(regexp_extract(m, '^<([a-zA-Z0-9]+)', 1)) as tag,
        array_to_string(list_filter(toks, lambda x, i: list_position(toks, x) = i), ' ') as classes
        from (select url, n, ms[n] as m,
                list_filter(regexp_split_to_array(trim(regexp_extract(ms[n], '\\sclass="([^"]*)"', 1)), '[ \\t\\n]+'), lambda x: x <> '') as toks
              from (select url, ms, generate_subscripts(ms, 1) as n
                    from (select url, regexp_extract_all(html, '<[a-zA-Z][^<>]*?\\sclass[^<>]*>', 0) as ms from admitted)))""",
    "href_elements": with_("hrefs") + "select url, unnest(hs) as href from hrefs",
    "class_tokens": with_("cls_d") + """select url, token, count(*) as n
        from (select url, unnest(toks) as token from cls_d) group by all""",
    "block_counts": with_("cls_d") + f"""select url, token as block, count(*) as n
        from (select url, unnest(toks) as token from cls_d) where list_contains({VOCAB}, token) group by all""",
    "primary_block": with_("blk") + "select url, block, variant, count(*) as n from blk group by all",
    "chain_label": with_("blk") + "select url, block, variant, chain from blk",
    "section_scope": with_("blk") + "select url, block, variant, n_sections::BIGINT as n_sections from blk",
    "section_terms": with_("admitted") + """select url, 1::BIGINT as section_no, false as has_desktop, true as has_mobile
        from admitted where page_id % 3 = 0
        union all select url, 1::BIGINT, true, true from admitted where page_id % 3 = 2
        union all select url, 2::BIGINT, true, false from admitted where page_id % 3 = 2""",
    "layout_label": with_("blk_l") + "select url, block, variant, layout from blk_l",
    "substring_dedupe": with_("hrefs") + f"""select url, (i - 1)::BIGINT as i, kept[i] as link
        from (select url, kept, generate_subscripts(kept, 1) as i from (select url, {_dedupe('hs')} as kept from hrefs))""",
    "absolute_url_filter": with_("hrefs") + f"""select url, h as href
        from (select url, unnest(hs) as h from hrefs) where {_is_abs('h')}""",
    "url_origin": with_("hrefs") + f"""select url, h as href, {_origin('h')} as origin
        from (select url, unnest(hs) as h from hrefs) where {_is_abs('h')}""",
    "classify_origin": with_("hrefs") + f"""select distinct origin, {_brand('origin')} as is_brand
        from (select {_origin('h')} as origin from (select unnest(hs) as h from hrefs) where {_is_abs('h')})""",
    "media_ids": with_("media") + """select url, '[' || array_to_string(ids, ', ') || ']' as template_ids
        from media where len(ids) > 0""",
    "last_modified_lookup": with_("cell_urls", "admitted", "qi_read") + """select c.url, q.last_modified
        from (select distinct url from cell_urls) c join admitted a on a.url = c.url
        left join qi_read q on q.url = c.url""",
    "crawl_tally": with_("qi_read") + """select index_url, count(*)::BIGINT as listed,
        (count(*) - count(*) filter (where s.status in (301, 302, 303)))::BIGINT as processed,
        (count(*) filter (where s.status in (301, 302, 303)))::BIGINT as ignored
        from qi_read q join site_pages s on s.url = q.url group by index_url
        union all select '""" + IDX_EMPTY + """', 0, 0, 0""",
    "unique_domains_run": with_("dom") + """select distinct unnest(origins) as origin from dom""",
    "unique_domains": with_("dom", "qi_read") + """select distinct q.family, o as origin
        from (select url, unnest(origins) as o from dom) d join qi_read q on q.url = d.url""",
    # operator forms (listing = every page of the site)
    "known_block_filter": with_("cls_d") + f"""select url, token as block
        from (select url, unnest(toks) as token from cls_d) where list_contains({VOCAB}, token)""",
    "brand_link_filter": with_("hrefs") + f"""select url, h as href
        from (select url, unnest(hs) as h from hrefs) where {_brand('h')}""",
    # p, meta and img hold no other element here; all else is balanced
    "extract_elements": with_("admitted") + """, tokens as (
          select url, t, ts[t] as tok from (select url, ts, generate_subscripts(ts, 1) as t from (
            select url, regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'g'),
              '(<script>).*?(</script>)', '\\1\\2', 'g'), '</?[a-zA-Z][^>]*>', 0) as ts from admitted))),
        tags as (select url, t, lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) as tag, tok[2] = '/' as ends from tokens),
        steps as (select *, sum(case when tag in ('p', 'meta', 'img') then 0 when ends then -1 else 1 end)
                    over (partition by url order by t) - (case when ends or tag in ('p', 'meta', 'img') then 0 else 1 end) as depth
                  from tags where tag not in ('b', 'br')),
        starts as (select url, tag, depth, row_number() over (partition by url order by t) as n from steps where not ends)
        select c.url, c.n::BIGINT as n, p.n::BIGINT as parent_n, c.tag
        from starts c asof left join starts p on p.url = c.url and p.depth = c.depth - 1 and p.n < c.n""",
    "variant_name": with_("blk") + "select url, variant from blk",
    "join_links": with_("hrefs") + f"select url, {_join_links('hs')} as href_links from hrefs where len(hs) > 0",
    "split_star": with_("hrefs") + """select url, unnest(list_filter(regexp_split_to_array(h, '[*]+'),
        lambda x: x <> '')) as part from (select url, unnest(hs) as h from hrefs)""",
    "block_matrix": with_("cls_d", "site_pages") + f"""select l.url,
       {VOCAB_COLS}
from (select url from site_pages) l
left join (select url, tok, count(*) as n from (select url, unnest(toks) as tok from cls_d) group by all) c
  on c.url = l.url
group by l.url""",
    "block_variant_layout_report": block_report("site_pages", "select url from site_pages", None),
    "brand_links_report": with_("hrefs") + f"""select h.url,
        {_join_links(_dedupe(f"list_filter(hs, lambda x: {_brand('x')})"))} as href_links from hrefs h""",
    "link_rows": with_("hrefs") + f"""select p.url, (p.i - 1)::BIGINT as i, (p.j - 1)::BIGINT as j,
        p.parts[p.j] as link
        from (select url, i, parts, generate_subscripts(parts, 1) as j
              from (select url, i, list_filter(regexp_split_to_array(kept[i], '[*]+'), lambda x: x <> '') as parts
                    from (select url, kept, generate_subscripts(kept, 1) as i
                          from (select url, {_dedupe('hs')} as kept from hrefs)))) p""",
    "page_domain_report": with_("dom") + f"""select url, {_join_links('kept')} as href_links,
        {_join_links('brand')} as brand_domains, {_join_links('non_brand')} as non_brand_domains from dom""",
    "media_report": with_("media") + """select 'site' as sheet, url,
        '[' || array_to_string(ids, ', ') || ']' as template_ids from media where len(ids) > 0""",
    "write_report": with_("hrefs", "cell_urls") + f"""select h.url as "URL",
        {_join_links(f"list_filter(hs, lambda x: {_brand('x')})")} as "HREF LINKS"
        from hrefs h where h.url in (select url from cell_urls)""",
    "write_report_by_sheet": with_("media", "cell_urls") + """select distinct c.sheet, m.url as "Url",
        '[' || array_to_string(m.ids, ', ') || ']' as "Template Ids"
        from media m join cell_urls c on c.url = m.url where len(m.ids) > 0""",
    # whole reports
    "report_block_matrix": with_("cls_d", "cell_urls") + f"""select l.url,
       {VOCAB_COLS}
from (select distinct url from cell_urls) l
left join (select url, tok, count(*) as n from (select url, unnest(toks) as tok from cls_d) group by all) c
  on c.url = l.url
group by l.url""",
    "report_blocks_from_cells": block_report("cell_urls", "select url from cell_urls",
                                             "select url, last_modified from qi_read", "qi_read"),
    "report_blocks_from_index": block_report("qi_read", "select url from qi_read",
                                             "select url, last_modified from qi_read"),
    "report_blocks_from_sitemap": block_report("sm_map", "select url from sm_map",
                                               "select url, lastmod as last_modified from sm_map"),
    "report_brand_links_all": with_("hrefs", "cell_urls") + f"""select h.url,
        {_join_links(f"list_filter(hs, lambda x: {_brand('x')})")} as href_links
        from hrefs h where h.url in (select url from cell_urls)""",
    "report_brand_links": with_("hrefs", "qi_read") + f"""select h.url,
        {_join_links(_dedupe(f"list_filter(hs, lambda x: {_brand('x')})"))} as href_links
        from hrefs h where h.url in (select url from qi_read)""",
    "report_links": with_("hrefs", "sm_items") + f"""select l.url, (p.i - 1)::BIGINT as i, (p.j - 1)::BIGINT as j,
        p.parts[p.j] as link
        from sm_items l join (
          select url, i, parts, generate_subscripts(parts, 1) as j
          from (select url, i, list_filter(regexp_split_to_array(kept[i], '[*]+'), lambda x: x <> '') as parts
                from (select url, kept, generate_subscripts(kept, 1) as i
                      from (select url, {_dedupe('hs')} as kept from hrefs)))) p on p.url = l.url""",
    "report_domains_from_index": with_("dom", "qi_read") + f"""select url, {_join_links('kept')} as href_links,
        {_join_links('brand')} as brand_domains, {_join_links('non_brand')} as non_brand_domains
        from dom where url in (select url from qi_read)""",
    "report_domains_from_sitemap": with_("dom", "site_pages") + f"""select url, {_join_links('kept')} as href_links,
        {_join_links('brand')} as brand_domains, {_join_links('non_brand')} as non_brand_domains
        from dom where url in (select url from site_pages)""",
    "report_media": with_("media", "cell_urls") + """select distinct c.sheet, m.url,
        '[' || array_to_string(m.ids, ', ') || ']' as template_ids
        from media m join cell_urls c on c.url = m.url where len(m.ids) > 0""",
}
ORACLES["read_sitemap_files"] = ORACLES["read_sitemap_urls"]  # another way to the same rows
