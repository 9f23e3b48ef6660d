"""Golden tests for the per-page tree pass (tree rules that change results)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.operators.htmltree import parse_elements


def by_tag(els, tag):
    return [e for e in els if e[5] == tag]


def test_implied_html_head_body_and_intervals():
    els = parse_elements("<p>x</p>")
    assert [e[5] for e in els] == ["html", "head", "body", "p"]
    html, head, body, p = els
    assert html[1] == 3 and body[2] == 0 and p[2] == body[0]
    assert p[7] == "x"


def test_void_elements_do_not_nest():
    els = parse_elements('<div class="banner"><img src="a"><div>Desktop</div></div>')
    div = [e for e in els if e[6].get("class") == "banner"][0]
    assert div[8] == 2  # img and div are both children
    assert div[9] == ["Desktop"]


def test_block_start_closes_p():
    els = parse_elements("<p>a<div>b</div>")
    p, div = by_tag(els, "p")[0], by_tag(els, "div")[0]
    assert div[2] == p[2]  # siblings under body
    assert p[7] == "a"


def test_li_closes_li_and_p_closes_p():
    els = parse_elements("<ul><li>a<li>b</ul><p>x<p>y")
    lis = by_tag(els, "li")
    assert len(lis) == 2 and lis[0][2] == lis[1][2]
    ps = by_tag(els, "p")
    assert ps[0][2] == ps[1][2]


def test_script_and_style_text_is_not_own_text():
    els = parse_elements('<div><script>var t="</p>";</script>hi<style>p{}</style></div>')
    assert by_tag(els, "div")[0][7] == "hi"


def test_attributes_first_wins_lower_case_and_entities():
    els = parse_elements('<a HREF="/x?a=1&amp;b=2" href="/y" Class="C">t&amp;u</a>')
    a = by_tag(els, "a")[0]
    assert a[6]["href"] == "/x?a=1&b=2"
    assert a[6]["class"] == "C"
    assert a[7] == "t&u"


def test_own_text_whitespace_and_br():
    els = parse_elements("<div>  a \n  b<br>c<span>no</span>  d </div>")
    assert by_tag(els, "div")[0][7] == "a b c d"


def test_stray_end_tag_is_ignored_at_special_element():
    els = parse_elements("<div><span>a</section></span>b</div>")
    div = by_tag(els, "div")[0]
    assert div[7] == "b" and div[8] == 1


def shape(html):
    """The body as nested text: tag.class(children), own text in quotes."""
    from sitelens.operators.htmltree import Node, _Builder
    b = _Builder()
    b.run(html)
    b._ensure_body()

    def show(node):
        inner = ["'" + x + "'" if x.__class__ is str else show(x) for x in node.content]
        name = ".".join([node.tag, *(str(v) for v in node.attrs.values())])
        return name + (f"({' '.join(inner)})" if inner else "")

    assert all(x.parent is b.html or x.__class__ is Node for x in b.html.content)
    return " ".join("'" + x + "'" if x.__class__ is str else show(x) for x in b.body.content)


def test_formatting_elements_are_opened_again():
    assert shape("<p><b class=x>one<p>two") == "p(b.x('one')) p(b.x('two'))"
    assert shape("<a href=1>x<div>y<a href=2>z") == "a.1('x') div(a.1('y') a.2('z'))"
    assert shape("<p>1<b>2<i>3</b>4</i>5</p>") == "p('1' b('2' i('3')) i('4') '5')"
    assert shape("<b>1<p>2</b>3</p>") == "b('1') p(b('2') '3')"
    assert shape("<p><b><b><b><b><p>x") == "p(b(b(b(b)))) p(b(b(b('x'))))"
    assert shape("<a><p>X<a>Y</a>Z</p></a>") == "a p(a('X') a('Y') 'Z')"
    assert shape("<p id=a><b><p id=b></b>TEST") == "p.a(b) p.b('TEST')"
    assert shape("<font><p>hello<b>cruel</font>world") == "font p(font('hello' b('cruel')) b('world'))"
    assert shape("<i>A<b>B<p></i>C</b>D") == "i('A' b('B')) b p(b(i 'C') 'D')"
    assert shape("<b>a<div>b<div>c</b>d") == "b('a') div(b('b') div(b('c') 'd'))"
    assert shape("<nobr>a<nobr>b") == "nobr('a') nobr('b')"
    assert shape("<b><object>a</object>c</b>d") == "b(object('a') 'c') 'd'"
    assert shape("<b>a<object>b</b>c") == "b('a' object('bc'))".replace("'bc'", "'b' 'c'")
    assert shape("x</p>y") == "'x' p 'y'" and shape("</p>y") == "'y'"
    assert shape("<h1>a<h2>b</h1>c") == "h1('a') h2('b') 'c'"


def test_tables_and_what_does_not_belong_in_them():
    assert shape("<table><div class=x>y</div><tr><td>1") == "div.x('y') table(tbody(tr(td('1'))))"
    assert shape("<table><b><tr><td>aaa</td></tr>bbb</table>ccc") == "b b('bbb') table(tbody(tr(td('aaa')))) b('ccc')"
    assert shape("<table><a>1<p>2</a>3</p>") == "a('1') p(a('2') '3') table"
    assert shape("<a>x<table><td><a>y") == "a('x' table(tbody(tr(td(a('y'))))))"
    assert shape("<a><table><td><a><table></table><a></tr><a></table><b>X</b>C<a>Y") == (
        "a(a table(tbody(tr(td(a(table) a))))) a(b('X') 'C') a('Y')")
    assert shape("<a href=blah>aba<table><a href=foo>br<tr><td></td></tr>x</table>aoe") == (
        "a.blah('aba' a.foo('br') a.foo('x') table(tbody(tr(td)))) a.foo('aoe')")
    assert shape("<a href=blah>aba<table><tr><td><a href=foo>br</td></tr>x</table>aoe") == (
        "a.blah('aba' 'x' table(tbody(tr(td(a.foo('br'))))) 'aoe')")
    assert shape("<b><table><td><i></table>z") == "b(table(tbody(tr(td(i)))) 'z')"
    assert shape("<table><caption>c<tr><th>h<td>d</table>e") == "table(caption('c') tbody(tr(th('h') td('d')))) 'e'"
    assert shape("<table><col><colgroup class=g><col>x<tr><td>1") == "'x' table(colgroup(col) colgroup.g(col) tbody(tr(td('1'))))"
    assert shape("<table><thead><tr><td>a<tfoot><td>b<tbody>") == "table(thead(tr(td('a'))) tfoot(tr(td('b'))) tbody)"
    assert shape("<table><td>a<table><td>b</table>c</table>d") == "table(tbody(tr(td('a' table(tbody(tr(td('b')))) 'c')))) 'd'"
    assert shape("<table>a<table>b") == "'a' table 'b' table"
    assert shape("<div><td class=x>a</td><tr>b</div>") == "div('a' 'b')"
    assert shape("<table> <input type=hidden><input><style>p</style></table>") == "input table(' ' input.hidden style)"
    assert shape("<table><tr></td></div><li>x</table>") == "li('x') table(tbody(tr))"
    assert shape("<p>a<table><td>b</p>c") == "p('a') table(tbody(tr(td('b' p 'c'))))"


def test_forms_lists_and_selects():
    assert shape("<form>a<form>b</form>c</form>d") == "form('a' 'b') 'c' 'd'"
    assert shape("<form><div></form>a</div>b") == "form(div('a')) 'b'"
    assert shape("<select><b><option>x<select><option></b></select>X") == "select(option('x')) option('X')"
    assert shape("<select><option>a<optgroup><option>b</select>c") == "select(option('a') optgroup(option('b'))) 'c'"
    assert shape("<table><td><select><option>a<td>b") == "table(tbody(tr(td(select(option('a'))) td('b'))))"
    assert shape("<ul><li>a<div><li>b</ul>c") == "ul(li('a' div) li('b')) 'c'"
    assert shape("<ul><li>a<ul><li>b</li></ul><li>c") == "ul(li('a' ul(li('b'))) li('c'))"
    assert shape("<dl><dt>a<dd>b<dt>c") == "dl(dt('a') dd('b') dt('c'))"
    assert shape("<button>a<p>b<button>c") == "button('a' p('b')) button('c')"
    assert shape("<ruby>a<rt>b<rp>c</ruby>d") == "ruby('a' rt('b') rp('c')) 'd'"


def test_chain_descends_into_first_non_leaf_child_only():
    # the descent enters the first child that has children and never returns
    els = parse_elements('<div class="cards"><p>x</p><div><i>desktop</i></div><div>mobile</div></div>')
    cards = [e for e in els if e[6].get("class") == "cards"][0]
    assert cards[9] == ["Desktop"]


def test_chain_leaf_match_before_non_leaf_and_case():
    els = parse_elements('<div class="steps"><div>Mobile</div><div>desktop</div></div>')
    steps = [e for e in els if e[6].get("class") == "steps"][0]
    assert steps[9] == ["Desktop", "Mobile"]
    els = parse_elements('<div class="b"><div><span>MOBILE</span></div></div>')
    b = [e for e in els if e[6].get("class") == "b"][0]
    assert b[9] == ["Mobile"]


def test_chain_own_text_must_equal_whole_label():
    els = parse_elements('<div class="b"><div>Desktop x</div></div>')
    assert [e for e in els if e[6].get("class") == "b"][0][9] == []


TAGS = ["div", "p", "span", "ul", "li", "b", "i", "section", "a", "br", "img", "table", "tr", "td", "tbody", "caption", "col", "select",
        "option", "form", "button", "object", "h1", "dd", "head", "body", "title", "input", "nobr"]


@st.composite
def html_docs(draw):
    parts = draw(st.lists(st.one_of(
        st.sampled_from(TAGS).map(lambda t: f"<{t}>"),
        st.sampled_from(TAGS).map(lambda t: f"</{t}>"),
        st.sampled_from(["x", " y ", "Desktop", "&amp;", "<!-- c -->"]),
    ), max_size=40))
    return "".join(parts)


@settings(max_examples=200, deadline=None)
@given(html_docs())
def test_intervals_nest(doc):
    els = parse_elements(doc)
    assert [e[0] for e in els] == list(range(len(els)))
    for e in els:
        pre, end, parent, parent_end = e[0], e[1], e[2], e[3]
        assert pre <= end < len(els)
        if parent >= 0:
            p = els[parent]
            assert p[0] < pre and end <= p[1] and parent_end == p[1]
            assert e[4] == p[4] + 1
    # children counts agree with parent pointers
    for e in els:
        assert e[8] == sum(1 for c in els if c[2] == e[0])


def test_quotes_open_a_value_only_after_an_equals_sign():
    els = parse_elements("""<div class=banner data-t=Don't><p>x</p></div><a href="/x">it's</a>""")
    assert by_tag(els, "div")[0][6] == {"class": "banner", "data-t": "Don't"}
    assert by_tag(els, "p")[0][7] == "x" and by_tag(els, "a")[0][6] == {"href": "/x"}
    els = parse_elements("<div class=banner data-t=Don't><p>x</p></div>")
    assert by_tag(els, "div")[0][6]["class"] == "banner"
    els = parse_elements('<a href="/x>foo</a>')  # a quote that is never closed ends with the tag
    assert by_tag(els, "a")[0][6] == {"href": "/x"} and by_tag(els, "a")[0][7] == "foo"
    els = parse_elements("""<a title='a > b' href=/y data-q="1" x/>t""")
    assert by_tag(els, "a")[0][6] == {"title": "a > b", "href": "/y", "data-q": "1", "x": ""}


def test_a_tag_that_closes_itself_has_no_content():
    els = parse_elements('<div class="banner"><svg class="icon"/><div>Desktop</div></div>')
    banner, svg = by_tag(els, "div")[0], by_tag(els, "svg")[0]
    assert banner[8] == 2 and svg[8] == 0 and banner[9] == ["Desktop"]
    els = parse_elements('<div class="banner"/><div class="cards">x</div><a href=/x/>y</a>')
    assert [e[2] for e in by_tag(els, "div")] == [2, 2] and by_tag(els, "div")[0][1] == by_tag(els, "div")[0][0]
    assert by_tag(els, "a")[0][6] == {"href": "/x/"} and by_tag(els, "a")[0][7] == "y"  # the slash is in the value


def test_later_body_and_html_attributes_are_added():
    els = parse_elements('text<body class="columns" id=a><html lang=en><body class=late id=b x=1>')
    assert by_tag(els, "body")[0][6] == {"class": "columns", "id": "a", "x": "1"}
    assert by_tag(els, "html")[0][6] == {"lang": "en"} and len(els) == 3


def test_scope_of_the_root_is_the_page():
    els = parse_elements('<html class="banner"><div class="section-metadata"><p>x</p></div></html>')
    assert (els[0][2], els[0][3]) == (-1, len(els) - 1)


def test_time_is_linear_in_broken_markup():
    import time
    for html in ("<a x='" * 100_000, "<div>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<a b=\"<c>" * 50_001,
                 "<div>" * 50_000 + "<dd></dd><td></td><li></li>" * 30_000,
                 "<table><b>" * 20_000, "<table>x" * 20_000, "<p><b><i><a href=x>t" * 15_000, "<table>" + "<div>x</div>" * 50_000,
                 "".join(f"<font size={i}><p>x" for i in range(3_000)), "<ul><li>a" * 30_000, "<a><p>" * 4_000,
                 "<b>" + "<p>x</b><b>" * 20_000, "<table><tr><td>" * 20_000, "<!--" * 100_000, "<" * 100_000, "</" * 100_000):
        began = time.time()
        parse_elements(html)
        assert time.time() - began < 5, html[:20]
