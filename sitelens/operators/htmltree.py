"""Per-page HTML tree pass used by the element extraction.

This is the one piece of per-row Python in the library: it turns one page's
markup into a flat list of elements, pre-order numbered, so that every later
step (class tokens, blocks, links, sections, layouts) is a native Spark
expression over the element table.

Tree rules follow the HTML living standard for documents without frames and
templates: void elements, raw text of script/style, implied html/head/body, implied
end tags, scopes, and

* formatting elements (``b``, ``a``, ``font``, ...) that are left open are opened
  again, with their attributes, where text goes on in the next block; an end tag in
  the wrong order moves what lies between (the standard's adoption agency), and an
  ``a`` ends an open ``a``. At most the innermost ``REOPENED`` are opened again at a
  time, so that a page can't grow by the product of its tags, and only the last
  ``LOOKED_BACK`` are compared;
* tables: ``tbody``, ``tr`` and ``colgroup`` are implied, cells and rows end each
  other, cell tags outside a table are ignored, and other content of a table goes
  before it, into the table's parent (foster parenting).

A tag that closes itself (``/>``) is an element without content, whatever its name.
Attributes of a repeated ``html`` or ``body`` tag are added where they are not yet
present. Quotes open an attribute value only right after ``=``; a value whose quote
is never closed ends at the tag's ``>``.

The pass is linear in the markup: where a tag or a scope's end was last opened is
kept, not searched.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noscript script style template title".split())
# Block elements whose start ends an open p, and whose end ends what they hold.
BLOCKS = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer header hgroup listing main menu nav ol pre search section summary ul"
).split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset((
    "address applet area article aside base basefont bgsound blockquote body br button caption center "
    "col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu "
    "meta nav noembed noframes noscript object ol p param plaintext pre script search section select source "
    "style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
).split())
SCOPE_STOP = frozenset("applet caption html table td th marquee object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
TABLE_BODIES = frozenset("tbody tfoot thead".split())
CELLS = frozenset("td th".split())
# Elements that take no content of their own: what is put there goes before the table.
FOSTERING = frozenset("table tbody tfoot thead tr".split())
MARKING = frozenset("applet marquee object".split())
# What an open element ends: the search for any tag (1), for a list item (2), a scope (4).
ENDS = {t: 1 | 2 * (t not in ("address", "div", "p")) | 4 * (t in SCOPE_STOP) for t in SPECIAL | SCOPE_STOP}
# Inserted without opening formatting elements again.
QUIET = frozenset("param source track base basefont bgsound link meta noframes script style template title hr".split())
REOPENED = 12
LOOKED_BACK = 100  # formatting elements that are looked at for one alike or an open a

_WS = re.compile(r"[ \t\n\f\r\xa0]+")
_ODD_WS = re.compile(r"[\t\n\f\r\xa0]|  ").search

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
# Elements whose content is text up to their own end tag.
RAW_TEXT = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
RCDATA = frozenset(("title", "textarea"))


class Node:
    __slots__ = ("tag", "attrs", "parent", "content", "open")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.content = []  # own text pieces and child nodes, in order
        self.open = False


class _Builder:
    def __init__(self):
        self.stack: list[Node] = []
        # the places in the stack of each open tag, of elements that end scopes, of
        # special ones, and of those that end the search for an open list item
        self.at: dict[str, list[int]] = {}
        self.stops, self.special, self.item_stops = [], [], []
        self.formatting: list[Node | None] = []  # None marks the border of a cell, caption or object
        self.mode = "body"  # or table, rows (in a tbody), row, cell, caption, columns, select
        self.html = self.head = self.body = self.form = None
        self.fostering = False

    # -- the stack ------------------------------------------------------------
    def _push(self, node):
        node.open = True
        tag, place = node.tag, len(self.stack)
        places = self.at.get(tag)
        if places is None:
            self.at[tag] = [place]
        else:
            places.append(place)
        ends = ENDS.get(tag)
        if ends:
            self.special.append(place)
            if ends & 2:
                self.item_stops.append(place)
            if ends & 4:
                self.stops.append(place)
        self.stack.append(node)

    def _pop(self):
        node = self.stack.pop()
        node.open = False
        tag = node.tag
        self.at[tag].pop()
        ends = ENDS.get(tag)
        if ends:
            self.special.pop()
            if ends & 2:
                self.item_stops.pop()
            if ends & 4:
                self.stops.pop()
        return tag

    def _pop_to(self, place):
        """Close the element at ``place`` and all in it; never the root."""
        if place > 0:
            while len(self.stack) > place:
                self._pop()

    def _restacked(self, stack):
        """Another stack of open elements."""
        for node in self.stack:
            node.open = False
        self.stack, self.at = [], {}
        self.stops, self.special, self.item_stops = [], [], []
        for node in stack:
            self._push(node)

    def _last(self, tag):
        """Place of the innermost open ``tag``, -1 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def _in_scope(self, tag, *others):
        """Place of the innermost open ``tag`` if no scope ends after it (nor one of
        the tags ``others``), else -1."""
        place = self._last(tag)
        if place < 0 or self.stops and self.stops[-1] > place or any(self._last(x) > place for x in others):
            return -1
        return place

    def _in_table(self, tag):
        """Place of the innermost open ``tag`` if it is within the innermost table."""
        place = self._last(tag)
        return place if place >= self._last("table") else -1

    def _imply_ends(self, but=None):
        while self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != but:
            self._pop()

    # -- insertion --------------------------------------------------------------
    def _put(self, thing, target=None):
        """Put a node or text into ``target`` (the current node), or before the
        innermost table where content doesn't belong into it."""
        target = target or self.stack[-1]
        if self.fostering and target.tag in FOSTERING:
            place = self._last("table")
            if place >= 0:
                table = self.stack[place]
                if table.parent is not None:
                    target = table.parent
                    spot = len(target.content) - 1
                    while target.content[spot] is not table:
                        spot -= 1
                    target.content.insert(spot, thing)
                    if isinstance(thing, Node):
                        thing.parent = target
                    return
                target = self.stack[place - 1]
        target.content.append(thing)
        if isinstance(thing, Node):
            thing.parent = target

    def _insert(self, tag, attrs, closed=False):
        top = self.stack[-1]
        node = Node(tag, attrs, top)
        if self.fostering and top.tag in FOSTERING:
            self._put(node)
        else:
            top.content.append(node)
        if not closed and tag not in VOID:
            self._push(node)
        return node

    def _ensure_html(self):
        if self.html is None:
            self.html = Node("html", {}, None)
            self._push(self.html)

    def _add_attrs(self, node, amap):
        for k, v in amap.items():
            node.attrs.setdefault(k, v)

    def _ensure_head(self):
        if self.head is None:
            self.head = Node("head", {}, None)
            self._put(self.head)

    def _ensure_body(self):
        if self.body is None:
            self._ensure_html()
            self._pop_to(1)  # leave the head
            self._ensure_head()
            self.body = self._insert("body", {})

    # -- formatting elements ----------------------------------------------------
    def _remember(self, node):
        """A formatting element was opened: at most three alike are remembered."""
        alike = []
        for i in range(len(self.formatting) - 1, max(-1, len(self.formatting) - 1 - LOOKED_BACK), -1):
            other = self.formatting[i]
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                alike.append(i)
        if len(alike) >= 3:
            del self.formatting[alike[2]]
        self.formatting.append(node)

    def _to_border(self):
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _reopen(self):
        """Open the formatting elements again that ended with their block."""
        last = self.formatting[-1] if self.formatting else None
        if last is None or last.open:
            return
        first = len(self.formatting)
        while first and self.formatting[first - 1] is not None and not self.formatting[first - 1].open \
                and len(self.formatting) - first < REOPENED:
            first -= 1
        for i in range(first, len(self.formatting)):
            node = self.formatting[i]
            self.formatting[i] = self._insert(node.tag, dict(node.attrs))

    def _adopt(self, tag):
        """The end of a formatting element, whatever has been opened since. True if
        it is no such element and ends like any other."""
        top = self.stack[-1]
        if top.tag == tag and not any(x is top for x in reversed(self.formatting)):
            self._pop()
            return False
        for _ in range(8):
            at = len(self.formatting) - 1
            while at >= 0 and self.formatting[at] is not None and self.formatting[at].tag != tag:
                at -= 1
            if at < 0 or self.formatting[at] is None:
                return True
            element = self.formatting[at]
            if not element.open:
                del self.formatting[at]
                return False
            place = len(self.stack) - 1
            while self.stack[place] is not element:
                place -= 1
            if self.stops and self.stops[-1] > place:
                return False
            if self.special[-1] < place:
                self._pop_to(place)
                del self.formatting[at]
                return False
            for p in reversed(self.special):  # the outermost special element inside
                if p < place:
                    break
                block = p
            stack = list(self.stack)
            furthest, above = stack[block], stack[place - 1]
            last, bookmark, i, count = furthest, None, block, 0
            while True:
                i -= 1
                count += 1
                node = stack[i]
                if node is element:
                    break
                entry = next((k for k in range(len(self.formatting) - 1, -1, -1) if self.formatting[k] is node), -1)
                if count > 3 and entry >= 0:
                    del self.formatting[entry]
                    at -= entry < at
                    entry = -1
                if entry < 0:
                    del stack[i]
                    block -= 1
                    continue
                copy = Node(node.tag, dict(node.attrs), None)
                self.formatting[entry] = stack[i] = copy
                if last is furthest:
                    bookmark = copy
                self._move(last, copy)
                last = copy
            self._detach(last)
            fostering, self.fostering = self.fostering, True
            self._put(last, above)
            self.fostering = fostering
            copy = Node(element.tag, dict(element.attrs), furthest)
            copy.content, furthest.content = furthest.content, [copy]
            for child in copy.content:
                if isinstance(child, Node):
                    child.parent = copy
            self.formatting.remove(element)
            spot = at if bookmark is None else self.formatting.index(bookmark) + 1
            self.formatting.insert(spot, copy)
            stack.remove(element)
            stack.insert(stack.index(furthest) + 1, copy)
            self._restacked(stack)
        return False

    def _detach(self, node):
        if node.parent is not None:
            content = node.parent.content
            spot = len(content) - 1
            while content[spot] is not node:
                spot -= 1
            del content[spot]

    def _move(self, node, to):
        self._detach(node)
        to.content.append(node)
        node.parent = to

    # -- start tags -------------------------------------------------------------
    def handle_starttag(self, tag, attrs, closed=False):
        amap = {}
        for k, v in attrs:  # first of repeated attributes wins
            if k not in amap:
                amap[k] = "" if v is None else v
        if self.body is not None and self.mode == "body" and tag not in ("html", "head", "body", "image"):
            self._start_in_body(tag, amap, closed)
            return
        if tag == "html":
            known = self.html is not None
            self._ensure_html()
            self._add_attrs(self.html, amap)
            return known
        self._ensure_html()
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = self._insert("head", amap)
            return
        if tag == "body":
            self._ensure_body()
            self._add_attrs(self.body, amap)
            return
        if self.body is None and tag in HEAD_TAGS:
            self._ensure_head()
            if self.head.open:
                return self._insert(tag, amap, closed)
            node = Node(tag, amap, None)  # the head has ended, but such elements go there
            self._put(node, self.head)
            if not closed and tag not in VOID:
                self._push(node)
            return
        self._ensure_body()
        if tag == "image":
            tag = "img"
        while not self._start(tag, amap, closed):  # a mode ended: the tag is for the next one
            pass

    def _start(self, tag, amap, closed):
        mode = self.mode
        if mode == "body":
            return self._start_in_body(tag, amap, closed)
        if mode == "cell" or mode == "caption":
            if tag in TABLE_PARTS:
                if mode == "cell":
                    self._end_cell()
                else:
                    self._end_caption()
                return False
            return self._start_in_body(tag, amap, closed)
        if mode == "select":
            if tag in ("option", "optgroup"):
                if self.stack[-1].tag == "option":
                    self._pop()
                if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                    self._pop()
                self._insert(tag, amap, closed)
            elif tag in ("select", "input", "textarea", "keygen") or self._last("table") >= 0 and (tag in TABLE_PARTS or tag == "table"):
                self._end_select()
                return tag == "select"
            elif tag in ("script", "template", "hr"):
                self._insert(tag, amap, closed)
            return True
        if mode == "columns":
            if tag == "col":
                self._insert(tag, amap)
                return True
            self._pop_to(self._last("colgroup"))
            self.mode = "table"
            return False
        if mode == "row":
            if tag in CELLS:
                self._clear_to(("tr",))
                self._insert(tag, amap, closed)
                if not closed:
                    self.mode = "cell"
                    self.formatting.append(None)
                return True
            if tag in TABLE_PARTS:
                self._end_row()
                return False
        elif mode == "rows":
            if tag == "tr" or tag in CELLS:
                self._clear_to(TABLE_BODIES)
                self._insert("tr", amap if tag == "tr" else {}, closed and tag == "tr")
                if not (closed and tag == "tr"):
                    self.mode = "row"
                return tag == "tr"
            if tag in TABLE_PARTS:
                self._end_rows()
                return False
        if tag in TABLE_PARTS:  # in the table itself
            self._clear_to(("table",))
            if tag == "caption":
                self._insert(tag, amap, closed)
                if not closed:
                    self.mode = "caption"
                    self.formatting.append(None)
                return True
            if tag == "col" or tag == "colgroup":
                self._insert("colgroup", amap if tag == "colgroup" else {}, closed and tag == "colgroup")
                if not (closed and tag == "colgroup"):
                    self.mode = "columns"
                return tag == "colgroup"
            own = tag in TABLE_BODIES
            self._insert(tag if own else "tbody", amap if own else {}, closed and own)
            if not (closed and own):
                self.mode = "rows"
            return own
        if tag == "table":
            self._end_table()
            return False
        if tag in ("style", "script", "template") or tag == "input" and amap.get("type", "").lower() == "hidden":
            self._insert(tag, amap, closed)
            return True
        if tag == "form":
            if self.form is None:
                self.form = self._insert(tag, amap, True)
            return True
        self.fostering = True
        done = self._start_in_body(tag, amap, closed)
        self.fostering = False
        return done

    def _close_p(self):
        if self.at.get("p"):
            place = self._in_scope("p", "button")
            if place >= 0:
                self._pop_to(place)

    def _start_in_body(self, tag, amap, closed):
        if tag in BLOCKS:
            self._close_p()
        elif tag in FORMATTING:
            if tag == "a" or tag == "nobr":
                if tag == "a":
                    open_a = None
                    for node in reversed(self.formatting[-LOOKED_BACK:]):
                        if node is None:
                            break
                        if node.tag == "a":
                            open_a = node
                            break
                    if open_a is not None:
                        self._adopt("a")
                        self.formatting = [x for x in self.formatting if x is not open_a]
                        if open_a.open:
                            self._restacked([x for x in self.stack if x is not open_a])
                elif self._in_scope("nobr") >= 0:
                    self._adopt("nobr")
            self._reopen()
            node = self._insert(tag, amap, closed)
            if not closed:
                self._remember(node)
            return True
        elif tag == "p":
            self._close_p()
        elif tag in HEADINGS:
            self._close_p()
            if self.stack[-1].tag in HEADINGS:
                self._pop()
        elif tag == "li" or tag == "dd" or tag == "dt":
            place = self._last("li") if tag == "li" else max(self._last("dd"), self._last("dt"))
            if place >= 0 and self.item_stops[-1] <= place:
                self._pop_to(place)
            self._close_p()
        elif tag in TABLE_PARTS or tag == "frame" or tag == "frameset":
            return True  # only within a table
        elif tag == "table":
            self._close_p()
            self._insert(tag, amap, closed)
            if not closed:
                self.mode = "table"
            return True
        elif tag == "form":
            if self.form is not None:
                return True
            self._close_p()
            self.form = self._insert(tag, amap, closed)
            if closed:
                self.form = None
            return True
        elif tag == "select":
            self._reopen()
            self._insert(tag, amap, closed)
            if not closed:
                self.mode = "select"
            return True
        elif tag == "option" or tag == "optgroup":
            if self.stack[-1].tag == "option":
                self._pop()
            self._reopen()
        elif tag == "button":
            place = self._in_scope("button")
            if place >= 0:
                self._pop_to(place)
            self._reopen()
        elif tag in MARKING:
            self._reopen()
            self._insert(tag, amap, closed)
            if not closed:
                self.formatting.append(None)
            return True
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self._in_scope("ruby") >= 0:
                self._imply_ends("rtc" if tag in ("rp", "rt") else None)
        elif tag == "hr" or tag == "xmp" or tag == "plaintext":
            self._close_p()
            if tag == "xmp":
                self._reopen()
        elif tag not in QUIET and tag not in ("textarea", "iframe", "noembed"):
            self._reopen()
        self._insert(tag, amap, closed)
        return True

    # -- the ends of table parts --------------------------------------------------
    def _clear_to(self, tags):
        while self.stack[-1].tag not in tags and len(self.stack) > 1:
            self._pop()

    def _end_cell(self):
        self._pop_to(max(self._in_table("td"), self._in_table("th")))
        self._to_border()
        self.mode = "row"

    def _end_caption(self):
        self._pop_to(self._in_table("caption"))
        self._to_border()
        self.mode = "table"

    def _end_row(self):
        self._pop_to(self._in_table("tr"))
        self.mode = "rows"

    def _end_rows(self):
        self._pop_to(max(map(self._in_table, TABLE_BODIES)))
        self.mode = "table"

    def _end_table(self):
        self._pop_to(self._last("table"))
        self._set_mode()

    def _end_select(self):
        self._pop_to(self._last("select"))
        self._set_mode()

    def _set_mode(self):
        """The mode that the open elements call for."""
        inner = {"select": "select", "td": "cell", "th": "cell", "tr": "row", "tbody": "rows", "thead": "rows", "tfoot": "rows",
                 "caption": "caption", "colgroup": "columns", "table": "table"}
        place, tag = max((self._last(t), t) for t in inner)
        self.mode = inner[tag] if place >= 0 else "body"

    # -- end tags -----------------------------------------------------------------
    def handle_endtag(self, tag):
        if tag in ("html", "body") or not self.stack:
            return
        if self.body is not None and self.mode == "body" and tag != "head":
            self._end_in_body(tag)
            return
        if tag == "head":
            if self.stack[-1] is self.head:
                self._pop()
            return
        if self.body is None:
            if tag in HEAD_TAGS:
                if self._last(tag) == len(self.stack) - 1:
                    self._pop()
                return
            if tag != "br":
                return
            self._ensure_body()
        while not self._end(tag):
            pass

    def _end(self, tag):
        mode = self.mode
        if mode == "body":
            self._end_in_body(tag)
            return True
        if mode == "select":
            if tag == "select":
                self._end_select()
            elif tag == "option" or tag == "optgroup":
                if tag == "optgroup" and self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
                    self._pop()
                if self.stack[-1].tag == tag:
                    self._pop()
            elif tag == "script" or tag == "template":
                if self.stack[-1].tag == tag:
                    self._pop()
            elif (tag == "table" or tag in TABLE_PARTS) and self._in_table(tag) >= 0:
                self._end_select()
                return False
            return True
        if mode == "cell" or mode == "caption":
            if mode == "cell" and tag in CELLS:
                if self._in_table(tag) >= 0:
                    self._pop_to(self._in_table(tag))
                    self._to_border()
                    self.mode = "row"
            elif mode == "caption" and tag == "caption":
                self._end_caption()
            elif tag == "table" or mode == "cell" and (tag in TABLE_BODIES or tag == "tr"):
                if self._in_table(tag) >= 0:
                    if mode == "cell":
                        self._end_cell()
                    else:
                        self._end_caption()
                    return False
            elif tag not in TABLE_PARTS:
                self._end_in_body(tag)
            return True
        if mode == "columns":
            if tag != "col":
                self._pop_to(self._last("colgroup"))
                self.mode = "table"
            return tag == "colgroup" or tag == "col"
        if tag == "table":
            self._end_table()
        elif mode == "row" and tag == "tr":
            self._end_row()
        elif mode == "row" and tag in TABLE_BODIES:
            if self._in_table(tag) >= 0:
                self._end_row()
                return False
        elif mode == "rows" and tag in TABLE_BODIES:
            if self._in_table(tag) >= 0:
                self._end_rows()
        elif tag not in TABLE_PARTS:
            self.fostering = True
            self._end_in_body(tag)
            self.fostering = False
        return True

    def _end_in_body(self, tag):
        if tag in BLOCKS or tag == "button":
            place = self._in_scope(tag)
            if place >= 0:
                self._pop_to(place)
        elif tag in FORMATTING:
            if self._adopt(tag):
                self._end_any(tag)
        elif tag == "p":
            if self._in_scope("p", "button") < 0:
                self._insert("p", {})
            self._close_p()
        elif tag == "li":
            place = self._in_scope("li", "ol", "ul")
            if place >= 0:
                self._pop_to(place)
        elif tag == "dd" or tag == "dt":
            place = self._in_scope(tag)
            if place >= 0:
                self._pop_to(place)
        elif tag in HEADINGS:
            place = max(map(self._in_scope, HEADINGS))
            if place >= 0:
                self._pop_to(place)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node.open and self._in_scope("form") >= 0:
                self._imply_ends()
                if self.stack[-1] is node:
                    self._pop()
                else:
                    self._restacked([x for x in self.stack if x is not node])
        elif tag in MARKING:
            place = self._in_scope(tag)
            if place >= 0:
                self._pop_to(place)
                self._to_border()
        elif tag == "br":  # </br> is treated as <br>
            self._reopen()
            self._insert("br", {})
        else:
            self._end_any(tag)

    def _end_any(self, tag):
        """An end tag closes its element unless a special one was opened in it."""
        place = self._last(tag)
        if place > 0 and (self.special[-1] <= place):
            self._pop_to(place)

    # -- tokenizer ----------------------------------------------------------
    def _attributes(self, html, pos, unclosed):
        """(end of the tag, attributes, closes itself) from after the tag name;
        attributes are None for a cut-off tag.
        ``unclosed`` collects the quotes known not to occur any more."""
        attrs, n = [], len(html)
        while True:
            m = _ATTR_NAME.match(html, pos)
            if m is None:
                end = html.find(">", pos)
                if end < 0:  # cut off by the end of the page: no tag
                    return n, None, False
                return end + 1, attrs, html[pos:end].endswith("/")
            name, pos, value = m.group(1), m.end(), None
            if m.group(2):
                quote = html[pos:pos + 1]
                if quote == '"' or quote == "'":
                    end = -1 if quote in unclosed else html.find(quote, pos + 1)
                    if end < 0:
                        unclosed.add(quote)
                        end = html.find(">", pos)
                        end = n if end < 0 else end
                        value, pos = html[pos + 1:end], end
                    else:
                        value, pos = html[pos + 1:end], end + 1
                else:
                    end = _UNQUOTED.match(html, pos).end()
                    value, pos = html[pos:end], end
                if "&" in value:
                    value = unescape(value)
            attrs.append((name.lower(), value))

    def run(self, html: str) -> None:
        pos, n, unclosed = 0, len(html), set()
        find, name_at = html.find, _NAME.match
        while pos < n:
            lt = find("<", pos)
            if lt != pos:
                text = html[pos:n if lt < 0 else lt]
                self.handle_data(unescape(text) if "&" in text else text)
                if lt < 0:
                    return
            pos = lt
            mark = html[pos + 1:pos + 2]
            if mark == "!" or mark == "?":
                comment = html.startswith("<!--", pos)
                end = find("-->", pos + 2) + 3 if comment else find(">", pos) + 1
                pos = end if end > (2 if comment else 0) else n
                continue
            m = name_at(html, pos + 2 if mark == "/" else pos + 1)
            if m is None:
                if mark == "/":  # not a name: a bogus comment
                    pos = find(">", pos) + 1 or n
                else:
                    self.handle_data("<")
                    pos += 1
                continue
            tag = m.group(0).lower()
            if mark == "/":
                pos = find(">", m.end()) + 1 or n
                self.handle_endtag(tag)
                continue
            if html[m.end():m.end() + 1] == ">":
                pos, attrs, closed = m.end() + 1, [], False
            else:
                pos, attrs, closed = self._attributes(html, m.end(), unclosed)
                if attrs is None:
                    return
            self.handle_starttag(tag, attrs, closed)
            if not closed and (tag in RAW_TEXT or tag in RCDATA):
                close = re.compile(r"</" + tag + r"[\s/>]", re.I).search(html, pos)
                text = html[pos:close.start() if close else n]
                if text:
                    self.handle_data(unescape(text) if tag in RCDATA and "&" in text else text)
                pos = (find(">", close.start()) + 1 or n) if close else n
                self.handle_endtag(tag)

    def handle_data(self, data):
        if not data:
            return
        if self.body is None:
            top = self.stack[-1].tag if self.stack else None
            if top not in HEAD_TAGS:
                if not data.strip():
                    return
                self._ensure_body()
        t = self.stack[-1].tag
        if t in RAW_TEXT:
            return  # data of script/style is not own text
        if self.body is not None and t not in RCDATA and (self.formatting or self.mode != "body"):
            if self.mode in ("table", "rows", "row", "columns") and (t in FOSTERING or t == "colgroup"):
                if data.strip():
                    if self.mode == "columns":
                        self._pop_to(self._last("colgroup"))
                        self.mode = "table"
                    self.fostering = True
                    self._reopen()
                    self._put(data)
                    self.fostering = False
                    return
            elif self.mode != "select":
                self._reopen()
        self.stack[-1].content.append(data)


def _own_text(content) -> str:
    out = []
    for p in content:
        if p.__class__ is str:
            s = _WS.sub(" ", p) if _ODD_WS(p) else p
            if out and out[-1].endswith(" ") and s.startswith(" "):
                s = s[1:]
            out.append(s)
        elif p.tag == "br":
            if out and not out[-1].endswith(" "):
                out.append(" ")
    return "".join(out).strip(" ")


def _in_order(root: Node):
    """(nodes in pre-order, place of each one's parent, depth of each, last place
    within each)."""
    nodes, parents, depths = [], [], []
    todo = [(root, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        place = len(nodes)
        nodes.append(node)
        parents.append(parent)
        depths.append(depth)
        for child in reversed(node.content):
            if child.__class__ is Node:
                todo.append((child, place, depth + 1))
    end = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        if end[i] > end[parents[i]]:
            end[parents[i]] = end[i]
    return nodes, parents, depths, end


def parse_elements(html: str, labels=("Desktop", "Mobile"), keep_terms=None):
    """Return one tuple per element, in pre-order.

    Tuple: (pre, end, parent_pre, parent_end, depth, tag, attrs, own_text,
    n_children, chain_labels). The parent of the root is -1 and its interval
    the whole page. ``chain_labels`` holds the labels found by the
    layout descent under the element: its children are scanned in order; a
    child whose own text equals the label ignoring case is a hit; otherwise
    the first child that has children is descended into and its answer is
    final.

    ``keep_terms`` (a tuple of strings) selects the rows the reports read:
    the root, elements with an attribute named ``class...`` or ``href...``,
    and elements whose own text contains one of the terms. Every element is
    still numbered, so intervals and parents stay exact. None keeps all.
    """
    b = _Builder()
    b.run(html or "")
    b._ensure_body()  # html, head and body always exist
    nodes, parents, depths, end = _in_order(b.html)
    n = len(nodes)
    children: list[list[int]] = [[] for _ in nodes]
    for i in range(1, n):
        children[parents[i]].append(i)
    own = [_own_text(x.content) if x.content else "" for x in nodes]
    lab_l = [lb.lower() for lb in labels]
    # hit[i][k]: the descent from i finds label k; children have larger pre,
    # so one reverse sweep computes it bottom-up.
    hit = [None] * n
    none = [False] * len(lab_l)
    for i in range(n - 1, -1, -1):
        if not children[i]:
            hit[i] = none
            continue
        row = []
        for k, lb in enumerate(lab_l):
            res = False
            for c in children[i]:
                o = own[c]
                if len(o) == len(lb) and o.lower() == lb:
                    res = True
                    break
                if children[c]:
                    res = hit[c][k]
                    break
            row.append(res)
        hit[i] = row
    out = []
    for i, x in enumerate(nodes):
        if keep_terms is not None and i > 0 \
                and not (x.attrs and any(k.startswith(("class", "href")) for k in x.attrs)) \
                and not any(t in own[i] for t in keep_terms):
            continue
        p = parents[i]
        out.append((
            i, end[i], p, end[max(p, 0)], depths[i], x.tag, x.attrs, own[i],
            len(children[i]), [] if hit[i] is none else [labels[k] for k, h in enumerate(hit[i]) if h],
        ))
    return out
