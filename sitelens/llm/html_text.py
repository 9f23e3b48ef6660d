"""Operator 1, main text of web pages by tree scoring.

A page is read once into a light tree of its block elements. Menus, headers,
footers, sidebars, notices, adverts, forms, comments and hidden parts are known
by element, role, class or id words and give no text, except that a part known by
its words alone comes back if it outweighs the rest of the page. Every remaining paragraph
passes points for its length and commas to the containers above it (halved from
the second on, five at most); a container's points are discounted by its link
density. The best container (its article, if it is in one) is kept with those
siblings that score a fifth of it or are long paragraphs with few links, with what
lies between these, and with headings before them (``kept_siblings``).

A block is the text between block boundaries: character references decoded,
white space runs turned into one space, trimmed; empty ones are left out. Blocks
are joined by newlines in page order.

Defined cases: null and empty html give an empty text; a page without tags is
its text; cut-off tags and comments end the page; repeated rows are each
extracted; an empty table gives no rows; other columns are not read. Reading is
linear in the page for any nesting and for broken markup.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import add_columns, python_ready, table

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/"'][^\s=>/]*|["'=][^\s=>/]*)(\s*=\s*)?""")
UNQUOTED = re.compile(r"[^\s>]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEAD = frozenset("meta link script style title base noscript template".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary address".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot tr figure details".split())
BLOCKS = PARAGRAPH | LISTS | frozenset("""html head body div section article main aside nav header footer form fieldset
    blockquote center hgroup menu dialog search template noscript button select optgroup option svg canvas object
    video audio""".split())
#: Elements that never hold text of an article.
DROPPED = frozenset("""nav aside footer form menu dialog search template noscript button select svg canvas object
    video audio head""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar
    toolbar status""".split())
#: Words of a class or id that mark something beside the article.
BESIDE = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored
    promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget footer header
    masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription
    signup login share sharing social related recommended comment comments commentlist disqus replies respond form search
    toolbar skip""".split())
#: Those of an advert: the only ones that set an inline part aside.
ADVERT = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored".split())
#: Words that an id may have beside them; with any other it names a topic ("search-algorithms").
LAYOUT = frozenset("""section block box area container wrapper wrap list bar top bottom left right main site page global
    content inner outer item items links buttons button post article entry google primary secondary panel col column row
    region module view holder group mobile desktop""".split())
#: Words that make a class or id a state of what holds the article ("has-sidebar", "header-fixed").
STATE = frozenset("""has no with without not hide hides show shows fixed sticky static enabled disabled active inactive
    on off layout visible open closed""".split())
OUTWEIGH = 4  # a set-aside part comes back if its text outside links is so many times the rest of the page's
WEIGHT = {"article": 25.0, "main": 15.0, "blockquote": 3.0, "section": 3.0, "div": 3.0}


def marked(attributes: dict[str, str], tag: str = "div") -> int:
    """2 if a role or a hidden state sets the element aside, 1 if words of its
    class or id do, else 0. An id counts if it is made of such words and those of
    layout alone, and not on a heading or paragraph, where it names the passage; an
    inline element is only set aside as an advert."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return 2
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I):
        return 2
    if attributes.get("role", "").strip().lower() in ROLES:
        return 2
    listed = BESIDE if tag in BLOCKS else ADVERT

    def told(key):
        return [{w.lower() for w in WORD.findall(name)} for name in attributes.get(key, "").split()]

    ids = [] if tag in PARAGRAPH else [words for words in told("id") if words <= BESIDE | LAYOUT]
    return int(any(words & listed and not words & STATE for words in told("class") + ids))


def tag_end(page: str, at: int) -> tuple[int, dict[str, str]]:
    """(end of the tag, attributes) from after its name; -1 if it is cut off. A
    quote opens a value only right after =."""
    attributes: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            at = page.find(">", at)
            return (at + 1 if at >= 0 else -1), attributes
        at, value = m.end(), ""
        if m[2]:
            quote = page[at:at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:  # never closed: it ends with its tag
                    end = page.find(">", at)
                    return (end + 1 if end >= 0 else -1), attributes
                value, at = page[at + 1:end], end + 1
            else:
                end = UNQUOTED.match(page, at).end()
                value, at = page[at:end], end
        attributes.setdefault(m[1].lower(), value)


class Tree:
    """Block elements as parallel lists; node 0 is the page. own is 3 for what
    never is text, 2 for what is hidden or has a role beside the article, 1 for
    what its words set aside; drop is the largest own of a node and those above."""

    def __init__(self):
        self.tag, self.parent, self.own, self.drop = [""], [-1], [0], [0]
        self.points, self.size, self.links = [0.0], [0], [0]
        self.scorer = [0]  # the innermost container that takes points, itself or above
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.stack, self.open = [0], {}
        self.text: list[str] = []
        self.linked, self.in_link = 0, False

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def push(self, tag: str, drop: int) -> None:
        top = self.stack[-1]
        self.own.append(drop)
        self.drop.append(max(drop, self.drop[top]))
        self.tag.append(tag)
        self.parent.append(top)
        self.scorer.append(self.scorer[top] if tag in LISTS or tag in PARAGRAPH else len(self.tag) - 1)
        self.points.append(0.0)
        self.size.append(0)
        self.links.append(0)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        return tag

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if self.tag[top] == "head" and text.strip():
            self.pop()
            top = self.stack[-1]
        if self.drop[top] < 3:
            self.text.append(text)
            if self.in_link:
                self.linked += len(text)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "a":
            self.in_link = True
        elif tag == "br":
            self.add(" ")
        if self.tag[self.stack[-1]] == "head" and tag not in HEAD:
            self.pop()
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in BLOCKS:
            if attributes and marked(attributes, tag):
                self.push(tag, 3)  # an inline part beside the text; the block goes on
            return
        self.flush()
        top = self.tag[self.stack[-1]]
        while top == "p" or (top == tag and tag in ("li", "tr", "option")) or (
                top in ("dt", "dd") and tag in ("dt", "dd")) or (top in ("td", "th") and tag in ("td", "th", "tr")):
            self.pop()
            top = self.tag[self.stack[-1]]
        if tag in DROPPED or (tag == "header" and not self.open.get("article")):
            drop = 3
        else:
            drop = marked(attributes, tag) if attributes and tag not in ("html", "body", "main") else 0
        self.push(tag, drop)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in BLOCKS:
            self.flush()
        if self.open.get(tag):
            while self.pop() != tag:
                pass


def parsed(page: str) -> Tree:
    tree, at, n = Tree(), 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            tree.add(page[at:])
            break
        if begin > at:
            tree.add(page[at:begin])
        m = TAG.match(page, begin)
        if m is None:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)
                at = end + 3 if end >= 0 else n
            elif page[begin + 1:begin + 2] in ("!", "?", "/"):
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else n
            else:
                tree.add("<" if begin + 1 < n else "")
                at = begin + 1
            continue
        tag, at = m[2].lower(), m.end()
        if page[at:at + 1] == ">":
            attributes, at = {}, at + 1
        else:
            at, attributes = tag_end(page, at)
            if at < 0:
                break
        if m[1]:
            tree.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                break
            at = page.find(">", close.end()) + 1 or n
        else:
            tree.start(tag, attributes)
    tree.flush()
    return tree


def read_blocks(tree: Tree) -> list[tuple[int, str, int]]:
    """The blocks outside set-aside parts, and those of a part, or of an article in
    one, with ``OUTWEIGH`` times their text outside links. Articles in such parts
    are read too if there are none outside. Without any, all blocks."""
    part, within = [0], [False]  # the node that decides on each node, -1: none can; whether that is in an article
    for node in range(1, len(tree.tag)):
        above, inside = part[tree.parent[node]], within[tree.parent[node]]
        if tree.drop[node] >= 2 or above < 0:
            part.append(-1)
        elif tree.own[node] == 1:
            part.append(node)
            inside = inside or tree.tag[node] == "article"
        elif above and not inside and tree.tag[node] in ("article", "main"):
            part.append(node)
            inside = True
        else:
            part.append(above)
            inside = inside or tree.tag[node] == "article"
        within.append(inside)
    weight: dict[int, int] = {}
    for node, text, linked in tree.blocks:
        weight[part[node]] = weight.get(part[node], 0) + len(text) - linked
    rest = weight.get(0, 0)
    outside = any(part[node] == 0 and tree.tag[node] in ("article", "main") for node, _ in enumerate(tree.tag))
    back = {0} | {u for u, w in weight.items() if u > 0 and (
        0 in weight and w > OUTWEIGH * rest or not outside and not tree.own[u])}
    return [b for b in tree.blocks if part[b[0]] in back] or tree.blocks


def scored(tree: Tree, blocks: list[tuple[int, str, int]]) -> None:
    """Sizes, links and points from the blocks that are read."""
    for node, text, linked in blocks:
        tree.size[node] += len(text)
        tree.links[node] += linked
        value = text.count(",") + min(len(text) / 100, 3.0) + (len(text) >= 25)
        value *= 1 - linked / len(text)
        above, share = tree.scorer[node], 1.0
        for _ in range(5):
            tree.points[above] += value * share
            if not above:
                break
            above, share = tree.scorer[tree.parent[above]], share / 2


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = parsed(page)
    if not tree.blocks:
        return ""
    blocks = read_blocks(tree)
    scored(tree, blocks)
    for node in range(len(tree.tag) - 1, 0, -1):  # children come after their parents
        tree.size[tree.parent[node]] += tree.size[node]
        tree.links[tree.parent[node]] += tree.links[node]

    def score(node: int) -> float:
        if not tree.size[node] or not tree.points[node]:
            return 0.0
        bonus = 0.0 if tree.drop[node] else WEIGHT.get(tree.tag[node], 0.0)  # none in a set-aside part
        return (tree.points[node] + bonus) * (1 - tree.links[node] / tree.size[node])

    best = max(range(len(tree.tag)), key=lambda node: (score(node), -node))
    least = max(10.0, score(best) / 5)
    up = best
    while up > 0 and tree.tag[up] != "article":
        up = tree.parent[up]
    best = up if up > 0 else best
    keep = within(tree, kept_siblings(tree, best, score, least))
    return "\n".join(text for node, text, _ in blocks if keep[node])


def within(tree: Tree, chosen: set[int]) -> list[bool]:
    """For each node whether it is, or lies in, one of ``chosen``."""
    keep = [False] * len(tree.tag)
    for node in range(len(tree.tag)):
        keep[node] = node in chosen or (tree.parent[node] >= 0 and keep[tree.parent[node]])
    return keep


def kept_siblings(tree: Tree, best: int, score, least: float) -> set[int]:
    """``best`` and what goes with it: siblings that score ``least`` or are long
    paragraphs, sections beside a section, what lies between kept ones and isn't half
    links, headings before the first, and the nearest h1 before the best container or
    one around it, if the kept has none."""
    chosen = {best}
    if best <= 0:
        return chosen
    inside: dict[int, list[int]] = {}
    around = [best]
    while around[-1] > 0:
        around.append(tree.parent[around[-1]])
    wanted = set(around)
    for node in range(1, len(tree.tag)):
        if tree.parent[node] in wanted:
            inside.setdefault(tree.parent[node], []).append(node)

    def few_links(node, part):
        return tree.links[node] < tree.size[node] / part

    beside = [x for x in inside[tree.parent[best]] if tree.size[x]]
    good = [x == best or score(x) >= least or (tree.tag[x] == "p" and tree.size[x] > 80 and few_links(x, 4))
            or (tree.tag[x] == "section" == tree.tag[best] and few_links(x, 4)) for x in beside]
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    chosen |= {x for i, x in enumerate(beside) if good[i] or first < i < last and few_links(x, 2)}
    while first and tree.tag[beside[first - 1]] in HEADINGS and few_links(beside[first - 1], 2):
        first -= 1
        chosen.add(beside[first])
    if not any(kept and tree.size[x] for x, kept in enumerate(within(tree, chosen)) if tree.tag[x] == "h1"):
        for child, parent in zip(around, around[1:]):
            heads = [x for x in inside[parent] if x < child and tree.tag[x] == "h1" and few_links(x, 2)]
            if heads:
                return chosen | {heads[-1]}
    return chosen


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    python_ready(pages.sparkSession)

    def make(batch):
        column = batch.column(batch.schema.get_field_index("html"))
        return [pa.array([main_text(page.as_py()) for page in column], pa.string())]

    texts = add_columns(pages.select("page_id", "url", "html"), make, "text string", drop=("html",))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
