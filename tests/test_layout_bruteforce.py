"""Block / variant / layout facts from the Spark plan (prefix sums over each
page's event stream) against a brute-force walk of the definition on random
pages: for each block element, descend for the labels; else scan the
section-metadata elements of the parent's subtree in order."""

import random
from collections import Counter

from sitelens.config import AuditConfig
from sitelens.operators import blocks
from sitelens.operators.htmltree import parse_elements
from sitelens.plans.store import parsed_elements

VOCAB = ("banner", "cards", "steps", "list")
CFG = AuditConfig(vocab=VOCAB)
CLASSES = ["banner", "cards big", "steps", "list compact list", "x", "section-metadata",
           "Section-Metadata", "banner cards", ""]
TEXTS = ["Desktop", "mobile", "MOBILE", "desktop x", "DESKTOP", "x", "Mobile", " desktop ", ""]


def random_page(rnd, depth=0):
    parts = []
    for _ in range(rnd.randint(1, 4)):
        r = rnd.random()
        if r < 0.45 and depth < 5:
            cls = rnd.choice(CLASSES)
            attr = f' class="{cls}"' if cls else ""
            parts.append(f"<div{attr}>{rnd.choice(TEXTS)}{random_page(rnd, depth + 1)}</div>")
        elif r < 0.6:
            parts.append(f"<span>{rnd.choice(TEXTS)}</span>")
        else:
            parts.append(rnd.choice(TEXTS))
    return "".join(parts)


def brute_force(html):
    els = parse_elements(html, CFG.labels)
    by_pre = {e[0]: e for e in els}
    children = {e[0]: [] for e in els}
    for e in els:
        if e[2] >= 0:
            children[e[2]].append(e[0])

    def own(i):
        return by_pre[i][7]

    def descend(i, label):
        for c in children[i]:
            if own(c).lower() == label.lower():
                return True
            if children[c]:
                return descend(c, label)
        return False

    def tokens(e):
        seen = []
        for t in e[6].get("class", "").split():
            if t not in seen:
                seen.append(t)
        return seen

    out = Counter()
    for e in els:
        if not any(k.startswith("class") for k in e[6]):
            continue
        toks = tokens(e)
        known = [t for t in toks if t in VOCAB]
        if not known:
            continue
        block, variant = known[0], " ".join(t for t in toks if t not in VOCAB)
        layout = "".join(lb for lb in CFG.labels if descend(e[0], lb))
        if not layout:
            parent = by_pre[e[2]]
            sections = [s for s in els if parent[0] <= s[0] <= parent[1]
                        and any(t.lower() == "section-metadata" for t in tokens(s))]
            if not sections:
                layout = "Desktop Mobile"
            else:
                for s in sections:
                    sub = [own(x[0]) for x in els if s[0] <= x[0] <= s[1]]
                    if any("desktop" in t or "Desktop" in t for t in sub):
                        layout += "Desktop"
                    if any("mobile" in t or "Mobile" in t for t in sub):
                        layout += " Mobile"
                layout = layout.strip()
        out[(block, variant, layout)] += 1
    return out


def test_layouts_match_brute_force(spark):
    rnd = random.Random(11)
    pages = [(f"https://www.example.com/express/r{i}", 200, random_page(rnd)) for i in range(300)]
    df = spark.createDataFrame(pages, "url string, status int, html string")
    els = parsed_elements(df, None, CFG)
    got = {}
    for r in blocks.block_variant_layout_counts(els, CFG).collect():
        got.setdefault(r["url"], Counter())[(r["block"], r["variant"], r["layout"])] = r["n"]
    n_facts = 0
    for url, _, html in pages:
        want = brute_force(html)
        n_facts += sum(want.values())
        assert got.get(url, Counter()) == want, (url, html)
    assert n_facts > 300  # the random pages do hold blocks
