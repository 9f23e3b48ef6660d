"""Scalar column functions (native Spark expressions but for one, ``substring_dedupe``).

Each function takes and returns ``Column``s, so it composes inside
``select``/``where`` and stays in whole-stage codegen. Patterns use no
look-around, so the same text runs in Java regex and in RE2 (the DuckDB
oracles in ``plans/oracle.py`` reuse them).
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import (DATE_FORMAT, ENGLISH_LANGUAGE, ENGLISH_SEGMENT, MEDIA_PREFIX,
                      MEDIA_SUFFIXES, URL_SCHEMES)
from ..session import ship_package

# What ends a line in Java patterns.
LINE_BREAKS = ("\n", "\r", "\u0085", "\u2028", "\u2029")
# ASCII whitespace as split by class-name parsing.
_CLASS_WS = r"[ \t\n\x0B\f\r]+"
# scheme, then optional //authority with user-info dropped and the host kept
# (a bracketed IPv6 literal is one host).
_ORIGIN_RE = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):(//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)(:([^/?#]*))?)?"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_lines(html) -> Column:
    """Body lines concatenated with no separator (``a\\nb`` -> ``ab``)."""
    return F.regexp_replace(_col(html), r"\r\n|\r|\n", "")


def class_tokens(class_value) -> Column:
    """Class attribute split on ASCII whitespace; empties dropped,
    duplicates within the element dropped, first-seen order kept."""
    c = F.coalesce(_col(class_value), F.lit(""))
    return F.array_distinct(F.filter(F.split(F.trim(c), _CLASS_WS), lambda x: x != ""))


def has_attr_prefix(attrs, prefix: str) -> Column:
    """Element has an attribute whose name starts with ``prefix``."""
    return F.exists(F.map_keys(_col(attrs)), lambda k: k.startswith(prefix))


def vocab_array(vocab: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in vocab])


def primary_block(tokens, vocab: Iterable[str]) -> Column:
    """First token (attribute order) that is in the vocabulary, or null."""
    va = vocab_array(vocab)
    return F.try_element_at(F.filter(_col(tokens), lambda t: F.array_contains(va, t)), F.lit(1))


def variant_name(tokens, vocab: Iterable[str]) -> Column:
    """Remaining tokens with every vocabulary name removed, joined by a space."""
    va = vocab_array(vocab)
    return F.array_join(F.filter(_col(tokens), lambda t: ~F.array_contains(va, t)), " ")


def regex_quote(text: str) -> str:
    """Escape regex metacharacters (same result in Java regex and RE2)."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in text)


def language_pattern(site_prefix: str) -> str:
    """Pattern whose group 1 is the text between the first ``site_prefix``
    and the next ``/``."""
    return "^.*?" + regex_quote(site_prefix) + "([^/]*)/"


def page_language(url, site_prefix: str, english: str = ENGLISH_SEGMENT) -> Column:
    """Text between ``site_root/`` and the next ``/``; null when either
    is missing; the English segment (any case) maps to ``en``."""
    u = _col(url)
    pat = language_pattern(site_prefix)
    seg = F.regexp_extract(u, pat, 1)
    lang = F.when(F.lower(seg) == F.lit(english.lower()), F.lit(ENGLISH_LANGUAGE)).otherwise(seg)
    # regexp_extract gives '' on a miss, so guard with rlike for the null
    return F.when(u.rlike(pat), lang)


def format_epoch(epoch_seconds) -> Column:
    """Epoch seconds (string or number) as ``yyyy-MM-dd HH:mm:ss`` in
    the session time zone (pinned to UTC); null when not a number."""
    return F.date_format(F.timestamp_seconds(_col(epoch_seconds).try_cast("bigint")), DATE_FORMAT)


def uncontained(items: Iterable[str | None]) -> list[str]:
    """The items that no earlier item contains, in order; null and '' never.

    One automaton over the distinct items, linear in their text: each node of
    their trie remembers the first item that runs through it, and hands it to the
    node of its longest proper suffix. What arrives at an item's last node is the
    first item that contains it.
    """
    order = [x for x in dict.fromkeys(items) if x]
    child: dict[int, int] = {}
    parent, label, depth, first, last = [0], [0], [0], [len(order)], []
    for i, item in enumerate(order):
        node = 0
        for c in map(ord, item):
            edge = node << 21 | c
            ahead = child.get(edge)
            if ahead is None:
                ahead = child[edge] = len(parent)
                parent.append(node)
                label.append(c)
                depth.append(depth[node] + 1)
                first.append(i)
            node = ahead
        last.append(node)
    by_depth = sorted(range(1, len(parent)), key=depth.__getitem__)
    suffix = [0] * len(parent)
    for node in by_depth:
        if depth[node] > 1:
            c, at = label[node], suffix[parent[node]]
            ahead = child.get(at << 21 | c)
            while ahead is None and at:
                at = suffix[at]
                ahead = child.get(at << 21 | c)
            suffix[node] = ahead or 0
    for node in reversed(by_depth):
        at = suffix[node]
        if first[node] < first[at]:
            first[at] = first[node]
    return [x for i, (x, node) in enumerate(zip(order, last)) if first[node] == i]


def _uncontained_lists(lists: pa.Array) -> pa.Array:
    return pa.array([None if x is None else uncontained(x) for x in lists.to_pylist()], pa.list_(pa.string()))


def substring_dedupe(items) -> Column:
    """Keep an item only if no earlier item contains it ('' never kept).

    Equal to appending kept items to a growing text and skipping any item the
    text already contains, because containment is transitive. The one function
    here that is not native: an Arrow function over a page's links, linear in
    their length (``uncontained``).
    """
    if SparkSession.getActiveSession() is not None:
        ship_package(SparkSession.getActiveSession())
    return F.arrow_udf(_uncontained_lists, "array<string>")(_col(items))


def url_scheme(href) -> Column:
    return F.lower(F.regexp_extract(_col(href), _ORIGIN_RE, 1))


def is_absolute_url(href, schemes: Iterable[str] = URL_SCHEMES) -> Column:
    """The href parses as an absolute URL with a known scheme and, when
    an authority has a port, a numeric one."""
    h = _col(href)
    port = F.regexp_extract(h, _ORIGIN_RE, 5)
    return (h.rlike(_ORIGIN_RE)
            & url_scheme(h).isin(*schemes)
            & ((port == "") | port.rlike(r"^[0-9]+$")))


def url_origin(href) -> Column:
    """``scheme://host`` with the scheme lower-cased, host case kept,
    port and user-info dropped; ``mailto:x`` gives ``mailto://``."""
    h = _col(href)
    return F.concat(url_scheme(h), F.lit("://"), F.regexp_extract(h, _ORIGIN_RE, 3))


def is_brand(text, brand: str) -> Column:
    """Text contains the brand domain, ignoring case."""
    return F.lower(_col(text)).contains(brand.lower())


def join_links(items) -> Column:
    """Each item preceded by a newline; '' when there is none."""
    return F.coalesce(F.array_join(F.transform(_col(items), lambda x: F.concat(F.lit("\n"), x)), ""),
                      F.lit(""))


def split_star(text) -> Column:
    """Split on any run of ``*``; empty parts vanish."""
    return F.filter(F.split(_col(text), r"[*]+"), lambda x: x != "")


def media_ids(html, prefix: str = MEDIA_PREFIX, suffixes: Iterable[str] = MEDIA_SUFFIXES) -> Column:
    """The texts from each ``prefix`` to the next ``.suffix`` on its line, as a
    sorted set: what the pattern ``prefix(.*?)\\.(suffix|...)`` finds.

    The ends are found once each, by a split. Between two ends only the first
    prefix after the last line break can begin a match, so each stretch is read
    once: linear, where the pattern reads on from every prefix.
    """
    ends = r"\.(?:" + "|".join(map(regex_quote, suffixes)) + ")"
    stretches = F.split(_col(html), ends, -1)

    def found(stretch):
        for line_break in LINE_BREAKS:
            stretch = F.substring_index(stretch, line_break, -1)
        at = F.instr(stretch, F.lit(prefix))
        return F.when(at > 0, F.substr(stretch, at + len(prefix), F.char_length(stretch)))

    ids = F.transform(F.slice(stretches, 1, F.size(stretches) - 1), found)
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def show_set(items) -> Column:
    """A set printed as ``[a, b]`` (sorted, so the text is stable)."""
    return F.concat(F.lit("["), F.array_join(F.array_sort(_col(items)), ", "), F.lit("]"))
