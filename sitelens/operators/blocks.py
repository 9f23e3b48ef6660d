"""Block operators: known blocks, variants, layouts and their counts.

O13 known_block_filter, O18 primary_block, O19 variant_name, O20 chain_label,
O21 section_scope, O22 section_terms, O23 layout_label, O24 block_matrix,
O25 block_counts, O35 block_variant_layout_report.

Element tables hold one parsed copy per url (``plans.store`` guarantees
it); per-page windows and groups still key on ``page_key``.

Subtree questions (is a term under this section? which sections lie under
this parent?) are answered without pairing elements: each page becomes an
ordered stream of events (term hits, sections, scope starts and ends), a
running sum over the stream gives prefix counts, and a scope's answer is the
difference of the prefix values at its two ends. Only equi-keys and windows
partitioned by url are used; no step compares element pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import DEFAULT, AuditConfig
from .elements import class_elements


def _has_any(col: str, terms: Sequence[str]):
    """Case-sensitive find of any literal term (plain substring tests)."""
    c = F.col(col)
    out = c.contains(terms[0])
    for t in terms[1:]:
        out = out | c.contains(t)
    return out


def known_block_tokens(elements: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """O17 + O13: one row per (element, known class token), with position.

    The vocabulary is a bounded parameter list compiled into the plan as a
    literal array, so the filter is map-side with no join or shuffle.
    """
    va = fn.vocab_array(vocab)
    return (class_elements(elements)
            .select("page_key", "url", "pre", F.posexplode("classes").alias("pos", "block"))
            .where(F.array_contains(va, F.col("block"))))


def block_counts(elements: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """(url, block, n) over elements; every known token of an element
    counts (unlike the primary block)."""
    return (known_block_tokens(elements, vocab)
            .groupBy("url", "block").agg(F.count(F.lit(1)).alias("n")))


def block_matrix(urls: DataFrame, elements: DataFrame | None, vocab: Sequence[str],
                 counts: DataFrame | None = None) -> DataFrame:
    """One row per distinct listed url, one zero-filled count column per
    vocabulary name. Pages that redirect or fail keep a row of zeros; a url
    listed twice is one row (the counts are reset, not summed).

    ``pivot`` is given the value list, so no extra job finds the values.
    ``counts`` is a precomputed ``block_counts`` table (a fact store).
    """
    counts = counts if counts is not None else block_counts(elements, vocab)
    wide = counts.groupBy("url").pivot("block", list(vocab)).agg(F.first("n"))
    listed = urls.select("url").distinct()
    out = listed.join(wide, "url", "left").na.fill(0, subset=list(vocab))
    return out.select("url", *[F.col(f"`{v}`").cast("long").alias(v) for v in vocab])


def block_elements(elements: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """O18 + O19 + O20: elements whose class tokens include a known block.

    Columns: url, pre, parent_pre, parent_end, block (first known token),
    variant (other tokens minus every known name), chain (labels found by
    the layout descent, concatenated with no space).
    """
    ce = class_elements(elements)
    return (ce.select(
        "page_key", "url", "pre", "parent_pre", "parent_end",
        fn.primary_block("classes", cfg.vocab).alias("block"),
        fn.variant_name("classes", cfg.vocab).alias("variant"),
        F.array_join("chain_labels", "").alias("chain"))
        .where(F.col("block").isNotNull()))


def section_elements(elements: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Section-metadata elements (class token equal ignoring case)."""
    sc = cfg.section_class.lower()
    return (class_elements(elements)
            .where(F.exists("classes", lambda t: F.lower(t) == F.lit(sc)))
            .select("page_key", "pre", "end"))


def section_terms(elements: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Per section element (page_key, pre, end): has_desktop / has_mobile.

    A section has desktop when some element of its subtree, itself included,
    has own text where ``desktop`` or ``Desktop`` is found (case-sensitive);
    likewise mobile. Computed as prefix counts of term hits in pre-order.
    """
    hits = (elements
            .select("page_key", "pre",
                    _has_any("own_text", cfg.desktop_terms).cast("int").alias("d"),
                    _has_any("own_text", cfg.mobile_terms).cast("int").alias("m"))
            .where("d + m > 0"))
    sections = section_elements(elements, cfg)
    # kind 0: section start (read before hits at that pre), 1: term hit,
    # 2: section end (read after hits at that pre)
    events = (hits.select("page_key", F.col("pre").alias("at"), F.lit(1).alias("kind"),
                          F.lit(None).cast("int").alias("sid"), "d", "m")
              .unionByName(sections.select("page_key", F.col("pre").alias("at"), F.lit(0).alias("kind"),
                                           F.col("pre").alias("sid"), F.lit(0).alias("d"),
                                           F.lit(0).alias("m")))
              .unionByName(sections.select("page_key", F.col("end").alias("at"), F.lit(2).alias("kind"),
                                           F.col("pre").alias("sid"), F.lit(0).alias("d"),
                                           F.lit(0).alias("m"))))
    w = (Window.partitionBy("page_key").orderBy("at", "kind", "sid")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = (events.select("page_key", "kind", "sid", "at",
                         F.sum("d").over(w).alias("cd"), F.sum("m").over(w).alias("cm"))
           .where("kind <> 1"))
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    return (run.groupBy("page_key", "sid")
            .agg(F.max(F.when(F.col("kind") == 2, F.col("at"))).alias("end"),
                 (F.sum(sign * F.col("cd")) > 0).alias("has_desktop"),
                 (F.sum(sign * F.col("cm")) > 0).alias("has_mobile"))
            .withColumnRenamed("sid", "pre"))


def section_scope(scopes: DataFrame, sections: DataFrame, text: str = "text_wanted") -> DataFrame:
    """O21 + O23 (section part): for each scope (page_key, lo, hi, text_wanted),
    the number of sections with ``lo <= pre <= hi`` and, where wanted, the
    concatenation of their fragments in document order.

    ``sections`` has (page_key, pre, frag). The counts are prefix counts over the
    page's event stream. The fragments of a page are gathered once, in order; the
    sections of a scope are the run between its two prefix counts.
    """
    no_frag = F.lit(None).cast("string")
    events = (sections.select("page_key", F.col("pre").alias("at"), F.lit(1).alias("kind"),
                              F.lit(None).cast("int").alias("lo"), "frag")
              .unionByName(scopes.select("page_key", F.col("lo").alias("at"), F.lit(0).alias("kind"),
                                         "lo", no_frag.alias("frag")))
              .unionByName(scopes.select("page_key", F.col("hi").alias("at"), F.lit(2).alias("kind"),
                                         "lo", no_frag.alias("frag"))))
    w = (Window.partitionBy("page_key").orderBy("at", "kind", "lo")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = (events.select("page_key", "kind", "lo", F.count("frag").over(w).alias("cnt"))
              .where("kind <> 1").groupBy("page_key", "lo")
              .agg(F.max(F.when(F.col("kind") == 0, F.col("cnt"))).alias("c0"),
                   F.max(F.when(F.col("kind") == 2, F.col("cnt"))).alias("c2")))
    frags = sections.groupBy("page_key").agg(F.expr(
        "transform(array_sort(collect_list(struct(pre, frag))), x -> x.frag)").alias("frags"))
    return (counts.join(scopes.select("page_key", "lo", text), ["page_key", "lo"])
            .join(frags, "page_key", "left")
            .select("page_key", "lo", (F.col("c2") - F.col("c0")).alias("n_sections"),
                    F.when(F.col(text), F.expr("array_join(slice(frags, int(c0) + 1, int(c2 - c0)), '')"))
                    .alias("section_text")))


def block_facts(elements: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One row per block element: page_key, url, pre, block, variant, chain,
    n_sections, layout.

    Layout: the chain labels when the descent found any; otherwise the
    default layout when the block's parent subtree (parent included) has no
    section metadata; otherwise, for each such section in order, ``Desktop``
    and/or `` Mobile`` appended, and the whole trimmed. Blocks under one parent
    share one scope; its text is made only if a block without chain asks.
    """
    blocks = block_elements(elements, cfg)
    scopes = blocks.groupBy("page_key", F.col("parent_pre").alias("lo")).agg(
        F.max("parent_end").alias("hi"), F.max(F.col("chain") == "").alias("text_wanted"))
    terms = section_terms(elements, cfg)
    frag = F.concat(F.when(F.col("has_desktop"), F.lit(cfg.desktop_fragment)).otherwise(F.lit("")),
                    F.when(F.col("has_mobile"), F.lit(cfg.mobile_fragment)).otherwise(F.lit("")))
    scoped = section_scope(scopes, terms.select("page_key", "pre", frag.alias("frag")))
    joined = blocks.join(scoped.withColumnRenamed("lo", "parent_pre"), ["page_key", "parent_pre"], "left")
    layout = (F.when(F.col("chain") != "", F.col("chain"))
              .when(F.coalesce(F.col("n_sections"), F.lit(0)) == 0, F.lit(cfg.default_layout))
              .otherwise(F.trim(F.col("section_text"))))
    return joined.select("page_key", "url", "pre", "block", "variant", "chain",
                         F.coalesce(F.col("n_sections"), F.lit(0)).alias("n_sections"),
                         layout.alias("layout"))


def block_variant_layout_counts(elements: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Per page: (url, block, variant, layout, n) where n counts elements."""
    return (block_facts(elements, cfg)
            .groupBy("url", "block", "variant", "layout")
            .agg(F.count(F.lit(1)).alias("n")))


def block_variant_layout_report(listing: DataFrame, elements: DataFrame | None,
                                dates: DataFrame | None, cfg: AuditConfig = DEFAULT,
                                counts: DataFrame | None = None) -> DataFrame:
    """O35 (+ O26, O34): count per (block, variant, layout, page) with the
    page language and last-modified date.

    ``listing`` has one row per time a url is listed (a url listed twice
    counts twice); it is pre-aggregated to (url, times) before any join, so
    a url that is a large share of the listing never forms a hot join key.
    ``dates`` is (url, last_modified), one row per url (after O10), or None.
    ``counts`` is a precomputed ``block_variant_layout_counts`` table.
    """
    times = listing.groupBy("url").agg(F.count(F.lit(1)).alias("times"))
    facts = counts if counts is not None else block_variant_layout_counts(elements, cfg)
    rep = facts.join(times, "url")
    if dates is not None:
        rep = rep.join(dates.select("url", "last_modified"), "url", "left")
    else:
        rep = rep.withColumn("last_modified", F.lit(None).cast("string"))
    return rep.select(
        F.col("block").alias("block_name"),
        F.col("variant").alias("variant_name"),
        F.col("layout").alias("layout_name"),
        fn.page_language("url", cfg.site_prefix, cfg.english_segment).alias("language"),
        (F.col("n") * F.col("times")).alias("occurrence"),
        F.col("last_modified"),
        F.col("url").alias("page_url"),
    )
