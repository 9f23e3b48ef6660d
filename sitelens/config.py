"""Run parameters of a site audit.

Everything the audited programs hard-code (site root, brand domain, block
vocabulary, layout labels, index templates, media pattern) is a field here,
so one library serves any site. Defaults are neutral values that match the
test fixture; pass your own ``AuditConfig`` for a real site.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the audited programs' behaviour.
# ---------------------------------------------------------------------------
# Layout labels looked for under a block, in this order; the layout name is
# the concatenation of the labels found ("Desktop", "Mobile", "DesktopMobile").
LAYOUT_LABELS = ("Desktop", "Mobile")
# Layout when neither the block nor any section metadata names a layout.
DEFAULT_LAYOUT = "Desktop Mobile"
# Fragment appended per section-metadata element: "Desktop" when the section
# text has desktop, then " Mobile" when it has mobile; the sum is trimmed.
SECTION_DESKTOP_FRAGMENT = "Desktop"
SECTION_MOBILE_FRAGMENT = " Mobile"
# Section terms: a section has desktop when some own text in its subtree
# contains "desktop" or "Desktop" (case-sensitive find); likewise mobile.
SECTION_DESKTOP_TERMS = ("desktop", "Desktop")
SECTION_MOBILE_TERMS = ("mobile", "Mobile")
# Class of the section metadata element (matched ignoring case).
SECTION_CLASS = "section-metadata"
# Language segment that means English.
ENGLISH_SEGMENT = "express"
ENGLISH_LANGUAGE = "en"
# Redirect statuses that are skipped without reading the body.
REDIRECT_STATUSES = (301, 302, 303)
# Index documents count only with this status.
INDEX_OK_STATUS = 200
# A media id stands between this prefix and the next of these endings after a
# dot. "jpg" is deliberately not an end.
MEDIA_PREFIX = "media_"
MEDIA_SUFFIXES = ("png", "jpeg", "mp4")
# Date format of query-index lastModified values.
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Schemes java.net.URL accepts without extra handlers.
URL_SCHEMES = ("http", "https", "ftp", "file", "mailto")
# Report headers, in column order.
HEADERS_BLOCK_REPORT = ("Block Name", "Variant Name", "Layout Name", "Language",
                        "Occurrence", "Last Modified", "Page Url")
HEADERS_LINKS = ("URL", "HREF LINKS")
HEADERS_DOMAINS = ("URL", "HREF LINKS", "BRAND DOMAINS", "NON-BRAND DOMAINS")
HEADERS_MEDIA = ("Url", "Template Ids")
HEADER_URL = "Url"
# ---------------------------------------------------------------------------

# Neutral defaults for the test fixture (FIXTURES.md section 3).
FIXTURE_SITE_ROOT = "https://www.example.com"
FIXTURE_BRAND = "example.com"
FIXTURE_VOCAB = ("seo-nav", "list", "columns", "marquee", "banner", "cards", "steps")


@dataclass(frozen=True)
class IndexFamily:
    """A query-index family: one URL template formatted with each locale."""

    name: str
    template: str  # '{root}' and '{locale}' are substituted
    locales: tuple[str, ...]


def _default_families() -> tuple[IndexFamily, ...]:
    return (
        IndexFamily("express", "{root}{locale}/express/query-index.json",
                    ("", "/br", "/de", "/fr", "/jp")),
        IndexFamily("blog", "{root}{locale}/express/learn/blog/query-index.json",
                    ("", "/de", "/jp")),
    )


@dataclass(frozen=True)
class AuditConfig:
    site_root: str = FIXTURE_SITE_ROOT
    brand: str = FIXTURE_BRAND
    vocab: tuple[str, ...] = FIXTURE_VOCAB
    families: tuple[IndexFamily, ...] = field(default_factory=_default_families)
    labels: tuple[str, ...] = LAYOUT_LABELS
    section_class: str = SECTION_CLASS
    desktop_terms: tuple[str, ...] = SECTION_DESKTOP_TERMS
    mobile_terms: tuple[str, ...] = SECTION_MOBILE_TERMS
    desktop_fragment: str = SECTION_DESKTOP_FRAGMENT
    mobile_fragment: str = SECTION_MOBILE_FRAGMENT
    default_layout: str = DEFAULT_LAYOUT
    english_segment: str = ENGLISH_SEGMENT
    media_prefix: str = MEDIA_PREFIX
    media_suffixes: tuple[str, ...] = MEDIA_SUFFIXES
    url_schemes: tuple[str, ...] = URL_SCHEMES

    @property
    def site_prefix(self) -> str:
        return self.site_root.rstrip("/") + "/"


DEFAULT = AuditConfig()
