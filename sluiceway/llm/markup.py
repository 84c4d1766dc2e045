"""Text lines of an HTML page, with the part of the page each stands in."""

from __future__ import annotations

import re
from html import unescape

# Elements whose content is not text of the page (raw text), or not text of an article.
RAW = "script|style|title|textarea|noscript|template|iframe|xmp|noembed|noframes|svg|math|canvas|object"
APART = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head", "datalist", "audio", "video"}
BLOCKS = {
    "p", "div", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "header",
    "footer", "nav", "aside", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "form", "fieldset", "legend", "address", "details", "summary", "body", "html", "head", "hr", "center", "hgroup",
    "search", "option", "select", "button", "menu", "dialog",
}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
# Words in a class, id or role that set an element apart.
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer contentinfo complementary comment "
    "comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login popup "
    "modal overlay widget toolbar pagination pager search skip dialog form hidden".split()
)
# Inside an article these name its own parts; outside, parts of the site.
SITE_NAMES = {"header", "top", "bottom", "side", "site", "legal", "copyright"}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all it holds is set apart from the text."""
    if tag in APART or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for kind, a, b, c in NAMED.findall(attributes):
        parts = {w.lower() for w in PART.findall(a or b or c)}
        if tag == "article":
            parts &= {"comment", "comments", "reply", "related"}
        if parts & NAMES or (not inside and parts & SITE_NAMES):
            return True
    return False


def page_lines(html: str) -> list[tuple[str, bool]]:
    """(line, inside) for each block of text in page order; ``inside``: within an article or main element.

    Character references are decoded and white space in a block is one space.
    Menus, site headers, footers, sidebars, notices, adverts, forms, comments,
    scripts and styles give no lines. Broken markup is read as far as it goes.
    """
    lines: list[tuple[str, bool]] = []
    held: list[str] = []
    article = 0  # open article and main elements
    skipped, depth = "", 0  # the element being skipped, and how many of its kind are open

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                lines.append((text, article > 0))
            held.clear()

    at = 0
    for m in TOKEN.finditer(html):
        if not skipped and m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and not skipped and m[1].lower() in ("script", "style"):
                held.append(" ")
            continue
        tag = tag.lower()
        closing = bool(m[2])
        if skipped:
            if skipped == "p" and tag in BLOCKS and not (tag == "p" and closing):
                skipped = ""  # a paragraph ends where the next block begins
            elif tag == skipped:
                depth += -1 if closing else not m[4].endswith("/")
                if depth == 0:
                    skipped = ""
                continue
            else:
                continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if closing:
            if tag in ("article", "main") and article:
                article -= 1
        elif tag not in VOID:
            if _apart(tag, m[4], article > 0):
                flush()
                skipped, depth = tag, 1
            elif tag in ("article", "main"):
                article += 1
    if not skipped and at < len(html):
        held.append(html[at:])
    flush()
    return lines
