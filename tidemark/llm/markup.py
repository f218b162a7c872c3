"""HTML as a tree of blocks: what wrappers are inferred from and applied to.

A small tolerant reader: implied ends of p, li, dt, dd, tr, td, th, option and headings,
void and raw-text elements, quoted attributes, comments, unclosed anything. Inline markup
doesn't cut a block; of links only the number of characters counts.
"""

from __future__ import annotations

import html
import re

#: Element names of HTML by the role they have here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style textarea title iframe xmp noembed noframes noscript template svg math object audio video canvas map nav footer aside button select input fieldset dialog menu datalist".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an open element of the key's name ends with, up to a container of the second set.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Words of class, id, role and label that name what is no part of an article.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox"
    " newsletter subscribe subscription signup login signin register paywall sidebar sidebars aside rail widget widgets menu menus nav navbar navi navigation breadcrumb breadcrumbs pagination pager paging"
    " footer foot header masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion share sharing social follow related recommended recommendations recirc more trending popular teaser teasers"
    " search searchform copyright skip skiplink hidden contentinfo complementary form".split()
)
#: Words that say the same in the other direction.
MAIN = frozenset("content article articlebody post entry story main body text".split())

LAYOUT = frozenset("no not has with without left right layout fixed sticky enabled disabled open closed page single wide full".split())
LABELS = frozenset("advertisement breadcrumb breadcrumbs navigation comments sidebar".split())

TAG_RE = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTR_RE = re.compile(r"""(?<![^\s/"'])(class|id|role|aria-label|aria-hidden|hidden|style|itemprop)(?![^\s=/])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WORD_RE = re.compile(r"[a-z]+")
#: Elements inside so many others add no level of their own; inside so many, they are not followed at all.
DEPTH, OPEN = 200, 1000
#: What a head may hold; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Depth-first events of a page: element begins, text of a block, element ends.
BEGIN, TEXT, END = range(3)


def _named(token: str) -> tuple[bool, bool]:
    """Whether a class or id says other, or main. What describes a page's layout (no-sidebar, header-fixed) says nothing."""
    words = WORD_RE.findall(token)
    other = not OTHER.isdisjoint(words) and LAYOUT.isdisjoint(words)
    return other, not other and bool(words) and MAIN.issuperset(words)


def attributes(name: str, attrs: str) -> tuple[str, bool, bool]:
    """An element's signature (its name, classes and id but for those with digits, its role, and whether it is hidden), whether these name it as no part of an article, and whether as its place."""
    main = name in ("article", "main")
    if not attrs or attrs.isspace():
        return name, name == "form", main
    other, signed = name == "form", []
    for m in ATTR_RE.finditer(attrs):
        key, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'")).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            other = True
            signed.append("hidden")
        elif key in ("class", "id"):
            for t in value.split():
                o, m_ = _named(t)
                other, main = other or o, main or m_
                if not any(c.isdigit() for c in t):
                    signed.append(t)
        elif key == "role":
            signed.append(f"role={value}")
            main |= value in ("main", "article")
            other |= value in ("banner", "navigation", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog")
        elif key == "itemprop":
            main |= value == "articlebody"
        elif key == "aria-label":
            other |= not LABELS.isdisjoint(WORD_RE.findall(value))
    return name + "".join(f".{t}" for t in sorted(set(signed))), other, main


def events(page: str):
    """Events of a page: (BEGIN, signature, other, main), (TEXT, text, characters in links) and (END,).

    A block's text has its character references decoded and its white space turned
    into single blanks. Elements that are never part of an article are left out whole;
    inline ones among them don't end the block they stand in.
    """
    stack: list[tuple[str, bool, bool]] = []  # name, whether it gave an event, whether what it holds is left out
    parts: list[str] = []
    links, linked, out, skipping = 0, 0, [], 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((TEXT, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close() -> None:
        nonlocal skipping, links
        name, told, skips = stack.pop()
        if name not in INLINE and name not in ("button", "select"):
            flush()
            links = 0
        if skips:
            skipping -= 1
        if told:
            out.append((END,))

    def close_to(names, stop) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in stop:
                return
            if stack[k][0] in names:
                while len(stack) > k:
                    close()
                return

    def add(chunk: str) -> None:
        nonlocal linked
        if chunk and not skipping:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            parts.append(chunk)
            if links:
                linked += len(" ".join(chunk.split()))

    at, n = 0, len(page)
    while at < n:
        m = TAG_RE.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                parts.append(" ")
            elif any(s[0] == name for s in reversed(stack)):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close_to({"p"}, ())
                flush()
            continue
        if name in ("html", "body"):
            if name == "body":
                close_to({"head"}, ())
            flush()
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            close()
        if name in ("article", "main", "footer"):
            close_to({"nav"}, ())
        if len(stack) >= OPEN:
            continue
        sig, other, main = attributes(name, m[3])
        if name in RAW:
            if name not in ("script", "style", "title"):
                flush()
            end = RAW_END[name].search(page, at)
            if not end:
                break
            at = page.find(">", end.end()) + 1 or n
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            if other and not main and not m[3].rstrip().endswith("/"):
                stack.append((name, False, True))
                skipping += 1
            continue
        if name in CLOSES_P:
            close_to({"p"}, ("td", "th", "button", "table"))
        if name in HEADING and stack and stack[-1][0] in HEADING:
            close()
        if name in SIBLINGS:
            close_to(*SIBLINGS[name])
        skips = name in NEVER
        if name not in ("button", "select"):
            flush()
            links = 0
        told = not skips and not skipping and len(stack) < DEPTH
        if told:
            out.append((BEGIN, sig, other, main))
        stack.append((name, told, skips))
        skipping += skips
    while stack:
        close()
    flush()
    return out
