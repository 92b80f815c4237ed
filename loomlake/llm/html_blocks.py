"""Flat text blocks of a web page, with what surrounds each of them.

A page is read tag by tag, once, whatever its markup is worth: end tags close up to their nearest open element, others are ignored, and the content of
scripts, styles and controls is skipped. Text between two block-level tags is one block.
"""

from __future__ import annotations

import html
import re

# Elements of HTML by their role.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text, read up to their end tag as it stands.
RAW = frozenset("script style textarea title noscript iframe template svg math select option button object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class, id or role that speak for the main text, and against it; a name of both kinds speaks against.
MAIN = frozenset("article articlebody main maincontent content post postbody entry story".split())
CHROME = frozenset(
    "nav navigation navbar menu menubar footer aside sidebar complementary contentinfo search form login signup register ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice alert popup modal dialog overlay newsletter subscribe subscription comment comments commentlist disqus reply replies respond related recommended "
    "share sharing social widget breadcrumb breadcrumbs pager pagination toolbar masthead topbar tags tagcloud copyright legal disclaimer toc skip".split()
)
#: Elements, and roles, that speak against the main text wherever they stand.
APART = frozenset("nav aside footer dialog menu navigation complementary contentinfo search".split())
#: What an element says of its text: nothing, main, against, against wherever it stands, header (against, unless inside the main text).
NONE, FOR, AGAINST, OUTSIDE, HEADER = range(5)

# a quoted value may hold a closing bracket; one that never ends is read up to the first
_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]{0,100000}+"|'[^']{0,100000}+')?+)*+)(?:>|\Z))""", re.DOTALL)
_ABOUT = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=\s|$))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = tuple(".!?…。！？।؟:;\"'”»)")


def cue(name: str, about: str) -> int:
    """What an element's name and attributes say of its text."""
    if name in APART:
        return OUTSIDE
    found = {"article": FOR, "main": FOR, "header": HEADER, "form": AGAINST}.get(name, NONE)
    for key, value in _ABOUT.findall(about) if about and name not in ("html", "body") else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word)} | {word.lower()}
                if key == "role" and parts & APART:
                    return OUTSIDE
                if parts & {"no", "has", "with", "is"}:
                    continue
                if parts & CHROME:
                    return AGAINST
                if parts & MAIN and "header" not in parts:
                    found = FOR
                elif "header" in parts and found == NONE:
                    found = NONE if parts & MAIN else HEADER
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
            return OUTSIDE
    return found


#: The kind of a block by the innermost element that says one; 0 is anything else.
KINDS = {"p": 1} | dict.fromkeys(HEADINGS, 2) | dict.fromkeys(("li", "dt", "dd"), 3) | dict.fromkeys(("td", "th", "caption"), 4) | dict.fromkeys(("blockquote", "pre"), 5)


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int, bool, bool]]:
    """(text, words, words in links, kind, innermost cue, elements against, elements outside, ends a sentence, behind the first h1) of each block in order."""
    out: list[tuple] = []
    stack: list[tuple[str, int]] = []  # open elements with their cue
    parts: list[str] = []
    linked, titled = 0, False

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            said, inner = [], NONE
            for _, c in stack:
                c = (NONE if FOR in said else AGAINST) if c == HEADER else c
                said.append(c)
                inner = min(c, AGAINST) or inner
            kind = next((KINDS[n] for n, _ in reversed(stack) if n in KINDS), 0)
            out.append((text, len(text.split()), linked, kind, inner, said.count(AGAINST), said.count(OUTSIDE), text.endswith(_ENDS), titled))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        start = end if tag is None else tag.start()
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if any(n == "a" for n, _ in stack):
                linked += len(html.unescape(piece).split())
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name in BLOCK:
                close()
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            last = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = last.end() if last else end
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
            # a block ends an open paragraph, and an item the one before it
            for ended in ("p", *(("li",) if name == "li" else ()), *(("dt", "dd") if name in ("dt", "dd") else ()), *(("td", "th") if name in ("td", "th", "tr") else ())):
                open_ = [i for i, (n, _) in enumerate(stack) if n == ended]
                fence = max((i for i, (n, _) in enumerate(stack) if n in ("ul", "ol", "dl", "table")), default=-1)
                if open_ and (open_[-1] > fence or ended == "p"):
                    del stack[open_[-1] :]
            titled |= name == "h1"
        elif name == "br":
            parts.append(" ")
        if name not in VOID and not tag[3].rstrip().endswith("/"):
            if name == "a":
                stack[:] = [s for s in stack if s[0] != "a"]
            stack.append((name, cue(name, tag[3])))
    close()
    return out
