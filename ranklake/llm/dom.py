"""A tolerant reader of HTML: block nodes with their text, in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Tags, comments and declarations; a tag cut off by the end of the page too.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\s++|/|[^\s=>/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+|=)*+)>|"
    r"<[/a-zA-Z][^<>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

# HTML's void elements, elements whose content is no page text,
# and inline elements; every other element is a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
UNSEEN = RAW | frozenset("head template noscript select option datalist button svg iframe object audio video map".split())
IN_HEAD = frozenset("head base link meta noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var "
                   "math mfrac mi mn mo mover mroot mrow mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element of the key ends an open one of the value, up to a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
HOLDS = frozenset("ul ol menu dl table html body article section div main aside nav form".split())


@dataclass
class Node:
    """A block element, or a run of text (tag '#text') beside blocks."""

    tag: str
    names: str
    parent: int
    text: list[str] = field(default_factory=list)
    linked: int = 0
    label: int | None = None
    place: int = 0


def read(html: str | None, label: str | None = None) -> list[Node]:
    """Nodes of a page, parents before children; node 0 is the page.  Text that
    stands beside blocks, or is interrupted by them, becomes '#text' nodes, so
    text is only in leaves; ``place`` orders it.  ``label`` names an attribute
    that marks nodes of labelled pages (inherited by their children).  What a
    head cannot hold ends it; an element that would hide its text and is never
    closed hides nothing."""
    nodes = [Node("#page", "", -1)]
    open_: list[tuple[str, int]] = [("#page", 0)]  # tag, its block node
    html = html or ""
    at, unseen, links = 0, 0, 0
    run = -1  # the node that text goes to
    lower, closed = html.lower(), {}  # closed: where the last end tag of an element stands
    while at < len(html):
        m = MARKUP.search(html, at)
        end = m.start() if m else len(html)
        if end > at and open_[-1][0] == "head" and not html[at:end].isspace():
            open_.pop()
            unseen -= 1
        if end > at and not unseen:
            piece = unescape(html[at:end])
            if run < 0:
                if not piece.isspace():
                    top = open_[-1][1]
                    nodes.append(Node("#text", "", top, label=nodes[top].label))
                    run = len(nodes) - 1
            if run >= 0:
                nodes[run].text.append(piece)
                if links:
                    nodes[run].linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag in UNSEEN:
                if unseen and any(t == tag for t, _ in open_):
                    while open_[-1][0] != tag:
                        unseen -= open_.pop()[0] in UNSEEN
                    open_.pop()
                    unseen -= 1
                continue
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE or tag in VOID or not any(t == tag for t, _ in open_):
                if tag == "br" and run >= 0:
                    nodes[run].text.append(" ")
                continue
            while open_[-1][0] != tag:
                unseen -= open_.pop()[0] in UNSEEN
            open_.pop()
            run = -1
            links = 0
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if open_[-1][0] == "head" and tag not in IN_HEAD:
            open_.pop()
            unseen -= 1
        if tag in UNSEEN:
            if tag not in closed:
                closed[tag] = lower.rfind("</" + tag)
            if not m["attrs"].rstrip().endswith("/") and (tag == "head" or closed[tag] >= at):
                open_.append((tag, open_[-1][1]))
                unseen += 1
            continue
        if unseen:
            if tag not in INLINE and tag not in VOID and not m["attrs"].rstrip().endswith("/"):
                open_.append((tag, open_[-1][1]))  # so that its end tag ends nothing outside
            continue
        if tag == "a":
            links += 1
        if tag in INLINE:
            continue
        if tag in VOID:
            if run >= 0:
                nodes[run].text.append(" ")
            if tag == "hr":
                run = -1
            continue
        ends = ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] in ends:
                del open_[k:]
                break
            if open_[k][0] in HOLDS:
                break
        run, links = -1, 0
        attrs = m["attrs"]
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attrs)) if attrs else ""
        top = open_[-1][1]
        own = nodes[top].label
        if label and (got := re.search(rf'\b{label}="?([01])', attrs)):
            own = int(got[1])
        nodes.append(Node(tag, names, top, label=own))
        open_.append((tag, len(nodes) - 1))
    for i, n in enumerate(nodes):
        n.place = i
    return nodes
