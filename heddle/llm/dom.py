"""A small tree of a page's blocks, with the features that the extraction model reads."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends these open elements, unless one of the barriers is in between.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "option": ("option", ("select",))}
#: Elements whose content is no text of the page, up to their end tag; without one, or closed in their own tag, only the tag goes.
#: A script or style that isn't closed takes the rest of the page with it.
HIDDEN = frozenset("script style textarea title iframe noscript template canvas".split())
#: Beside blocks, tags that end drawings in which they stand.
BREAKS = frozenset("b big br code em font i img s small span strike strong sub sup tt u var".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<[!?][^>]*+>
    |</(?P<end>[a-z][^\s/>]*+)[^>]*+>
    |<(?P<start>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<odd>[a-z][^\s/><]*+)[^<>]*+>
    |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in (*HIDDEN, "svg")}
NAMED = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words of attributes by what they hint at.
HINTS = {
    "main": "article post entry content story main body text prose markdown blog news page single",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager links skip",
    "header": "header masthead topbar logo hero top branding title",
    "footer": "footer copyright colophon legal bottom credits foot",
    "side": "sidebar aside rail widget related recommend recommended popular trending side secondary more teaser",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter subscribe paywall privacy announcement overlay",
    "form": "form search login signup signin input register contact poll survey",
    "comment": "comment comments reply replies disqus discussion respond thread commentlist reader feedback",
    "share": "share social tags meta byline author follow tools toolbar",
}
HINT_OF = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
TAG_GROUPS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "button", "select", "option", "legend", "search"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody", "thead", "tfoot"), ("div",), ("section",), ("body", "html"), ("figure", "figcaption"), ("dialog", "details", "summary")]
GROUP_OF = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}
N_HINTS, N_GROUPS = len(HINTS), len(TAG_GROUPS)


@dataclass
class Page:
    """Nodes in document order, parents before children; blocks of text in page order."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    controls: list[int] = field(default_factory=lambda: [0])
    #: (node, text, characters within links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def parse(html: str | None) -> Page:
    page, stack = Page(), [0]
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close_through(depth: int) -> None:
        nonlocal in_link
        del stack[depth:]
        in_link = False

    html = html or ""
    at, unclosed = 0, set()
    #: Open drawings, and foreign objects within them.
    drawn = within = 0

    def close_of(tag: str, at: int) -> re.Match | None:
        """The next end tag; where there is none, none is looked for again."""
        found = None if tag in unclosed else CLOSES[tag].search(html, at)
        if not found:
            unclosed.add(tag)
        return found

    while at < len(html):
        found = TOKEN.match(html, at)
        at = found.end()
        kind = found.lastgroup
        if kind == "text":
            if drawn:
                continue
            parts.append(found["text"])
            if in_link:
                linked += len(found["text"])
        elif kind in ("start", "attrs", "odd"):
            tag = (found["start"] or found["odd"]).lower()
            # A slash after an unquoted value belongs to the value.
            empty = found[0].endswith("/>") and not re.search(r"=[^\s\"'=]*/>$", found[0])
            if tag in HIDDEN:
                if not empty:
                    closing = close_of(tag, at)
                    at = closing.end() if closing else len(html) if tag in ("script", "style") else at
                continue
            if tag == "svg":
                drawn += not empty and (drawn > 0 or close_of(tag, at) is not None)
                continue
            if drawn:
                within += tag == "foreignobject" and not empty
                if within or tag not in BLOCKS and tag not in BREAKS:
                    continue
                drawn = 0
            if tag in BLOCKS:
                flush()
                if tag in ("html", "body"):
                    if tag == "html" or "body" in page.tags:
                        continue
                else:
                    for depth in range(len(stack) - 1, 0, -1):
                        above = page.tags[stack[depth]]
                        if above == "p":
                            close_through(depth)
                            break
                        if above not in ("p", "label"):
                            break
                    names, barriers = ENDS.get(tag, ("", ()))
                    names = names.split()
                    cut = 0
                    for depth in range(len(stack) - 1, 0, -1):
                        above = page.tags[stack[depth]]
                        if above in barriers:
                            break
                        if above in names:
                            cut = depth
                    if cut:
                        close_through(cut)
                page.tags.append(tag)
                page.attrs.append(found["attrs"] or "")
                page.parents.append(stack[-1])
                page.controls.append(0)
                stack.append(len(page.tags) - 1)
            elif tag in ("br", "hr"):
                flush()
            elif tag == "input":
                page.controls[stack[-1]] += 1
            elif tag == "a":
                in_link = True
        elif kind == "end":
            tag = found["end"].lower()
            if drawn:
                drawn -= tag == "svg"
                within = max(0, within - (tag == "foreignobject")) if drawn else 0
            elif tag in BLOCKS:
                flush()
                if tag not in ("html", "body"):
                    for depth in range(len(stack) - 1, 0, -1):
                        if page.tags[stack[depth]] == tag:
                            close_through(depth)
                            break
            elif tag == "a":
                in_link = False
            elif tag == "br":
                flush()
    flush()
    return page


WORDS = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![a-z])")
#: Places that the words of attributes are hashed to.
N_TOKENS = 48


def hints(attrs: str) -> np.ndarray:
    out = np.zeros(N_HINTS, np.float32)
    if attrs:
        for a, b, c in NAMED.findall(attrs):
            for word in WORDS.findall(a or b or c):
                at = HINT_OF.get(word.lower())
                if at is not None:
                    out[at] = 1
    return out


def tokens(attrs: str) -> np.ndarray:
    """The places of all attribute words, of whatever language."""
    out = np.zeros(N_TOKENS, np.float32)
    if attrs:
        for a, b, c in NAMED.findall(attrs):
            for word in WORDS.findall(a or b or c):
                out[crc32(word.lower().encode("utf-8", "replace")) % N_TOKENS] = 1
    return out


def features(page: Page) -> np.ndarray:
    """A row for each node: own and inherited tags and attribute words, text density, depth, siblings."""
    n = len(page.tags)
    parents = page.parents
    own_hints = np.stack([hints(a) for a in page.attrs])
    own_tokens = np.stack([tokens(a) for a in page.attrs])
    own_group = np.zeros((n, N_GROUPS), np.float32)
    for i, tag in enumerate(page.tags):
        at = GROUP_OF.get(tag)
        if at is not None:
            own_group[i, at] = 1
    sums = np.zeros((n, 5), np.float64)  # characters, linked characters, blocks, sentence marks, controls
    own = np.zeros(n)
    first = np.full(n, len(page.blocks), np.int64)
    for k, (node, text, linked) in enumerate(page.blocks):
        own[node] += len(text)
        sums[node, :4] += (len(text), linked, 1, text.count(".") + text.count(",") + text.count("!") + text.count("?"))
        first[node] = min(first[node], k)
    sums[:, 4] = page.controls
    nodes, depth, children, nth, alike = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    above_hints, above_tokens, above_group = np.zeros_like(own_hints), np.zeros_like(own_tokens), np.zeros((n, 6), np.float32)
    by_parent: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        nth[i] = children[p]
        children[p] += 1
        by_parent[p, page.tags[i]] = by_parent.get((p, page.tags[i]), 0) + 1
        above_hints[i] = np.maximum(above_hints[p], own_hints[p])
        above_tokens[i] = np.maximum(above_tokens[p], own_tokens[p])
        above_group[i] = np.maximum(above_group[p], own_group[p, :6])
    for i in range(n - 1, 0, -1):
        p = parents[i]
        sums[p] += sums[i]
        nodes[p] += nodes[i]
        first[p] = min(first[p], first[i])
    for i in range(1, n):
        alike[i] = by_parent[parents[i], page.tags[i]]
    chars, linked, blocks, marks, controls = sums.T
    total = max(1.0, chars[0])
    kin = np.array([children[p] if p >= 0 else 1 for p in parents])
    parent_chars = np.array([chars[p] if p >= 0 else total for p in parents])
    numbers = np.stack([
        np.log1p(chars), np.log1p(own), linked / np.maximum(1, chars), blocks, chars / np.maximum(1, blocks), chars / nodes, marks / np.maximum(1, chars) * 100, controls,
        depth, children, kin, nth / np.maximum(1, kin), alike, chars / total, chars / np.maximum(1, parent_chars), first / max(1, len(page.blocks)), np.full(n, np.log1p(total)), nodes,
    ], axis=1)
    return np.hstack([numbers.astype(np.float32), own_hints, above_hints, own_group, above_group, own_tokens, above_tokens])
