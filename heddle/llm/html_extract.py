"""Main text of web pages: gradient-boosted trees over the nodes of a page, decoded as a hierarchy.

The trees score every block node from its text density, attribute words (all of them hashed, and those that hint at
a part of a page), depth and siblings. Decoding
chooses, over all nodes of a page at once, the most probable states: outside the main text, inside it,
or cut out of it. A node inside follows its ancestors, and nothing below a cut comes back, so an
ancestor's and a descendant's choice never contradict.

No labels are given: training pages are the table's own pages (at most `sample` of them, each at most
`longest` characters, those of smallest hash), labelled where their semantic tags say what is what, and
the same texts laid out anew with other tags, attribute words and orders, so that the model reads more
than the table's own markup.

Defined results: null and empty pages, and pages without text, give an empty text; pages of any length
are read whole; unclosed and stray tags are closed or ignored; what stands in scripts, styles, templates, text fields,
drawings (svg) and frames, and what browsers show only without scripts or canvases, is no text; a table without any page to train on
falls back on training layouts of a few fixed words; extra columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import boosting, dom
from heddle.llm.common import hash60, small_batches

MAIN, REST = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))


def tag_labels(page: dom.Page) -> np.ndarray | None:
    """For each block of text, whether semantic tags put it into the main text; None where they don't say."""
    if not MAIN & set(page.tags):
        return None
    state = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        tag = page.tags[i]
        own = dom.hints(page.attrs[i])
        ruled_out = tag in REST or (tag in ("div", "section", "ul", "ol") and own[2:].any() and not own[0])
        state[i] = not ruled_out and (tag in MAIN or state[page.parents[i]])
    return np.array([state[node] for node, _, _ in page.blocks])


def node_labels(page: dom.Page, blocks: np.ndarray) -> np.ndarray:
    """1 or 0 where nearly all of a node's text is main or not, else -1."""
    main, total = np.zeros(len(page.tags)), np.zeros(len(page.tags))
    for (node, text, _), label in zip(page.blocks, blocks, strict=True):
        main[node] += len(text) * bool(label)
        total[node] += len(text)
    for i in range(len(page.tags) - 1, 0, -1):
        main[page.parents[i]] += main[i]
        total[page.parents[i]] += total[i]
    share = main / np.maximum(1, total)
    return np.where(total == 0, -1, np.where(share >= 0.95, 1, np.where(share <= 0.05, 0, -1)))


#: Ways to mark up the parts of a training page: tags, and attribute words.
PARTS = {
    "main": (("article", ""), ("main", ""), ("article", "post entry"), ("div", "content"), ("div", "post-content"), ("div", "article-body"), ("div", "story"), ("div", "entry-content"), ("section", "article"), ("section", "content"), ("div", "main"), ("div", "")),
    "nav": (("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "navbar"), ("div", "breadcrumbs"), ("nav", "main-menu")),
    "header": (("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"), ("div", "top-bar")),
    "footer": (("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "bottom legal")),
    "side": (("aside", ""), ("div", "sidebar"), ("aside", "related"), ("div", "widget"), ("section", "related-posts"), ("div", "popular")),
    "ad": (("div", "ad"), ("div", "advert"), ("aside", "promo"), ("div", "sponsored"), ("section", "banner-ad"), ("div", "ads")),
    "notice": (("div", "cookie-notice"), ("div", "consent"), ("section", "newsletter"), ("div", "alert"), ("dialog", ""), ("div", "popup")),
    "form": (("form", ""), ("form", "search"), ("div", "login-form"), ("form", "signup")),
    "comment": (("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "discussion"), ("ul", "replies"), ("div", "comment")),
    "share": (("div", "share"), ("ul", "social"), ("div", "tags"), ("div", "byline meta")),
}


def chunks(text: str, most: int, pick: random.Random) -> list[str]:
    """The words of a text in at most `most` parts of similar length."""
    words = text.split()
    n = min(len(words), pick.randint(1, most))
    cuts = [len(words) * k // n for k in range(n + 1)] if n else [0]
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def inline(text: str, pick: random.Random) -> str:
    """An escaped text, at times with links and emphasis in it."""
    words = [escape(w) for w in text.split()]
    for tag in pick.choices(("a href=/x", "b", "em", "span"), (3, 1, 1, 1), k=pick.choice((0, 0, 0, 1, 2, 4))):
        at = pick.randrange(len(words)) if words else 0
        end = min(len(words), at + pick.randint(1, 5))
        if words:
            words[at], words[end - 1] = f"<{tag}>{words[at]}", f"{words[end - 1]}</{tag.split()[0]}>"
    return " ".join(words)


def laid_row(text: str, pick: random.Random) -> tuple[str, list[str]]:
    """A text of an article as a paragraph, quotation, list, table, figure, code or the like, and its blocks."""
    kind = pick.choices(("p", "quote", "list", "nested", "table", "figure", "pre", "terms", "heading", "div"), (50, 8, 8, 5, 8, 6, 4, 4, 5, 4))[0]
    parts = chunks(text, 8, pick)
    cells = [escape(x) for x in parts]
    if kind == "quote":
        return pick.choice(("<blockquote><p>{}</p></blockquote>", "<blockquote>{}</blockquote>", "<blockquote class=quote><p>{}</p></blockquote>")).format(escape(text)), [text]
    if kind == "list":
        tag = pick.choice(("ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in cells) + f"</{tag}>", parts
    if kind == "nested" and len(parts) > 1:
        return f"<ul><li>{cells[0]}<ul>" + "".join(f"<li>{x}</li>" for x in cells[1:]) + "</ul></li></ul>", parts
    if kind == "table":
        wide = pick.randint(1, 4)
        lines = [cells[k : k + wide] for k in range(0, len(cells), wide)]
        head = pick.random() < 0.5
        rows = ["<tr>" + "".join(f"<{'th' if head and not k else 'td'}>{x}</{'th' if head and not k else 'td'}>" for x in line) + "</tr>" for k, line in enumerate(lines)]
        return pick.choice(("<table>{}</table>", "<table class=data><tbody>{}</tbody></table>", "<div class=table-wrap><table>{}</table></div>")).format("".join(rows)), parts
    if kind == "figure":
        caption = " ".join(text.split()[: pick.randint(2, 20)])
        return pick.choice(("<figure><img src=a.png><figcaption>{}</figcaption></figure>", "<figure><figcaption>{}</figcaption><img src=a.png></figure>")).format(escape(caption)), [caption]
    if kind == "pre":
        return f"<pre><code>{escape(text)}</code></pre>", [text]
    if kind == "terms" and len(parts) > 1:
        return "<dl>" + "".join(f"<{('dt', 'dd')[k % 2]}>{x}</{('dt', 'dd')[k % 2]}>" for k, x in enumerate(cells)) + "</dl>", parts
    if kind == "heading":
        head = " ".join(text.split()[: pick.randint(2, 8)])
        rest = " ".join(text.split()[8:]) or head
        return f"<h2>{escape(head)}</h2><p>{escape(rest)}</p>", [head, rest]
    return (f"<div>{inline(text, pick)}</div>" if kind == "div" else f"<p>{inline(text, pick)}</p>"), [text]


def laid_out(main: list[str], spare: list[str], pick: random.Random) -> tuple[str, list[str], set[str]]:
    """A page with the texts `main` in its main part and texts of `spare` around and within it; the blocks of the main part, and the texts around."""
    around: set[str] = set()

    def words(low: int, high: int) -> str:
        text = pick.choice(spare).split() or ["word"]
        at = pick.randrange(len(text))
        out = " ".join(text[at : at + pick.randint(low, high)])
        around.add(out)
        return escape(out)

    def part(kind: str) -> str:
        tag, name = pick.choice(PARTS[kind])
        mark = f' {pick.choice(("class", "id"))}="{name}"' if name else ""
        if kind in ("nav", "share") or kind == "side" and pick.random() < 0.5:
            items = [f'<a href="/x">{words(1, 5)}</a>' for _ in range(pick.randint(2, 8))]
            inner = "".join(f"<li>{x}</li>" for x in items) if tag in ("ul", "ol") else "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if pick.random() < 0.7 else " ".join(items)
        elif kind == "comment":
            row = "li" if tag in ("ol", "ul") else pick.choice(("div", "p", "article"))
            inner = f"<h3>{words(1, 3)}</h3>" * (pick.random() < 0.5) * (row != "li") + "".join(f"<{row}{pick.choice(('', ' class=comment'))}><p>{words(4, 60)}</p></{row}>" for _ in range(pick.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button>"
        elif pick.random() < 0.4:
            inner = words(2, 60)
        else:
            row = pick.choice(("p", "span", "div"))
            inner = "".join(f"<{row}>{words(2, 25)}</{row}>" for _ in range(pick.randint(1, 3)))
        return f"<{tag}{mark}>{inner}</{tag}>"

    tag, name = pick.choice(PARTS["main"])
    short = pick.random() < 0.25
    texts = [" ".join(x.split()) for x in main if x.split()]
    if short:  # an article of one or two short lines
        texts = [" ".join(x.split()[: pick.randint(1, 12)]) for x in texts[: pick.randint(1, 2)]]
    made = [laid_row(x, pick) for x in texts[1:]]
    if texts:
        made.insert(0, (f"<p>{escape(texts[0])}</p>" if short and pick.random() < 0.5 else f"<h1>{escape(texts[0])}</h1>", [texts[0]]))
    rows, inside = [r for r, _ in made], [b for _, blocks in made for b in blocks]
    for kind in pick.sample(("ad", "ad", "ad", "share", "side", "comment", "form"), pick.choice((0, 1, 1, 2, 2))):
        rows.insert(pick.randint(min(1, len(rows)), len(rows)) if kind == "ad" else len(rows), part(kind))
    body = f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{''.join(rows)}</{tag}>"
    before = [part(k) for k in ("notice", "header", "nav", "ad", "side", "form") if pick.random() < 0.5]
    after = [part(k) for k in ("share", "comment", "side", "ad", "notice", "form", "footer") if pick.random() < 0.5]
    wrap = pick.choice(("{}", '<div id="page">{}</div>', '<div class="wrapper"><div class="row">{}</div></div>'))
    return f"<html><body>{wrap.format(''.join(before) + body + ''.join(after))}</body></html>", inside, around


def fit_pages(pages: list[str], layouts: int = 4, seed: int = 4) -> boosting.Trees:
    """Trees fitted on pages with semantic tags, and on `layouts` new layouts of each."""
    pick = random.Random(seed)
    x, y = [], []
    parsed = [(page, labels) for page in map(dom.parse, pages) if page.blocks and (labels := tag_labels(page)) is not None and labels.any()]
    texts = [([t for (_, t, _), m in zip(p.blocks, labels, strict=True) if m][:40], [t for (_, t, _), m in zip(p.blocks, labels, strict=True) if not m]) for p, labels in parsed]
    if not texts:
        texts = [([f"A heading of {i} words", *(" ".join(f"word{k}" for k in range(30 + i + j)) + "." for j in range(4))], ["home about contact"]) for i in range(40)]
    spare = [t for main, rest in texts for t in (*main, *rest)]
    for page, labels in parsed:
        x.append(dom.features(page))
        y.append(node_labels(page, labels))
    for main, _ in texts:
        for _ in range(layouts):
            html, inside, around = laid_out(main[: pick.randint(2, 40)], spare, pick)
            page, wanted = dom.parse(html), set(inside)
            # A text that stands both within and around says nothing about its node.
            labels = np.array([t in wanted and t not in around for _, t, _ in page.blocks])
            x.append(dom.features(page))
            y.append(node_labels(page, labels))
    x, y = np.vstack(x), np.concatenate(y)
    return boosting.fit(x[y >= 0], y[y >= 0].astype(float))


def decode(page: dom.Page, p: np.ndarray, change: float = 1.0, cut_change: float = 1.0) -> list[bool]:
    """For each node, whether its text is main: the best states of the tree, from its leaves up.

    Beginning a main part costs `change` in log-probability, and cutting out of it costs `cut_change`.
    """
    n = len(page.tags)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    full = np.zeros(n, bool)
    for node, _, _ in page.blocks:
        full[node] = True
    for i in range(n - 1, 0, -1):
        full[page.parents[i]] |= full[i]
    own = {node for node, _, _ in page.blocks}
    cut, inside = np.where(full, no, 0.0), np.where(full, yes, 0.0)
    # A node outside whose texts are all its descendants' may hold any of them.
    outside = np.array([no[i] if i in own else 0.0 for i in range(n)])
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        cut[up] += cut[i]
        inside[up] += max(inside[i], cut[i] - cut_change)
        outside[up] += max(outside[i], inside[i] - change)
    main = [False] * n
    state = ["out"] * n
    for i in range(n):
        above = state[page.parents[i]] if i else "out"
        if above == "out":
            state[i] = "in" if inside[i] - change > outside[i] else "out"
        else:
            state[i] = "in" if above == "in" and inside[i] >= cut[i] - cut_change else "cut"
        main[i] = state[i] == "in"
    return main


def main_text(page: dom.Page, p: np.ndarray) -> str:
    main = decode(page, p)
    return "\n".join(text for node, text, _ in page.blocks if main[node])


def fit(pages: DataFrame, html_col: str = "html", sample: int = 200, longest: int = 100_000, layouts: int = 4) -> boosting.Trees:
    """Trees fitted on at most `sample` different pages of at most `longest` characters: those of the least hashes."""
    found = pages.select(F.col(html_col).alias("html")).filter(F.char_length("html").between(1, longest)).withColumn("key", hash60(F.col("html")))
    # About four times the sample is ordered, so that what tasks send doesn't grow with their number. Copies count once.
    different = found.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    found = found.filter(F.col("key") <= int((1 << 60) * min(1.0, 4 * sample / max(1, different)))).groupBy("key").agg(F.min("html").alias("html"))
    return fit_pages([r["html"] for r in found.orderBy("key").limit(sample).collect()], layouts)


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", model: boosting.Trees | None = None, **options) -> DataFrame:
    """Each page's `id_cols` and its main text."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(pages, html_col, **options))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                parsed = [dom.parse(html) for html in part["html"]]
                rows = [dom.features(page) for page in parsed]
                p = np.split(sent.value.probability(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1])
                out = part.drop(columns="html")
                yield out.assign(text=[main_text(page, own) for page, own in zip(parsed, p, strict=True)])

    keys = [f"key{i}" for i in range(len(id_cols))]
    kinds = [f"{k} {pages.schema[c].dataType.simpleString()}" for k, c in zip(keys, id_cols, strict=True)]
    used = pages.select(*[F.col(c).alias(k) for k, c in zip(keys, id_cols, strict=True)], F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = used.mapInPandas(batches, ", ".join([*kinds, "text string"]))
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, id_cols, strict=True)], "text")
