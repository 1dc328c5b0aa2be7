"""Quality classifier, HTML extraction, telephony audio and SentencePiece."""

import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import boosting, dom, html_extract, pieces, quality, queries, telephony


# Quality


def test_labels_are_recovered_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in quality.assess(docs).collect()}
    right = [got[i] == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) >= 0.95
    clean = [got[i] for i, q in labels.items() if q]
    assert sum(clean) / len(clean) >= 0.97


def test_em_finds_bad_labellers():
    pick = random.Random(1)
    counts = {}
    for _ in range(4000):
        good = pick.random() < 0.8
        votes = "".join("+" if pick.random() < (0.97 if good else 0.2) else "-" for _ in range(len(quality.LABELLERS) - 1))
        votes += pick.choice("+-")  # a labeller that knows nothing
        counts[votes] = counts.get(votes, 0) + 1
    model = quality.fit_labels(counts)
    assert abs(model.prior - 0.8) < 0.05
    assert abs(model.accuracy[0, 0, 0] - 0.8) < 0.1 and abs(model.accuracy[-1, 0, 0] - model.accuracy[-1, 1, 0]) < 0.1


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "  \n", 1.0), (None, "Plain words of a usual sentence.", 1.0), (None, "Plain words of a usual sentence.", 1.0)], "doc_id long, text string, score double")
    got = quality.assess(docs).collect()
    assert [r.kept for r in got if r.doc_id] == [False] * 3 and len({r.score for r in got if not r.doc_id}) == 1
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() <= 2
    assert quality.assess(docs.limit(0)).count() == 0


# HTML


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


@pytest.mark.parametrize("html", [None, "", "text only", "<", "<p", "<p><p></p></div></p>", "<!-- open", "<script>x", "<a<b<c", "<div>" * 3000 + "x", "&amp;&nbsp;&#x41;", '<p title="a > b">y</p>'])
def test_any_page_parses(html):
    page = dom.parse(html)
    assert dom.features(page).shape[0] == len(page.tags) == len(page.parents)


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attribute_values(quote):
    value = "{a > b, <p class=x>c</p> & d} " * 1000
    page = dom.parse(f"<p>before</p><div data-json={quote}{value}{quote} class='sidebar'>text</div><p>after")
    assert [t for _, t, _ in page.blocks] == ["before", "text", "after"] and page.tags == ["html", "p", "div", "p"]
    assert dom.hints(page.attrs[2])[list(dom.HINTS).index("side")] == 1


def test_blocks():
    page = dom.parse('<p>a  <b>b</b>c<br>d<p>e &lt;f&gt;\n g<ul><li>h<li><a href="/x">i</a></ul><script>var t="</p>";</script>')
    assert [t for _, t, _ in page.blocks] == ["a bc", "d", "e <f> g", "h", "i"]


@pytest.fixture(scope="module")
def model(spark, data):
    # As many layouts as a table of more pages gives with the default.
    return html_extract.fit(spark.read.parquet(f"{data}/pages.parquet"), layouts=16)


def test_extraction_of_known_and_new_layouts(spark, data, model):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    right = total = 0
    pick = random.Random(77)
    spare = [t for h in pages[:10] for _, t, _ in dom.parse(h).blocks]
    for html in pages:
        page = dom.parse(html)
        labels = html_extract.tag_labels(page)
        main = [t for (_, t, _), m in zip(page.blocks, labels, strict=True) if m]
        new, inside, _ = html_extract.laid_out(main[:20], spare, pick)
        for text, want in ((html, main), (new, inside)):
            own = dom.parse(text)
            right += html_extract.main_text(own, model.probability(dom.features(own))) == "\n".join(want)
            total += 1
    assert right / total >= 0.9


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul></nav>'
ADVERT = '<div class="advert">' + "Buy the finest garden chairs of the whole region now, delivered to your door within two days. " * 4 + "</div>"
FOOT = "<footer><p>Copyright 2024 The Example Company. All rights reserved.</p></footer>"
SIDE = '<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten ways to cook rice</a></li><li><a href="/2">The best lakes</a></li></ul></aside>'
COMMENTS = '<section class="comments"><h3>Comments</h3><div class="comment"><p>Great read, thank you so much for sharing this with us all!</p></div><div class="comment"><p>I disagree with the second point.</p></div></section>'
P1 = "The old bridge over the river was closed last week, because engineers found cracks in two of its pillars during a routine inspection."
P2 = "Repairs are expected to take about three months, and traffic will be led over the northern crossing until then, the city council said on Monday."
#: Pages written by hand: their parts, and the blocks of the article.
HANDMADE = {
    "paragraphs": (NAV, f"<article><h1>Bridge closed</h1><p>{P1}</p><p>{P2}</p></article>", FOOT, ["Bridge closed", P1, P2]),
    "table": (NAV, f"<article><h1>Opening hours</h1><p>{P1}</p><table><tr><th>Day</th><th>Hours</th></tr><tr><td>Monday</td><td>9 to 5</td></tr><tr><td>Sunday</td><td>closed</td></tr></table><p>{P2}</p></article>", FOOT, ["Opening hours", P1, "Day", "Hours", "Monday", "9 to 5", "Sunday", "closed", P2]),
    "figure": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p><figure><img src=b.jpg><figcaption>The bridge in 1950.</figcaption></figure><p>{P2}</p></article>", FOOT, ["Bridge", P1, "The bridge in 1950.", P2]),
    "quotation": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p><blockquote><p>We had no choice, the mayor said.</p></blockquote><p>{P2}</p></article>", FOOT, ["Bridge", P1, "We had no choice, the mayor said.", P2]),
    "one line": (NAV, "<article><p>Closed today.</p></article>", ADVERT, ["Closed today."]),
    "one line and heading": (NAV, "<main><h1>Notice</h1><p>The library opens at noon.</p></main>", FOOT, ["Notice", "The library opens at noon."]),
    "list": (NAV, f"<article><h1>What to bring</h1><p>{P1}</p><ul><li>Warm clothes</li><li>A torch</li><li>Some food</li></ul></article>", FOOT, ["What to bring", P1, "Warm clothes", "A torch", "Some food"]),
    "nested list": (NAV, f"<article><h1>Plan</h1><p>{P1}</p><ol><li>First day<ul><li>Arrival</li><li>Dinner</li></ul></li><li>Second day</li></ol><p>{P2}</p></article>", FOOT, ["Plan", P1, "First day", "Arrival", "Dinner", "Second day", P2]),
    "code": (NAV, f"<article><h1>How to</h1><p>{P1}</p><pre><code>make install</code></pre><p>{P2}</p></article>", FOOT, ["How to", P1, "make install", P2]),
    "headings": (NAV, f"<article><h1>Bridge</h1><h2>Cracks</h2><p>{P1}</p><h2>Repairs</h2><p>{P2}</p></article>", FOOT, ["Bridge", "Cracks", P1, "Repairs", P2]),
    "terms": (NAV, f"<article><h1>Words</h1><p>{P1}</p><dl><dt>Pier</dt><dd>A pillar of a bridge.</dd><dt>Span</dt><dd>What lies between two piers.</dd></dl></article>", FOOT, ["Words", P1, "Pier", "A pillar of a bridge.", "Span", "What lies between two piers."]),
    "sidebar": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></article>", SIDE + FOOT, ["Bridge", P1, P2]),
    "comments": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></article>", COMMENTS + FOOT, ["Bridge", P1, P2]),
    "comments within": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p><p>{P2}</p>{COMMENTS}</article>", FOOT, ["Bridge", P1, P2]),
    "advert within": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p>{ADVERT}<p>{P2}</p></article>", FOOT, ["Bridge", P1, P2]),
    "main tag": (NAV, f"<main><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></main>", SIDE + FOOT, ["Bridge", P1, P2]),
    "content class": ('<div class="menu"><a href="/">Home</a> <a href="/b">Blog</a></div>', f'<div class="content"><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></div>', '<div class="footer">Copyright 2024 Example.</div>', ["Bridge", P1, P2]),
    "no classes": ('<div><a href="/">Home</a> <a href="/b">Blog</a> <a href="/c">Shop</a></div>', f"<div><h1>Bridge</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p></div>", "<footer>Copyright 2024 Example.</footer>", ["Bridge", P1, P2, P1]),
    "cookie notice": ('<div class="cookie-notice"><p>We use cookies to improve your experience on our site.</p><button>Accept</button></div>' + NAV, f"<article><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></article>", FOOT, ["Bridge", P1, P2]),
    "form": (NAV, f"<article><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></article>", '<form class="newsletter"><label>Your e-mail address</label><input name=e><button>Subscribe</button></form>' + FOOT, ["Bridge", P1, P2]),
    "entities": (NAV, f"<article><h1>Caf&eacute; &amp; bar</h1><p>{P1}</p><p>Open &lt;daily&gt;   from\n9&nbsp;am.</p><p>{P2}</p></article>", FOOT, ["Café & bar", P1, "Open <daily> from 9 am.", P2]),
    "line breaks": (NAV, f"<article><h1>Poem</h1><p>{P1}</p><p>One line<br>and another<br>and a third</p></article>", FOOT, ["Poem", P1, "One line", "and another", "and a third"]),
    "links in text": (NAV, f'<article><h1>Bridge</h1><p>{P1} See <a href="/r">the full report</a> and <a href="/m">the map</a>.</p><p>{P2}</p></article>', FOOT, ["Bridge", P1 + " See the full report and the map.", P2]),
    "wrapped": ('<div id="page">' + NAV, f'<div class="row"><div class="col"><article class="post"><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></article></div></div>', FOOT + "</div>", ["Bridge", P1, P2]),
}


LOSSLESS = ['<svg viewBox="0 0 1 1"/>', "<canvas/>", "<svg-icon>i</svg-icon>", "<object-list>i</object-list>", "<textarea-x>i</textarea-x>", '<svg viewBox="0 0 1 1">', "<canvas>", "<textarea>", "<iframe src=x>", "<noscript>", "<template/>", "<title-bar>i", "<script-x/>", "<object data=x>i</object>", "<video-player>i"]


@pytest.mark.parametrize("odd", [*LOSSLESS, *[x.upper() for x in LOSSLESS]])
def test_odd_elements_take_no_text_with_them(odd):
    page = dom.parse(f"<article><h1>T</h1><p>First</p>{odd}<p>Second</p></article><p>Third")
    assert [t for _, t, _ in page.blocks if t.lower() != "i"] == ["T", "First", "Second", "Third"] and ("i" in odd.split(">")[1].lower()[:1]) == (len(page.blocks) == 5)


def test_hidden_elements_hide_what_they_hold():
    page = dom.parse("""<p>a</p><svg><text>x</text><svg/><svg><g>y</g></svg><foreignObject><p>z</p></foreignObject>v</svg><p>b</p><SCRIPT data-a="1>2">if (a</b) "</p>"</SCRIPT ><p>c
      <script src=/js/>w()</script><script src="x.js"/></p><p>d<style>p > a {}</style><noscript><p>js</p></noscript><textarea><p>t</p></textarea></p>e<template><p>f</template><p>g""")
    assert [t for _, t, _ in page.blocks] == ["a", "b", "c", "d", "e", "g"]


def test_elements_inserted_at_random_change_no_block():
    pick = random.Random(3)
    empty = ["<svg/>", "<svg><path d='M0 0'/></svg>", "<x-y a=1>", "</x-y>", "<img src=a>", "<wbr>", "<canvas></canvas>", "<script>1<2</script>", "<!-- <p> -->", "<svg-a/>", '<span title="<p>">', "</span>", "<math-x>", "<iframe src='a>b'></iframe>", "<object>", "</object>", "<style>p{}</style >", "<noscript/>"]
    for _ in range(300):
        words = [f"w{k}" for k in range(pick.randrange(1, 12))]
        made = "".join("".join(pick.choices(empty, k=pick.randrange(3))) + f"<{tag}>{w}</{tag}>" for w in words for tag in [pick.choice(["p", "div", "li", "h2", "td"])])
        assert [t for _, t, _ in dom.parse(made + "".join(pick.choices(empty, k=2))).blocks] == words


def test_many_unclosed_elements_take_linear_time():
    import time

    began = time.time()
    page = dom.parse("<textarea>a<svg>b<iframe>c" * 60_000 + "<p>end")
    assert page.blocks[-1][1] == "end" and time.time() - began < 20


def test_attribute_words_of_any_language_are_features():
    a, b = (dom.features(dom.parse(f"<div class='{name}'><p>x</p></div>")) for name in ("хлебные-крошки", "contenido"))
    assert (a[1] != b[1]).any() and (a[2] != b[2]).any() and (a[0] == b[0]).all()


def test_decoding_finds_the_best_states():
    """Against all ways to give the nodes of small trees their states."""
    rng = np.random.default_rng(6)
    for _ in range(150):
        n = int(rng.integers(2, 7))
        page = dom.Page(["html", *["div"] * (n - 1)], [""] * n, [-1, *[int(rng.integers(0, i)) for i in range(1, n)]], [0] * n)
        page.blocks = [(i, "text", 0) for i in range(n) if rng.random() < 0.7] or [(n - 1, "text", 0)]
        p = rng.random(n)
        own = {i for i, _, _ in page.blocks}
        full = {i for i in range(n) if any(_above(page.parents, k, i) for k in own)}

        def worth(states):
            total = 0.0
            for i, state in enumerate(states):
                above = states[page.parents[i]] if i else "out"  # noqa: B023
                if (above, state) not in {("out", "out"), ("out", "in"), ("in", "in"), ("in", "cut"), ("cut", "cut")}:
                    return -math.inf
                total -= (above, state) in {("out", "in"), ("in", "cut")}
                chance = p[i] if state == "in" else 1 - p[i]  # noqa: B023
                total += math.log(np.clip(chance, 1e-4, 1)) if (i in own if state == "out" else i in full) else 0  # noqa: B023
            return total

        best = max(worth(s) for s in itertools.product(("out", "in", "cut"), repeat=n))
        main = html_extract.decode(page, p)
        begun, states = [False] * n, []
        for i in range(n):
            begun[i] = bool(i) and (begun[page.parents[i]] or main[page.parents[i]])
            states.append("in" if main[i] else "cut" if begun[i] else "out")
        assert abs(worth(states) - best) < 1e-9


def _above(parents, node, ancestor):
    while node >= 0:
        if node == ancestor:
            return True
        node = parents[node]
    return False


@pytest.mark.parametrize("name", HANDMADE)
def test_extraction_of_handmade_pages(model, name):
    before, article, after, blocks = HANDMADE[name]
    page = dom.parse(f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{article}{after}</body></html>")
    assert html_extract.main_text(page, model.probability(dom.features(page))).split("\n") == [" ".join(b.split()) for b in blocks]


def test_extraction_of_held_out_pages(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect()]
    half = html_extract.fit_pages(pages[::2], layouts=16)
    right = 0
    for html in pages[1::2]:
        page = dom.parse(html)
        main = [t for (_, t, _), m in zip(page.blocks, html_extract.tag_labels(page), strict=True) if m]
        right += html_extract.main_text(page, half.probability(dom.features(page))) == "\n".join(main)
    assert right >= 0.95 * len(pages[1::2])


def test_decoding_is_consistent(model):
    pick = random.Random(5)
    for _ in range(50):
        page = dom.parse("".join(pick.choice(["<div>", "</div>", "<p>x y z", "<ul><li>a", "</ul>", "<section class=ad>"]) for _ in range(60)))
        main = html_extract.decode(page, np.random.default_rng(pick.randrange(99)).random(len(page.tags)))
        begun = [False] * len(main)
        for i in range(1, len(main)):
            p = page.parents[i]
            begun[i] = begun[p] or main[p]
            assert main[p] or not begun[p] or not main[i]  # nothing comes back below a cut


def test_pages_of_odd_tables(spark, model):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p></p>"), (3, "u", "<article><p>" + "word " * 50_000 + "</article>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages, model=model).collect()}
    assert got[1] == got[2] == got[None] == "" and len(got[3]) == 249_999
    assert html_extract.extract(pages.limit(0)).count() == 0


# Telephony


def test_companding_tables():
    mu, a = telephony.mulaw_table().astype(int), telephony.alaw_table().astype(int)
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def adpcm_one(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(telephony.INDEX_MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_equals_one_block_at_a_time():
    blocks = np.random.default_rng(2).integers(0, 256, (20, 64)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [adpcm_one(b.tolist()) for b in blocks]


def slow_expand(code, tag):
    """One companded sample, bit by bit."""
    if tag == telephony.MULAW:
        code = 255 - code
        value = ((code % 16 * 8 + 132) << (code // 16 % 8)) - 132
        return -value if code >= 128 else value
    code ^= 85
    segment, value = code // 16 % 8, code % 16 * 16 + 8
    value = value if segment == 0 else (value + 256) << (segment - 1)
    return value if code >= 128 else -value


def test_features_equal_plain_python(spark):
    texts = ["", "a telephone rings", "é" * 90, "Zwölf Boxkämpfer " * 40, "x"] + [f"text {i} " * i for i in range(12)]
    got = {r.doc_id: r for r in telephony.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    laws = set()
    for i, text in enumerate(texts):
        payload = telephony.padded(text.encode())
        tag = telephony.law_of(payload)
        laws.add(tag)
        x = [slow_expand(c, tag) for c in payload]
        pcm = []
        for k in range(len(x)):
            a, b, c, d = x[max(0, k - 1)], x[k], x[min(len(x) - 1, k + 1)], x[min(len(x) - 1, k + 2)]
            pcm += [b, max(-32768, min(32767, (9 * (b + c) - a - d + 8) // 16))]
        assert np.frombuffer(telephony.stored_payload(bytes(got[i].pcm))[0], "<i2").tolist() == pcm
        blocks = [telephony.decode_adpcm(np.frombuffer(payload[k : k + 64], np.uint8).reshape(1, -1))[0].tolist() for k in range(0, len(payload), 64)]
        rms = lambda v: round(math.sqrt(sum(y * y for y in v) / len(v)))
        turns = lambda v: sum((a < 0) != (b < 0) for a, b in zip(v, v[1:], strict=False))
        flat = [y for b in blocks for y in b]
        assert got[i].feature == f"{telephony.LAWS[tag]}>pcm16000:n={len(pcm)};rms={rms(pcm)};turns={turns(pcm)};adpcm:rms={rms(flat)};turns={sum(map(turns, blocks))}"
    assert laws == {telephony.MULAW, telephony.ALAW}


def test_stored_payloads_come_back(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "z" * 3_000_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in telephony.text_media(docs).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = telephony.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) > 0 and telephony.stored_payload(bytes(got[i].media)) == (payload, telephony.law_of(payload))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i].media_sha256 == hashlib.sha256(got[i].media).hexdigest() and got[i].media_bytes == len(got[i].media)
        assert telephony.stored_payload(bytes(got[i].pcm))[1] == 1
        assert (got[i].pcm_bytes, got[i].pcm_sha256) == (len(got[i].pcm), hashlib.sha256(got[i].pcm).hexdigest())
    assert got[2].feature == got[6].feature and got[0].feature == got[1].feature
    assert telephony.text_media(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        telephony.stored_payload(b"nothing")


# SentencePiece


def toy():
    words = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "ba": -4.0, "aba": -5.0, "▁ab": -4.5}
    return pieces.Pieces(words, {w: 300 + i for i, w in enumerate(words)}, list(range(256)))


def exhaustive(own, unit):
    """All segmentations of a unit with their scores."""
    if not unit:
        return [(0.0, ())]
    out = []
    for n in range(1, len(unit) + 1):
        head = unit[:n]
        if head in own.scores or (n == 1 and head not in own.scores):
            score = own.scores.get(head, own.unknown)
            out += [(score + s, own.to_ids(unit, [(0, n)]) + rest) for s, rest in exhaustive(own, unit[n:])]
    return out


@pytest.mark.parametrize("text", ["ab", "abab ba", "aab abx a", "a\nb ▁a", "x"])
def test_n_best_equals_exhaustive_search(text):
    own = toy()
    units = own.units(text)
    each = [exhaustive(own, u) if u is not None else [(own.unknown, own.known().path(None)[0])] for u in units]
    every = [sum(p[0] for p in c) for c in itertools.product(*each)]
    got = own.encode(text, 5)
    assert np.allclose([s for s, _ in got], heapq.nlargest(min(5, len(every)), every))
    assert len({tuple(i.tolist()) for _, i in got}) == len(got)
    assert all(own.decode(i.tolist()) == text for _, i in got)


def test_real_vocabulary_round_trips(spark, data):
    own = queries.load_pieces()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " "), (-4, "▁ ▁x  \t😀\u0000"), (-5, "q" * 100_000), (-5, "q" * 100_000)], "doc_id long, text string"))
    rows = pieces.encode(docs, own, n=3)
    assert rows.filter("NOT decodes").count() == 0 and rows.count() == docs.count()
    back = pieces.decode(rows, own).select("doc_id", F.col("text").alias("decoded")).join(docs, "doc_id")
    assert back.filter("decoded != coalesce(text, '')").count() == 0
    for unit in ("▁therefore", "▁internationally", "▁Größe"):
        best = own.best_of(unit)
        assert own.best(unit) == best and own.n_best(unit, 2)[0] == (best[1], best[0])
        assert own.n_best(unit, 2)[0][0] - own.n_best(unit, 2)[1][0] == best[2]


def test_scores_are_log_probabilities_and_sums_are_exact():
    own = queries.load_pieces()
    assert abs(sum(math.exp(x) for x in own.scores.values()) - 1) < 1e-3
    assert all(float(x / pieces.GRAIN).is_integer() for x in own.scores.values())
    with open(f"{queries.TOKENIZERS}/{queries.MODEL}", "rb") as file:
        assert pieces.model_type(file.read()) == pieces.BPE
    text = "The committee decided that the international conference would be held in the following year."
    best = own.encode(text, 4)
    assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
    spelled = {i: x for x, i in own.ids.items()}
    assert all(abs(s - sum(own.scores[spelled[i]] for i in ids.tolist())) == 0 for s, ids in best)


def test_forgetting_changes_nothing(monkeypatch):
    own, other = queries.load_pieces(), queries.load_pieces()
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    texts = [" ".join(f"word{i * j % 37}" for j in range(30)) for i in range(40)] + ["", "▁"]
    few = [(s, ids.tolist()) for i in range(0, len(texts), 5) for s, ids, _ in other.encode_many(texts[i : i + 5], 3)]
    monkeypatch.undo()
    assert few == [(s, ids.tolist()) for s, ids, _ in own.encode_many(texts, 3)]


def test_n_best_segmentations_come_back_from_spark(spark):
    own = toy()
    texts = ["ab", "abab ba", None, "", "aab abx a", "a\nb ▁a", "x", "ab" * 400]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for keep_ids in (True, False):
        got = {int(r.doc_id): r for r in pieces.encode(docs, own, n=5, keep_ids=keep_ids).collect()}
        for i, text in enumerate(texts):
            want = [(s, x.tolist()) for s, x in own.encode(text, 5)]
            assert [(p.score, p.ids) for p in got[i].n_best] == want
            assert all(own.decode(p.ids) == (text or "") for p in got[i].n_best)
    assert pieces.encode(docs.limit(0), own, n=5).count() == 0
