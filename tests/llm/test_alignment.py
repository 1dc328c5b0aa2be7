"""Alignment of two tokenizers against whole tokenizing and a plain count."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from heddle.llm import alignment, exchange, queries

PAIR = queries.load_pair()


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, tokenized whole."""
    docs = []
    for text in texts:
        a, b = [], []
        if text:
            a = PAIR.a.encode(" " + text, add_special_tokens=False).ids
            b = PAIR.b.encode(text)
            whole = (" " + text).encode()
            if b"".join(PAIR.a_bytes[i] for i in a) != whole or b"".join(PAIR.b_bytes[i] for i in b) != whole:
                a, b = [], []
        a_ends, b_ends = (list(accumulate(len(spelled[i]) for i in ids)) for spelled, ids in ((PAIR.a_bytes, a), (PAIR.b_bytes, b)))
        groups = []
        last = 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            groups.append(([i for i, e in zip(a, a_ends, strict=True) if last < e <= cut], [i for i, e in zip(b, b_ends, strict=True) if last < e <= cut]))
            last = cut
        docs.append((a, b, groups))
    links = [Counter((x, y) for g in d[2] for x in g[0] for y in g[1]) for d in docs]
    held = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (a, b, groups), own in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), own.total(), sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def aligned(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, block string")
    return [tuple(r)[1:] for r in sorted(alignment.align(docs, PAIR).collect(), key=lambda r: r.doc_id)]


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\n\n end \r\n x", "déjà vu, naïve 中文字符 テスト", "emoji 😀😀 👩‍👩‍👧 end", "a ▁ b", "<|endoftext|> and <0x41> <s> </s>", "don't we'll I'm", "x" * 300, "1234567890 12 34", " nbsp  em", "a\u0000b", "ﬁ é ​ z", "don't", "don't"]


def test_odd_texts(spark):
    assert aligned(spark, ODD) == plain(ODD)


def test_documents(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    assert aligned(spark, texts) == plain(texts)


def test_long_texts_are_dealt_out(spark, monkeypatch):
    pick = random.Random(2)
    words = ["the", "naïve", "über", "données", "1234", "don't", "中文", "😀", "internationalization", "--", "x\ny", "a  b"]
    texts = [" ".join(pick.choice(words) for _ in range(n)) for n in (30, 300, 900)]
    texts += ["中文字符" * 200, "ab" * 700, "- " * 300, None, texts[1], "x ▁ y " * 100]
    want = plain(texts)
    for name, value in (("LONG", 100), ("RANGE", 37), ("FAN", 2), ("BLOCK", 50), ("TEXTS", 2), ("REMEMBERED", 5), ("LARGE", 3)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(exchange, "FAN", 2)
    assert aligned(spark, texts) == want


def test_fragments_compose_in_any_order():
    pick = random.Random(4)
    for _ in range(200):
        end = pick.randrange(1, 40)
        a_ends = sorted({*pick.sample(range(1, end + 1), pick.randrange(0, end)), end})
        b_ends = sorted({*pick.sample(range(1, end + 1), pick.randrange(0, end)), end})
        a, b = [pick.randrange(3) for _ in a_ends], [pick.randrange(3) for _ in b_ends]
        arrays = [np.array(x, np.int64) for x in (a, a_ends, b, b_ends)]
        bounds = sorted({0, end, *(pick.randrange(end + 1) for _ in range(6))})
        parts = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            one, two = (slice(*np.searchsorted(ends, [lo, hi], "right")) for ends in (arrays[1], arrays[3]))
            parts.append(alignment.fragment(PAIR, arrays[0][one], arrays[1][one], arrays[2][two], arrays[3][two]))
        while len(parts) > 1:
            at = pick.randrange(len(parts) - 1)
            parts[at : at + 2] = [alignment.composed(PAIR, parts[at], parts[at + 1])]
        got = alignment.composed(PAIR, alignment.BEGIN, parts[0])
        groups, last = [], 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if last < e <= cut] for ids, ends in ((a, a_ends), (b, b_ends))))
            last = cut
        links = Counter(x << alignment.SHIFT | y for g in groups for x in g[0] for y in g[1])
        assert got.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.tail) == (len(a), len(b), len(groups), links.total(), ([], []))
        assert dict(zip(*(x.tolist() for x in got.links), strict=True)) == links


def test_empty_table(spark):
    assert aligned(spark, []) == []


@pytest.mark.parametrize("n", [1, 7])
def test_sums_over_blocks(n):
    codes = np.random.default_rng(n).integers(0, 50, 400).astype(np.uint64)
    got = dict(zip(*(x.tolist() for x in exchange.add_up(codes, np.ones(400, np.int64))), strict=True))
    assert got == Counter(codes.tolist())
    seen = [i for _, at in exchange.dealt(codes, n) for i in at.tolist()]
    assert sorted(seen) == list(range(400))
