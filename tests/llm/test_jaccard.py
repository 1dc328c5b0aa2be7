"""The n-gram Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from heddle.llm import jaccard_join


def shingle_set(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root, links = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (find(i), links[i]) for i in range(len(sets))}


def corpus(seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdefg", k=4))
    out = ["", None, " ", "a", "a", "one two three", "one  two\nthree", "one two three four"]
    for _ in range(40):
        own = [word() for _ in range(pick.choice((5, 8, 40, 150, 400)))]
        out.append(" ".join(own))
        for _ in range(pick.choice((0, 0, 1, 3))):
            near = list(own)
            for _ in range(pick.randint(0, max(1, len(own) // 60))):
                near[pick.randrange(len(near))] = word()
            out.append(" ".join(near))
    boiler = " ".join(word() for _ in range(12))
    out += [boiler + " " + " ".join(word() for _ in range(30)) for _ in range(60)]
    family = [word() for _ in range(120)]
    for i in range(150):
        near = list(family)
        near[i % 120] = word()
        out.append(" ".join(near))
    return out


@pytest.mark.parametrize("options", [{}, {"small": 8, "block": 16}, {"small": 8, "block_bytes": 4000}])
def test_links_equal_all_pairs(spark, options):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.assign(docs, **options).collect()}
    assert got == brute(texts)


def test_keep_one_of_each_class(spark):
    texts = corpus(2)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    want = brute(texts)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.assign(empty).count() == jaccard_join.keep_one(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jaccard_join.assign(docs).collect()) == [(-1, -1, 0), (-1, 3, 2), (3, 3, 2), (3, 3, 2)]
    assert sorted((r.doc_id or -1, r.text) for r in jaccard_join.keep_one(docs).collect() if r.text) == [(3, "a b c d e f")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.node: r.root for r in jaccard_join.components(edges).collect()} == dict.fromkeys(range(1, 41), 1) | {100: 100, 101: 100}


def test_runs_reach_the_recall():
    assert jaccard_join.needed_runs(0.8, 1.6, 1.0, 1, 0.99) < jaccard_join.needed_runs(0.8, 1.6, 1.0, 4, 0.9999)
    rng = np.random.default_rng(0)
    met, runs = 0, jaccard_join.needed_runs(0.8, 1.6, 1.0, 1, 0.99)
    for _ in range(300):
        both = rng.integers(0, 2**63, 120).astype(np.uint64)
        a, b = both[:110], both[12:]  # 98 of 120: just above the threshold
        met += any(len(np.intersect1d(jaccard_join.chosen(a, s, 0.8, 1.6), jaccard_join.chosen(b, s, 0.8, 1.6))) for s in range(1, runs + 1))
    assert met >= 290


def test_one_of_each_class_stays_with_null_and_repeated_ids(spark):
    words = [f"word{k}" for k in range(200)]
    near = lambda k: " ".join([*words[:-1], f"end{k}"])
    other = lambda k: " ".join(w + "x" for w in near(k).split())
    rows = [(None, near(1), "a"), (None, near(2), "b"), (5, other(1), "c"), (5, other(2), "d"), (7, "alone but with enough words here", "e"), (7, "alone but with enough words here", "f"), (None, "", "g")]
    for order in (rows, rows[::-1]):
        got = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()]
        assert len(got) == 4 and (7, "alone but with enough words here", "e") in got and (None, "", "g") in got
        assert sum(r[0] is None and r[1] != "" for r in got) == sum(r[0] == 5 for r in got) == 1
        kept = sorted(got, key=str)
        assert order is rows or kept == first
        first = kept
