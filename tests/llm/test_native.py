"""Sharding, exact deduplication and mixing."""

import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.llm import exact_dedup, mixing, sharding

TEXTS = ["", None, "a", "a", "a  b", "a\tb", "a b", " a b", "x" * 200_000, "\n", " ", "é b", "a b"]


def table(spark, texts=TEXTS, extra="keep_id"):
    return spark.createDataFrame([(i, t, "s%d" % (i % 3) if i % 4 else None, i) for i, t in enumerate(texts)], f"doc_id long, text string, source string, {extra} int")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def short(content):
    return F.substring(F.sha2(content, 256), 1, 1)


@pytest.mark.parametrize("heavy", [1000, 3])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, short])
def test_exact_groups_compare_content(spark, monkeypatch, digest, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", heavy)
    texts = TEXTS + [f"text {i % 60}" for i in range(150)]
    docs = table(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[normal(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.assign(docs, digest=digest).collect()}
    assert len(got) == len(texts)
    for members in groups.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (members[0], len(members), i == members[0])
    kept = exact_dedup.deduplicate(docs, digest=digest)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(m[0] for m in groups.values())


def test_exact_dedup_of_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.deduplicate(docs).collect()) == [(-1, "b"), (1, "a")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.assign(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_a_hot_digest_goes_to_many_tasks(spark):
    rows = [(i, "a hot text" if i % 2 else f"text {i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = exact_dedup.keyed(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), exact_dedup.sha256)
        winners = exact_dedup.salted(keyed, 16).filter("n > 1").collect()
        assert len(winners) == 16 and sum(r.n for r in winners) == 10_000
        hot = exact_dedup._resolved(keyed, 16).filter("group_size > 1")
        assert hot.select("spread").distinct().count() == exact_dedup.SPREADS
        assert hot.count() == 10_000 and {(r.keep_id, r.group_size) for r in hot.collect()} == {(1, 10_000)}
        assert exact_dedup.deduplicate(docs).count() == 10_001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_shards_are_even_and_slots_gapless(spark):
    texts = ["word " * (i % 37) + str(i) for i in range(3000)] + ["copy of a hot text " * 5] * 1500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.assign(docs).collect()
    assert len(got) == len(texts) and sharding.assign(docs).subtract(sharding.assign(docs)).count() == 0
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) / (sum(sizes.values()) / 8) < 1.02 and min(sizes.values()) / (sum(sizes.values()) / 8) > 0.98
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_follow_the_order_of_a_sort(spark):
    texts = ["word " * (i % 37) + str(i % 700) for i in range(3000)] + ["a hot text"] * 1500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.id: (r.k1, r.k2) for r in sharding.keyed(docs, "doc_id", "text").collect()}
    got = sharding.assign(docs, rows_per_run=100).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == sorted(keys, key=keys.get)
    places = defaultdict(list)
    for r in got:
        places[texts[r.doc_id], r.shard].append(r.slot)
    assert all(max(p) - min(p) == len(p) - 1 for p in places.values())


def test_splitters_equal_a_sort(spark):
    texts = ["x" * (i * 31 % 400) for i in range(2000)]
    keys = sharding.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    rows = sorted((r.k1, r.k2, r.size) for r in keys.collect())
    total, cuts = sum(r[2] for r in rows), sharding.splitters(keys.select("k1", "k2", "size"), 5, 0.001, 16)
    for nth, cut in enumerate(cuts, 1):
        passed = sum(size for a, b, size in rows if (a, b) < cut)
        assert abs(passed - total * nth / 5) <= max(0.001 * total / 5, max(r[2] for r in rows))


def test_shards_of_odd_tables(spark):
    got = sharding.assign(table(spark)).collect()
    assert len(got) == len(TEXTS) and {r.size for r in got if TEXTS[r.doc_id] is None} == {1}
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = sharding.assign(spark.createDataFrame([(None, "x")] * 20, "doc_id long, text string")).collect()
    assert len({r.shard for r in same}) == 1 and sorted(r.slot for r in same) == list(range(20))


def water_fill(sizes, weights, share=1.5, most=2.0):
    budget, full = share * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = budget - sum(most * sizes[i] for i in full)
        targets = {i: left * weights[i] / sum(weights[k] for k in open_) for i in open_}
        over = [i for i in open_ if targets[i] >= most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in full else targets[i] for i in range(len(sizes))]
        full |= set(over)
        if len(full) == len(sizes):
            return [most * s for s in sizes]


def test_mixing(spark):
    texts = [" ".join(["w"] * (i * 7 % 50)) for i in range(400)] + [None, "", "\t \n"]
    docs = table(spark, texts)
    sources = [("s%d" % (i % 3) if i % 4 else None) for i in range(len(texts))]
    got = mixing.assign(docs).collect()
    names = ["s0", "s1", "s2", None]
    sizes = [sum(len((t or "").split()) for t, s in zip(texts, sources, strict=True) if s == n) for n in names]
    want = dict(zip(names, water_fill(sizes, [5, 2, 1, 5]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and abs(r.target - want[sources[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
    # Whole documents: off by at most half of one.
    assert all(abs(taken[n] - want[n]) <= max(sizes and [r.size for r in got if sources[r.doc_id] == n]) / 2 + 1 for n in names)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        words[r.doc_id] += len((r.text or "").split())
    assert all(words[r.doc_id] == r.taken for r in got)


def test_mixing_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.assign(empty).count() == mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.assign(blank).collect()] == [(0.0, 0)] * 2


def test_rows_that_repeat_an_id_keep_the_same_one(spark):
    rows = [(1, "a  b", f"x{k}", {"k": k}) for k in (3, 1, 2)] + [(1, "c", "y", None), (None, "a b", "z", None)]
    schema = "doc_id long, text string, source string, extra map<string,int>"
    for order in (rows, rows[::-1]):
        got = exact_dedup.deduplicate(spark.createDataFrame(order, schema).repartition(3)).collect()
        assert sorted((r.doc_id, r.text, r.source) for r in got) == [(1, "a  b", "x1"), (1, "c", "y")]
