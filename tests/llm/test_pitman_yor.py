"""The Pitman-Yor scores against plain counts, exact seatings and a plain use of the sampled tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from heddle.llm import exchange, pitman_yor

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in WORD.findall(lower)] + [pitman_yor.END]


def trains(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def plain_base(rows):
    c = Counter(t for i, x in rows if trains(i) for t in tokens_of(x))
    n, v = c.total(), len(c)
    return sorted(((i, not trains(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for i, x in rows for ts in [tokens_of(x)]), key=str)


def assessed(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    return pitman_yor.assess(docs, **options).collect()


def base_of(got):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str)


def test_base_scores_of_documents_and_gain(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = assessed(spark, rows)
    assert base_of(got) == plain_base(rows)
    for held in (True, False):
        assert sum(r.score for r in got if r.held_out == held) > sum(r.base_score for r in got if r.held_out == held)
    assert got == assessed(spark, rows)


def test_odd_texts_and_split_texts(spark, monkeypatch):
    pick = random.Random(1)
    rows = [(i, " ".join(pick.choice("the Red FOX ran É\tx") for _ in range(pick.randrange(60)))) for i in range(60)]
    rows += [(None, None), (None, "the fox"), (7, "the fox"), (7, "the fox"), (8, ""), (9, " \x0b\n"), (10, "word " * 5000), (11, "w" * 9000)]
    whole = assessed(spark, rows)
    assert base_of(whole) == plain_base(rows)
    monkeypatch.setattr(pitman_yor, "BLOCK", 40)
    monkeypatch.setattr(pitman_yor, "READ", 50)
    monkeypatch.setattr(exchange, "FAN", 3)
    split = assessed(spark, rows)
    assert base_of(split) == plain_base(rows)
    mean = lambda got: sum(r.score for r in got) / sum(r.n_tokens for r in got)
    assert abs(mean(whole) - mean(split)) < 0.02  # other buckets draw other seatings


@pytest.mark.parametrize("rows", [[], [(None, "held out only")], [(1, None)]])
def test_small_tables(spark, rows):
    got = assessed(spark, rows)
    assert base_of(got) == plain_base(rows) and all(math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("seat, off", [(pitman_yor.seat, 0.005), (pitman_yor.seat_each, 0.02)])
@pytest.mark.parametrize("customers, weight, more, discount", [(2, 0.4, 0.1, 0.5), (6, 1.5, 0.3, 0.7), (9, 0.05, 0.01, 0.2)])
def test_seatings_have_their_probabilities(customers, weight, more, discount, seat, off):
    # Exact: seatings of t tables weigh the product of the new tables' weights and the generalised Stirling number.
    stirling = np.zeros((customers + 1, customers + 2))
    stirling[0, 0] = 1
    for n in range(1, customers + 1):
        for t in range(1, n + 1):
            stirling[n, t] = stirling[n - 1, t - 1] + (n - 1 - discount * t) * stirling[n - 1, t]
    exact = np.array([stirling[customers, t] * np.prod([weight + more * j for j in range(t)]) for t in range(1, customers + 1)])
    exact /= exact.sum()
    n = 200_000
    got = seat(np.full(n, customers), np.full(n, weight), np.full(n, more), discount, np.random.default_rng(3))
    assert np.abs(np.bincount(got, minlength=customers + 1)[1:] / n - exact).max() < off


def test_long_queues_are_seated_in_runs():
    rng, n = np.random.default_rng(1), 400
    step = lambda: pitman_yor.seat_each(np.full(n, 5000), np.full(n, 2.0), np.full(n, 0.02), 0.5, rng, 1).mean()
    runs = step()
    pitman_yor.EXACT, kept = 10_000, pitman_yor.EXACT
    try:
        assert abs(runs / step() - 1) < 0.05
    finally:
        pitman_yor.EXACT = kept


def test_scores_use_the_sampled_tables(spark):
    """Every text's score, computed plainly from the sampled seatings; probabilities of each context sum to one."""
    pick = random.Random(5)
    words = ["a", "b", "c", "d", "e", "f"]
    rows = [(i, " ".join(pick.choices(words, range(6, 0, -1), k=pick.randrange(12)))) for i in range(150)] + [(200 + i, f"new{i} a b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pitman_yor.Model(pitman_yor.blocks(docs, "doc_id", "text"), 1.0, 2, 2, 3)
    model.fit()
    pairs, c = Counter(), Counter()
    for i, x in rows:
        if trains(i):
            ts = tokens_of(x)
            c.update(ts)
            pairs.update(zip([pitman_yor.START, *ts], ts, strict=False))
    code = lambda w: xxhash.xxh64_intdigest(w)
    t = {p: model.samples for p, n in pairs.items() if n == 1}
    of_key = {code(w) >> 16: w for p in pairs for w in p}
    for r in model.many.join(model.t, "bucket").join(model.names, "bucket").collect():
        known = [of_key[k] for k in np.frombuffer(r.known, np.uint64).tolist()]
        for u, w, n, s in zip(*(np.frombuffer(x, np.int32).tolist() for x in (r.a, r.b, r.n, r.sum_t)), strict=True):
            t[known[u], known[w]] = s
            assert pairs[known[u], known[w]] == n and model.samples <= s <= model.samples * n
    assert set(t) == set(pairs)
    contexts = defaultdict(int)
    for (u, _), n in pairs.items():
        contexts[u] += n
    kept = []
    for table, root in model.kept:
        state = {}
        for r in table.collect():
            state.update(zip(np.frombuffer(r.codes, np.uint64).tolist(), zip(*(np.frombuffer(r[x], np.int64).tolist() for x in ("tables", "customers", "root")), strict=True), strict=True))
        assert sum(x[0] for x in state.values()) == sum(x[1] for x in state.values()) == root["customers"]
        kept.append((state, root))
    d = model.discount

    def probability(u, w):
        total = (pairs[u, w] - d * t.get((u, w), 0) / model.samples) / (1 + contexts[u])
        for state, root in kept:
            tables, (_, customers, own) = state.get(code(u), (0, 0, 0))[0], state.get(code(w), (0, 0, 0))
            parent = (customers - root["discount"] * own + (1 + root["discount"] * root["tables"]) / (model.vocabulary + 1)) / (1 + root["customers"])
            total += (1 + d * tables) / (1 + contexts[u]) * parent / model.samples
        return total

    for u in [pitman_yor.START, b"a", b"f", b"never"]:
        assert abs(sum(probability(u, w) for w in c) + probability(u, b"unknown") - 1) < 1e-9
    got = {r.id: r.score for r in model.scores().groupBy("id").sum("score").withColumnRenamed("sum(score)", "score").collect()}
    for i, x in rows:
        ts = tokens_of(x)
        assert abs(got[i] - sum(math.log10(probability(u, w)) for u, w in zip([pitman_yor.START, *ts], ts, strict=False))) < 1e-3


@pytest.mark.parametrize("numbers", [[], [0], [5, -3, 2**31 - 1, -(2**31)], range(100_000)])
def test_squeezed_numbers_come_back(numbers):
    numbers = np.array(numbers, np.int64)
    assert exchange.expanded(exchange.squeezed(numbers)).tolist() == numbers.tolist()
    assert len(numbers) < 1000 or len(exchange.squeezed(np.diff(numbers, prepend=0))) < len(numbers) / 50


@pytest.mark.parametrize("numbers, kind", [(np.array([0, 2**48 - 1, 2**64 - 1], np.uint64), "<u8"), (np.array([1 / 3, -0.0, 1e-300]), "<f8"), (np.array([1 / 3, 2], np.float32), "<f4"), (np.array([], np.float32), "<f4")])
def test_squeezed_numbers_of_other_kinds_come_back(numbers, kind):
    assert exchange.expanded(exchange.squeezed(numbers, kind), kind).tobytes() == numbers.tobytes()


def test_blocks_keep_their_pairs_in_few_bytes(spark):
    """Where a block's pairs are among a bucket's: the places of all its pairs, each once, as steps of less than two bytes."""
    pick = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(pick.choices(words, [1 / (k + 1) for k in range(3000)], k=100))) for i in range(2000)]
    held = pitman_yor.blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    made = pitman_yor.Model(held, 1.0, 2, 2, 3).cells().collect()
    size_of = {r.bucket: len(r.n) // 4 for r in made if r.kind == "all"}
    found, of_block, n_bytes = defaultdict(set), Counter(), 0
    for r in made:
        if r.kind == "places":
            at = exchange.expanded(r.a).cumsum()
            assert (np.diff(at) > 0).all()  # in order, as the pairs are
            found[r.bucket].update(at.tolist())
            of_block[r.block] += len(at)
            n_bytes += len(r.a)
    assert found == {bucket: set(range(n)) for bucket, n in size_of.items()}
    assert of_block == {r.block: len(pitman_yor.pairs_of(r.asDict())[3]) for r in held.collect()}
    assert n_bytes < 2 * of_block.total()
