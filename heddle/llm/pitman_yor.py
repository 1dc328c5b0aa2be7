"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Each word that comes before others (and the start of a text) has a restaurant of its own, whose customers are
the words that follow it. Every table of such a restaurant sends a customer to the one parent that all of them
share, the restaurant of single words, whose tables draw on the even distribution over the known words and one
place for all others. A word's customers in a restaurant are a cell.

Seating is sampled by Gibbs in blocks: in a sweep each cell leaves its tables and is seated again, given the tables
of all other cells: at a table in proportion to its customers less the discount, at a new one in proportion to
the parent's probability. Up to `DRAWN` customers the number of tables is drawn from exactly that distribution,
which generalised Stirling numbers give. Larger cells are seated customer by customer, which proposes seatings with
nearly the right probabilities; of `TRIES` proposals one is taken by its weight, the product of the normalisers that
were met. There, from `EXACT` customers on, runs of 1/64 of those seated share one probability. Cells of a sweep are
seated side by side against the totals at its start, the parent between sweeps. Lone customers always have a table
of their own. Predictive probabilities are averaged over the sweeps after `burn`.

Texts go in blocks of about `BLOCK` tokens. A block's distinct words and pairs are dealt to buckets by hash, so
that a frequent context is spread over all buckets and counts once a block; buckets of cells and buckets of words
exchange totals in each sweep, as packed arrays (`exchange`). A bucket of cells gets a pair at most once a block, and
their number grows with the tokens. Words are counted by 64-bit hashes of theirs: among 10**9 words a clash is expected
0.03 times. Cells know words by the upper 48 bits; a clash there only joins two restaurants. The discounts come from the numbers of cells with one and two customers.

Defined results: null and empty texts have the end token alone; a null id counts as the text '' in the choice of
training texts; rows and ids that repeat are texts of their own; very long texts are split over blocks and
whole in their scores; with no training text all tokens are unknown; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import exchange
from heddle.llm.common import discard, freed, hash60, limited_batches, stored

#: Tokens of a block, bytes of a text that are read at a time, and tokens for each bucket.
BLOCK, READ, BUCKET = 1_000_000, 1 << 22, 3_000_000
#: Customers up to which tables are drawn exactly; proposals for each larger cell, and the customers that are seated one by one.
DRAWN, TRIES, EXACT = 64, 4, 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: The start of a text, which is a context only, and its end; no word has a space.
START, END = b" ^", b" $"
HELD = 10


def key(hashes: np.ndarray) -> np.ndarray:
    """How cells know words: the upper 48 bits of their hashes. Buckets of words go by it, and order by hash is order by key."""
    return hashes >> np.uint64(16)


class Words(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % HELD == 0


def read_words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text with A-Z in lower case, `READ` bytes at a time."""
    data, at = (text or "").encode().translate(LOWER), 0
    while at < len(data):
        stop = WHITE.search(data, at + READ)
        end = stop.start() if stop else len(data)
        yield data[at:end].split()
        at = end


BLOCKS = "block long, starts long, keys array<long>, held array<boolean>, first array<int>, sizes array<long>, tokens binary, words binary"


class Block:
    def __init__(self) -> None:
        self.words, self.parts, self.total, self.starts = Words(), [], 0, 0

    def add(self, key: int, doc_id, held: bool, before: bytes, words: list[bytes]) -> None:
        number = self.words
        self.parts.append((key, doc_id, held, number[before], np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
        self.total += len(words)
        self.starts += before == START and not held

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        keys, ids, held, first, tokens = zip(*self.parts, strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        made = {"block": pa.array([number], pa.int64()), "starts": pa.array([self.starts], pa.int64()), "keys": pa.array([keys], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "first": pa.array([first], pa.list_(pa.int32()))}
        made |= {"sizes": pa.array([[len(t) for t in tokens]], pa.list_(pa.int64())), "tokens": pa.array([exchange.squeezed(np.concatenate(tokens))], pa.binary()), "words": pa.array([hashes.tobytes()], pa.binary()), "ids": pa.array([list(ids)], pa.list_(id_type))}
        return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    used = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def gather(batches):
        from pyspark import TaskContext

        number = key = TaskContext.get().partitionId() << 40
        block, kind = Block(), None
        for batch in batches:
            kind = batch["id"].type
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                key, held, before = key + 1, held_out(doc_id), START
                for words in read_words(text):
                    if words:
                        block.add(key, doc_id, held, before, words)
                        before = words[-1]
                    if block.total >= BLOCK:
                        yield block.row(number, kind)
                        number, block = number + 1, Block()
                block.add(key, doc_id, held, before, [END])
        if block.parts:
            yield block.row(number, kind)

    return stored(used.mapInArrow(gather, f"{BLOCKS}, ids array<{dict(used.dtypes)['id']}>"))


def pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: tokens, whether each trains, its words in order of their hashes, its distinct pairs in order as (context, word) places
    among these, and each token's pair."""
    tokens, sizes = exchange.expanded(row["tokens"]), np.array(row["sizes"], np.int64)
    order = np.argsort(np.frombuffer(row["words"], np.uint64))
    n, rank = len(order), np.empty(len(order), np.int64)
    rank[order] = np.arange(n)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = row["first"]
    trains = np.repeat(~np.array(row["held"], bool), sizes)
    pairs, places = np.unique(rank[before] * n + rank[tokens], return_inverse=True)
    return tokens, trains, order, pairs // n, pairs % n, places


def group_of(block: int, groups: int) -> int:
    """The group of a block in sums, of so many `groups`."""
    return int(exchange.mixed(np.array([block]))[0] % np.uint64(groups))


def pair_codes(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return exchange.mixed(exchange.mixed(context) + word)


@functools.cache
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of all seatings of n customers at t tables, apart from that of new ones."""
    made = np.full((DRAWN + 1, DRAWN + 2), -np.inf)
    made[0, 0] = 0
    for n in range(1, DRAWN + 1):
        t = np.arange(1, n + 1)
        with np.errstate(divide="ignore"):
            made[n, 1 : n + 1] = np.logaddexp(made[n - 1, :n], made[n - 1, 1 : n + 1] + np.log(np.maximum(n - 1 - discount * t, 0)))
    return made


def packed_pairs(hashes: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> dict[str, bytes]:
    """Pairs, in order of context, as places among the distinct words that they use; contexts, and words by their keys, as steps from one to the next."""
    used = np.unique(np.concatenate([context, word]))
    place = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
    place[used] = np.arange(len(used))
    return {"words": exchange.squeezed(np.diff(hashes[used], prepend=np.uint64(0)), "<u8"), "a": exchange.squeezed(np.diff(place[context], prepend=0)), "b": exchange.narrow(place[word], len(used)), "n": exchange.squeezed(n)}


def summed_pairs(words: list[bytes], a: list[bytes], b: list[bytes], n: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct words in order; the places and sums of the distinct pairs of packed pieces; and where among these each piece's pairs are."""
    each = [exchange.expanded(w, "<u8").cumsum() for w in words]
    known = np.unique(np.concatenate(each))
    pairs = []
    for own, x, y in zip(each, a, b, strict=True):
        at = np.searchsorted(known, own)
        pairs.append(at[exchange.expanded(x).cumsum()] * len(known) + at[exchange.widened(y, len(own))])
    distinct, places = np.unique(np.concatenate(pairs), return_inverse=True)
    sums = np.bincount(places, np.concatenate([exchange.expanded(x) for x in n]), len(distinct)).astype(np.int64)
    return known, distinct // max(len(known), 1), distinct % max(len(known), 1), sums, np.split(places, np.cumsum([len(p) for p in pairs])[:-1])


def batch_of(made: list[dict], plain: tuple[str, ...], binary: tuple[str, ...]) -> pa.Table:
    """Rows as a table; arrays as their bytes."""
    raw = lambda v: v.tobytes() if isinstance(v, np.ndarray) else v
    return pa.table({k: pa.array([raw(x.get(k)) for x in made], CELL_TYPES[k]) for k in (*plain, *binary)})


def seat(customers: np.ndarray, weight: np.ndarray, more: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells with so many `customers` (1 or more), where a new table weighs `weight` + `more` for each table there is."""
    out = np.ones(len(customers), np.int64)
    order = np.argsort(customers, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(customers[order])) + 1) if len(order) else []:
        c = int(customers[at[0]])
        if c > DRAWN:
            break
        if c > 1:
            new = np.log(weight[at, None] + more[at, None] * np.arange(c)).cumsum(1)
            chance = np.exp((new := new + stirling(discount)[c, 1 : c + 1]) - new.max(1, keepdims=True)).cumsum(1)
            out[at] = 1 + (rng.random((len(at), 1)) * chance[:, -1:] >= chance).sum(1)
    large = np.flatnonzero(customers > DRAWN)
    out[large] = seat_each(customers[large], weight[large], more[large], discount, rng)
    return out


def seat_each(customers: np.ndarray, weight: np.ndarray, more: np.ndarray, discount: float, rng: np.random.Generator, tries: int = TRIES) -> np.ndarray:
    """The same, customer by customer."""
    order = np.argsort(-customers, kind="stable")
    c, a, b = customers[order], weight[order], more[order]
    kept = total = None
    for _ in range(tries):
        t, log_weight, i = np.ones(len(c)), np.zeros(len(c)), 1
        while m := int(np.searchsorted(-c, -i, "left")):  # cells with more than i customers
            tables = t[:m]
            run = 1 if i < EXACT else np.minimum(i // 64, c[:m] - i)
            new = a[:m] + b[:m] * tables
            every = new + (i + (np.asarray(run) - 1) / 2 - discount * tables)
            opened = rng.random(m) * every < new if i < EXACT else rng.binomial(run, new / every)
            log_weight[:m] += run * np.log(every)
            t[:m] = tables + opened
            i += 1 if i < EXACT else i // 64
        if kept is None:
            kept, total = t, log_weight
        else:
            total = np.logaddexp(total, log_weight)
            kept = np.where(np.log(rng.random(len(c))) < log_weight - total, t, kept)
    out = np.empty(len(c), np.int64)
    out[order] = kept
    return out


def rated(ones: int, twos: int) -> float:
    """The discount that the numbers of cells with one and two customers suggest."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


class Model:
    """The steps of a fit and of the scores, over stored tables."""

    def __init__(self, held: DataFrame, strength: float, burn: int, samples: int, seed: int) -> None:
        if burn < 1 or samples < 1:
            raise ValueError("at least one sweep comes before at least one sample")
        self.spark, self.held, self.strength, self.burn, self.samples, self.seed = held.sparkSession, held, strength, burn, samples, seed
        size, self.n_blocks, self.starts = held.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("starts"), F.lit(0))).first()
        self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(size) // BUCKET)
        #: Groups for sums over blocks and over buckets of cells.
        self.groups = max(1, self.n_blocks)

    def dealt_words(self) -> DataFrame:
        """(bucket, block, grp, codes): the words of each block."""
        buckets, groups = self.buckets, self.groups

        def deal(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    words = np.frombuffer(row["words"], np.uint64)
                    for bucket, at in exchange.dealt(key(words), buckets):
                        yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [row["block"]], "grp": [group_of(row["block"], groups)], "codes": [words[at].tobytes()]})

        return self.held.select("block", "words").mapInArrow(deal, "bucket long, block long, grp long, codes binary")

    def counted_words(self) -> DataFrame:
        """(bucket, grp, codes, n): the words of each block and their training tokens; the start counts as often as training texts start."""
        buckets, groups = self.buckets, self.groups

        def deal(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    words = np.frombuffer(row["words"], np.uint64)
                    tokens, trains = exchange.expanded(row["tokens"]), np.repeat(~np.array(row["held"], bool), row["sizes"])
                    n = np.bincount(tokens[trains], minlength=len(words))
                    n[words == np.uint64(xxhash.xxh64_intdigest(START))] += row["starts"]
                    for bucket, at in exchange.dealt(key(words), buckets):
                        yield pa.RecordBatch.from_pydict({"bucket": [bucket], "grp": [group_of(row["block"], groups)], "codes": [words[at].tobytes()], "n": [n[at].astype(np.int32).tobytes()]})

        used = self.held.select("block", "starts", "held", "sizes", "tokens", "words")
        return used.mapInArrow(deal, "bucket long, grp long, codes binary, n binary")

    def cells(self) -> DataFrame:
        """Rows of kinds: `all` (tokens that train of each pair of a bucket), `places` (where among them a block's pairs are, as steps), `cells` (places of
        context and word in the bucket's words, and customers, of those with two or more), `words` (those words), `asks` (the same by bucket of
        words) and `base` (the tables that lone pairs have, by bucket of words)."""
        buckets, groups = self.buckets, self.groups

        def deal(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    _, trains, order, context, word, places = pairs_of(row)
                    hashes = np.frombuffer(row["words"], np.uint64)[order]
                    n = np.bincount(places[trains], minlength=len(context))
                    for bucket, at in exchange.dealt(pair_codes(hashes[context], hashes[word]), buckets):
                        piece = {"bucket": bucket, "block": row["block"], **packed_pairs(key(hashes), context[at], word[at], n[at])}
                        yield pa.RecordBatch.from_pydict({k: [v] for k, v in piece.items()})

        def finish(table: pa.Table) -> pa.Table:
            bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
            known, a, b, n, places = summed_pairs(*[table[c].to_pylist() for c in ("words", "a", "b", "n")])
            lone, many = n == 1, n > 1
            of_many, sides = np.unique(np.concatenate([a[many], b[many]]), return_inverse=True)
            asked = known[of_many]
            of_base = np.unique(np.concatenate([a[lone], b[lone]]))
            tables, customers = (np.bincount(x[lone], minlength=len(known))[of_base].astype(np.int32) for x in (a, b))
            base = known[of_base]
            made = [{"kind": "all", "bucket": bucket, "block": bucket, "n": n.astype(np.int32), "ones": int(lone.sum()), "twos": int((n == 2).sum())}]
            made += [{"kind": "places", "bucket": bucket, "block": block, "a": exchange.squeezed(np.diff(own, prepend=0))} for block, own in zip(blocks, places, strict=True)]
            made.append({"kind": "cells", "bucket": bucket, "block": bucket, "a": sides[: len(sides) // 2].astype(np.int32), "b": sides[len(sides) // 2 :].astype(np.int32), "n": n[many].astype(np.int32)})
            made.append({"kind": "words", "bucket": bucket, "block": bucket, "codes": asked})
            made += [{"kind": "asks", "bucket": to, "block": bucket, "codes": asked[at]} for to, at in exchange.dealt(asked, buckets)]
            made += [{"kind": "base", "bucket": to, "block": bucket, "codes": base[at], "a": tables[at], "b": customers[at]} for to, at in exchange.dealt(base, buckets)]
            return batch_of(made, ("kind", "bucket", "block", "ones", "twos"), ("codes", "a", "b", "n"))

        used = self.held.select("block", "held", "first", "sizes", "tokens", "words")
        pieces = used.mapInArrow(deal, "bucket long, block long, words binary, a binary, b binary, n binary")
        return stored(pieces.groupBy("bucket").applyInArrow(finish, CELLS).withColumn("grp", F.when(F.col("kind") == "places", F.pmod(hash60(F.col("block")), F.lit(groups))).otherwise(F.col("block"))))

    def fit(self) -> None:
        """Samples the seatings; `words` has a table of words for each kept sample and `t` the tables of cells, summed over samples."""
        made = self.made = self.cells()
        freed(self.spark)
        known = exchange.tree_sum(self.counted_words(), {"n": np.int32}, self.groups)
        # Read anew for each kind, so that kinds can be joined.
        of = lambda kind, *columns: self.spark.read.schema(made.schema).parquet(made.heddle_folder).filter(F.col("kind") == kind).select(*columns)
        ones, twos = made.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
        self.discount = rated(ones, twos)
        base = exchange.tree_sum(of("base", "bucket", "grp", "codes", F.col("a").alias("tables"), F.col("b").alias("customers")), {"tables": np.int32, "customers": np.int32}, self.buckets)
        self.known = stored(self.placed(known, base))
        n_words, n_tokens = self.known.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        # The start is in the table of words but isn't a token.
        self.vocabulary, self.train_tokens = n_words - (self.starts > 0), n_tokens - self.starts
        self.asks = of("asks", "bucket", "block", "grp", "codes")
        self.all, self.places, self.many, self.names = of("all", "bucket", "n"), of("places", "bucket", "block", "grp", "a"), of("cells", "bucket", "a", "b", "n"), of("words", "bucket", F.col("codes").alias("known"))
        self.kept, sums, self.t = [], None, None
        root = {"customers": 0, "tables": 0, "discount": self.discount}
        for sweep in range(self.burn + self.samples):
            if sweep == 0:
                sums = stored(self.sample(None, None, sweep, False))
            words = stored(self.seated(sums, root, sweep))
            customers, tables, single, double = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("sum_customers", "sum_tables", "ones", "twos")]).first()
            root = {"customers": customers, "tables": tables, "discount": rated(single, double) if sweep == 0 else root["discount"]}
            if sweep >= self.burn:
                self.kept.append((words, root))
            if sweep + 1 < self.burn + self.samples:
                answers = exchange.answered(self.asks, words.select("bucket", "codes", "tables", "customers", "root"), self.buckets, self.told(root), "block long, bucket long, probability binary, tables binary")
                before, sums = sums, stored(self.sample(sums, answers, sweep + 1, sweep + 1 >= self.burn))
                discard(before)
                if sweep < self.burn:
                    discard(words)
        self.t, self.last = sums.filter("kind = 'cells'").select("bucket", "sum_t"), sums

    @staticmethod
    def placed(known: DataFrame, base: DataFrame) -> DataFrame:
        """The words that train, their tokens and what lone pairs add: a row for each bucket."""

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            codes, n = exchange.joined(left["codes"], np.uint64), exchange.joined(left["n"], np.int32).astype(np.int64)
            codes, n = codes[n > 0], n[n > 0]
            tables, customers = np.zeros((2, len(codes)), np.int64)
            if right.num_rows:
                at = np.searchsorted(key(codes), exchange.joined(right["codes"], np.uint64))
                tables[at], customers[at] = exchange.joined(right["tables"], np.int32), exchange.joined(right["customers"], np.int32)
            row = {"bucket": [left["bucket"][0].as_py()], "n_words": [len(codes)], "n_tokens": [int(n.sum())]} | {k: [v.tobytes()] for k, v in (("codes", codes), ("n", n), ("tables", tables), ("customers", customers))}
            return pa.table(row)

        schema = "bucket long, n_words long, n_tokens long, codes binary, n binary, tables binary, customers binary"
        return known.groupBy("bucket").cogroup(base.groupBy("bucket")).applyInArrow(both, schema)

    def seated(self, sums: DataFrame, root: dict, sweep: int) -> DataFrame:
        """The parent's restaurant seated anew for the tables of all cells, by bucket of words."""
        sent = sums.filter("kind = 'sums'").select("bucket", F.col("block").alias("grp"), "codes", F.col("a").alias("tables"), F.col("b").alias("customers"))
        total = exchange.tree_sum(sent, {"tables": np.int32, "customers": np.int32}, self.buckets)
        even, strength, seed = 1 / (self.vocabulary + 1), self.strength, self.seed

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            bucket = left["bucket"][0].as_py()
            codes = exchange.joined(left["codes"], np.uint64)
            tables, customers = (exchange.joined(left[c], np.int64).copy() for c in ("tables", "customers"))
            if right.num_rows:
                at = np.searchsorted(key(codes), exchange.joined(right["codes"], np.uint64))
                for to, c in ((tables, "tables"), (customers, "customers")):
                    to[at] += exchange.joined(right[c], np.int32)
            own = np.zeros(len(codes), np.int64)
            served = np.flatnonzero(customers)
            d = root["discount"]
            weight = np.full(len(served), (strength + d * root["tables"]) * even)
            own[served] = seat(customers[served], weight, np.full(len(served), d * even), d, np.random.default_rng([seed, sweep, bucket, 1]))
            row = {"bucket": [bucket], "sum_customers": [int(customers.sum())], "sum_tables": [int(own.sum())], "ones": [int((customers == 1).sum())], "twos": [int((customers == 2).sum())]}
            return pa.table(row | {k: [v.tobytes()] for k, v in (("codes", codes), ("tables", tables), ("customers", customers), ("root", own))})

        schema = "bucket long, sum_customers long, sum_tables long, ones long, twos long, codes binary, tables binary, customers binary, root binary"
        return self.known.select("bucket", "codes", "tables", "customers").groupBy("bucket").cogroup(total.groupBy("bucket")).applyInArrow(both, schema)

    def parent(self, root: dict):
        """The parent's probability of words with these customers and tables."""
        even, strength = 1 / (self.vocabulary + 1), self.strength
        return lambda customers, tables: (customers - root["discount"] * tables + (strength + root["discount"] * root["tables"]) * even) / (strength + root["customers"])

    def told(self, root: dict):
        parent = self.parent(root)

        def answer(left: pa.Table, right: pa.Table):
            keys = key(exchange.joined(right["codes"], np.uint64))
            tables, customers, own = (exchange.joined(right[c], np.int64) for c in ("tables", "customers", "root"))
            probability = parent(customers, own)
            for block, asked in zip(left["block"].to_pylist(), left["codes"].to_pylist(), strict=True):
                at = np.searchsorted(keys, np.frombuffer(asked, np.uint64))
                yield {"block": block, "bucket": left["bucket"][0].as_py(), "probability": probability[at].astype(np.float32).tobytes(), "tables": tables[at].astype(np.int32).tobytes()}

        return answer

    def sample(self, state: DataFrame | None, answers: DataFrame | None, sweep: int, keep: bool) -> DataFrame:
        """Cells seated anew: rows `cells` (t, and sum_t over kept samples) and `sums` (tables by context and by word, for the buckets of words).
        Without `answers` every cell has one table."""
        buckets, strength, d, seed = self.buckets, self.strength, self.discount, self.seed
        rows, begins = self.many.join(self.names, "bucket"), answers is None
        if answers is not None:
            told = answers.groupBy("block").agg(F.collect_list(F.struct(F.col("bucket").alias("of"), "probability", "tables")).alias("told"))
            rows = rows.join(state.filter("kind = 'cells'").select("bucket", "t", "sum_t"), "bucket").join(told.withColumnRenamed("block", "bucket"), "bucket", "left")

        def draw(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch[name][i].as_py() for name in batch.schema.names}
                    n = np.frombuffer(row["n"], np.int32).astype(np.int64)
                    context, word = np.frombuffer(row["a"], np.int32), np.frombuffer(row["b"], np.int32)
                    known = np.frombuffer(row["known"], np.uint64)
                    places = dict(exchange.dealt(known, buckets))
                    if begins:
                        t, sum_t = np.ones(len(n), np.int64), np.zeros(len(n), np.int32)
                    else:
                        old, sum_t = np.frombuffer(row["t"], np.int32), np.frombuffer(row["sum_t"], np.int32)
                        probability, tables = np.zeros(len(known)), np.zeros(len(known), np.int64)
                        for x in row["told"] or []:
                            at = places[x["of"]]
                            probability[at], tables[at] = np.frombuffer(x["probability"], np.float32), np.frombuffer(x["tables"], np.int32)
                        p = probability[word]
                        t = seat(n, (strength + d * (tables[context] - old)) * p, d * p, d, np.random.default_rng([seed, sweep, row["bucket"], 2]))
                    by_context, by_word = (np.bincount(x, t, len(known)).astype(np.int32) for x in (context, word))
                    made = [{"kind": "cells", "bucket": row["bucket"], "t": t.astype(np.int32), "sum_t": (sum_t + t * keep).astype(np.int32)}]
                    made += [{"kind": "sums", "bucket": to, "block": row["bucket"], "codes": known[at], "a": by_context[at], "b": by_word[at]} for to, at in places.items()]
                    yield from batch_of(made, ("kind", "bucket", "block"), ("codes", "a", "b", "t", "sum_t")).to_batches()

        return rows.mapInArrow(draw, "kind string, bucket long, block long, codes binary, a binary, b binary, t binary, sum_t binary")

    def word_answers(self) -> DataFrame:
        """For the words of each block: training tokens, and for each sample the share that a context leaves to the parent and the parent's probability."""
        table = self.known.select("bucket", "codes", "n")
        for k, (words, _) in enumerate(self.kept):
            table = table.join(words.select("bucket", *[F.col(c).alias(f"{c}{k}") for c in ("tables", "customers", "root")]), "bucket")
        parents, strength, d = [self.parent(root) for _, root in self.kept], self.strength, self.discount

        def answer(left: pa.Table, right: pa.Table):
            codes, n = exchange.joined(right["codes"], np.uint64), exchange.joined(right["n"], np.int64)
            of = lambda c: exchange.joined(right[c], np.int64)
            share = np.stack([(strength + d * of(f"tables{k}")) / (strength + n) for k in range(len(parents))]).astype(np.float32)
            single = np.stack([p(of(f"customers{k}"), of(f"root{k}")) for k, p in enumerate(parents)]).astype(np.float32)
            # The last place is for unknown words. Words with the same counts are told together.
            values = np.concatenate([np.vstack([n, share, single]), np.array([[0], *[[1]] * len(parents), *[[p(0, 0)] for p in parents]])], axis=1)
            alike = np.append(n, 0)
            for k in range(len(parents)):
                for c in ("tables", "customers", "root"):
                    alike = exchange.mixed(alike) + np.append(of(f"{c}{k}"), 0).astype(np.uint64)
            for block, asked in zip(left["block"].to_pylist(), left["codes"].to_pylist(), strict=True):
                asked = np.frombuffer(asked, np.uint64)
                at = np.searchsorted(codes, asked)
                at[at < len(codes)] = np.where(codes[at[at < len(codes)]] == asked[at < len(codes)], at[at < len(codes)], len(codes))
                _, first, which = np.unique(alike[at], return_index=True, return_inverse=True)
                # In order, equal numbers come together, so that whole ones compress better than their first, second and later bytes.
                own = values[:, at[first]]
                order = np.lexsort(own[::-1])
                yield {"block": block, "bucket": left["bucket"][0].as_py(), "which": exchange.squeezed(np.argsort(order)[which]), "told": exchange.squeezed(own[:, order].ravel().view(np.uint8), "u1")}

        return exchange.answered(self.dealt_words(), table, self.groups, answer, "block long, bucket long, which binary, told binary")

    def pair_answers(self) -> DataFrame:
        """For the pairs of each block: customers less the discount for each table, averaged over samples."""
        d, samples = self.discount, self.samples
        table = self.all.join(self.t, "bucket")

        def answer(left: pa.Table, right: pa.Table):
            n, tables = (exchange.joined(right[c], np.int32).astype(np.int64) for c in ("n", "sum_t"))
            value = np.where(n == 1, 1 - d, 0).astype(np.float32)
            value[n > 1] = n[n > 1] - d * tables / samples
            for block, places in zip(left["block"].to_pylist(), left["a"].to_pylist(), strict=True):
                told, which = np.unique(value[exchange.expanded(places).cumsum()], return_inverse=True)
                yield {"block": block, "bucket": left["bucket"][0].as_py(), "which": exchange.squeezed(which), "told": exchange.squeezed(told, "<f4")}

        return exchange.answered(self.places, table, self.groups, answer, "block long, bucket long, which binary, told binary")

    def scores(self) -> DataFrame:
        """(key, id, held_out, n_tokens, n_known, base_score, score) of each part of a text."""
        answers = []
        for made, *done in ((self.pair_answers, self.last, self.made), (self.word_answers, self.known, *[words for words, _ in self.kept])):
            answers.append(stored(made()))
            for table in done:  # what isn't read any more
                discard(table)
        of_pairs, of_words = (a.groupBy("block").agg(F.collect_list(F.struct("bucket", "which", "told")).alias(name)) for a, name in zip(answers, ("of_pairs", "of_words"), strict=True))
        rows = self.held.join(of_words, "block").join(of_pairs, "block")
        buckets, samples, strength, vocabulary, train_tokens = self.buckets, self.samples, self.strength, self.vocabulary, self.train_tokens
        id_kind = dict(self.held.dtypes)["ids"].removeprefix("array<").removesuffix(">")

        def score(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch[name][i].as_py() for name in batch.schema.names if name != "ids"}
                    hashes = np.frombuffer(row["words"], np.uint64)
                    tokens, _, order, context, word, places = pairs_of(row)
                    values = np.zeros((1 + 2 * samples, len(hashes)))
                    told = {x["bucket"]: x for x in row["of_words"]}
                    for bucket, at in exchange.dealt(key(hashes), buckets):
                        own = exchange.expanded(told[bucket]["told"], "u1").view(np.float64).reshape(len(values), -1)
                        values[:, at] = own[:, exchange.expanded(told[bucket]["which"])]
                    count, (n, share, single) = values[0], np.split(values[:, order], [1, 1 + samples])
                    mass = np.zeros(len(context))
                    told = {x["bucket"]: x for x in row["of_pairs"]}
                    for bucket, at in exchange.dealt(pair_codes(hashes[order][context], hashes[order][word]), buckets):
                        mass[at] = exchange.expanded(told[bucket]["told"], "<f4")[exchange.expanded(told[bucket]["which"])]
                    probability = mass / (strength + n[0][context])
                    for k in range(samples):
                        probability += share[k][context] * single[k][word] / samples
                    base = np.log10((count + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
                    ends = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
                    sums = lambda v: np.add.reduceat(v, ends[:-1])
                    ids = batch["ids"][i].values
                    yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), ids, pa.array(row["held"], pa.bool_()), pa.array(row["sizes"], pa.int64()), pa.array(sums((count[tokens] > 0).astype(np.int64))), pa.array(sums(base[tokens])), pa.array(sums(np.log10(probability)[places]))], names=["key", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        return rows.mapInArrow(score, f"key long, id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


CELLS = "kind string, bucket long, block long, ones long, twos long, codes binary, a binary, b binary, n binary"
CELL_TYPES = {"kind": pa.string()} | dict.fromkeys(("bucket", "block", "ones", "twos"), pa.int64()) | dict.fromkeys(("codes", "a", "b", "n", "t", "sum_t"), pa.binary())


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = 1.0, burn: int = 2, samples: int = 2, seed: int = 13) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `base_score` is of single words with 0.1 added to each count; `score` is the model's log10 probability.
    Held-out texts (a tenth, by the CRC of their ids) don't train. Perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    with limited_batches(spark):
        held = blocks(docs, id_col, text_col)
        model = Model(held, strength, burn, samples, seed)
        with limited_batches(spark, 1):  # a row holds a block
            model.fit()
            parts = stored(model.scores())
        discard(held)
    whole = parts.groupBy("key").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(model.train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
