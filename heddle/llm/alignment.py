"""Alignment of the tokens of two tokenizers by the bytes that they cover.

Tokens of A and of B end at byte offsets; offsets where both end cut a text into groups. A fragment is what a
byte range of a text holds: an open prefix (tokens up to its first cut, whose group began further left), closed
groups, and an open suffix (tokens after its last cut). Fragments form a monoid: putting two side by side closes
the group of the left suffix and the right prefix, or, where a side has no cut, only lengthens what is open.

Long texts are dealt out in pieces of about `RANGE` bytes, each tokenized by a task of its own, which makes a
fragment for every byte range that the piece touches, wherever tokens straddle its ends. A tree then composes
the fragments of ranges `FAN` times as long at each level, until one is left for a document.

Texts are cut for tokenizing only at single spaces between other characters. There both tokenizers end a token:
A's pattern takes the space with what follows it, and B's pieces have a space at their start only (checked when
loaded), so merges never cross such a place, and the parts' tokens are the whole text's. Parts recur, so workers
remember them, up to `REMEMBERED` parts of at most `SHORT` characters.

How many documents hold a pair of ids linked is counted by blocks of documents (`exchange`).

Defined results: a null, empty or unaligned text (bytes that differ from the space and the text) has zeros and
''; rows and ids that repeat are documents of their own, as are null ids; very long texts are read whole; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, replace
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import exchange
from heddle.llm.common import hash60, limited_batches, stored

#: Bytes of a range, characters from which a text is dealt out, and how many fragments of a level are composed to one.
RANGE, LONG, FAN = 32768, 65536, 8
#: Pairs of documents that fill a block, and texts that are aligned at once.
BLOCK, TEXTS = 1_000_000, 125
#: Parts, and their characters, beyond which a worker forgets them.
REMEMBERED, CHARS = 300_000, 1 << 23
#: Pairs from which a group's ids are counted before they are paired.
LARGE = 4096
PLACE = re.compile(r"(?<=\S) (?=\S)")
#: A pair's code: A's id above B's.
SHIFT = 24


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Parts(dict):
    """Numbers of parts in the order in which they come."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] for each i, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Pair:
    """Two tokenizers, by the contents of their files, so that tasks need no path; and the tokens of the parts that a worker remembers."""

    a_file: bytes
    b_file: bytes

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            pair = cls(a.read(), b.read())
        pair.open()
        if any("▁" in p.strip("▁") or (p.strip("▁") and p.endswith("▁")) for p in pair.b_pieces):
            raise ValueError("pieces with a space after another character can't be cut at spaces")
        return pair

    def __getstate__(self):
        return {"a_file": self.a_file, "b_file": self.b_file}

    def open(self) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.a = Tokenizer.from_buffer(self.a_file)
        self.a.encode_special_tokens = True
        chars = byte_values()
        vocab = json.loads(self.a_file)
        special = {t["id"] for t in vocab["added_tokens"]}
        ids = {i: t for t, i in vocab["model"]["vocab"].items()} | {t["id"]: t["content"] for t in vocab["added_tokens"]}
        self.a_bytes = [ids.get(i, "").encode() if i in special else bytes(chars[c] for c in ids.get(i, "")) for i in range(max(ids) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_file)
        self.b_pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b_pieces)]
        self.lengths = [np.array([len(x) for x in spelled], np.int64) for spelled in (self.a_bytes, self.b_bytes)]
        n, m = len(self.a_bytes), len(self.b_bytes)
        #: The text of A's and B's tokens within a group, and at the end of their side of one.
        self.shown = [f"{i}," for i in [*range(n), *range(m)]] + [f"{i}|" for i in range(n)] + [f"{i};" for i in range(m)]
        self.forget()

    def forget(self) -> None:
        self.known, self.sizes, self.chars = Parts(), np.zeros((2, 0), np.int64), 0
        self.tokens, self.fits = [np.zeros(0, np.int64)] * 2, np.zeros(0, bool)

    def learn(self, parts: list[str]) -> None:
        """The tokens of parts that weren't known."""
        whole = [" " + p for p in parts]
        a, b = [x.ids for x in self.a.encode_batch_fast(whole, add_special_tokens=False)], self.b.encode(parts, num_threads=1)
        data = [w.encode() for w in whole]
        joined, lengths = b"".join(data), np.array([len(x) for x in data])
        fits = np.ones(len(parts), bool)
        sizes = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64)
        for side, (each, spelled) in enumerate(((a, self.a_bytes), (b, self.b_bytes))):
            flat = np.fromiter(chain.from_iterable(each), np.int64, sizes[side].sum())
            ends = np.cumsum(sizes[side])
            covered = np.concatenate([[0], np.cumsum(self.lengths[side][flat])])
            alike = covered[ends] - covered[ends - sizes[side]] == lengths
            if not alike.all() or b"".join(map(spelled.__getitem__, flat.tolist())) != joined:
                alike = np.array([b"".join([spelled[i] for i in x]) == w for x, w in zip(each, data, strict=True)])
            fits &= alike
            self.tokens[side] = np.concatenate([self.tokens[side], flat])
        self.sizes, self.fits = np.concatenate([self.sizes, sizes], axis=1), np.concatenate([self.fits, fits])
        self.chars += sum(map(len, parts))

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's parts, whose tokens are known from now on."""
        if not hasattr(self, "a"):
            self.open()
        if len(self.known) > REMEMBERED or self.chars > CHARS:
            self.forget()
        had = len(self.known)
        made = [np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)) for parts in texts]
        if len(self.known) > had:
            self.learn(list(islice(self.known, had, None)))
        self.starts = [np.cumsum(x) - x for x in self.sizes]
        return made

    def spread(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: the tokens of parts one after the other, and the bytes up to the end of each."""
        out = []
        for side in (0, 1):
            ids = self.tokens[side][gathered(self.starts[side][numbers], self.sizes[side][numbers])]
            out.append((ids, np.cumsum(self.lengths[side][ids])))
        return out


def linked(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, how often) of the pairs within n groups, given the group of each token; ids that repeat in a large group are multiplied, not listed."""
    n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    large = np.flatnonzero(n_a * n_b > LARGE)
    reps, first = n_b[in_a], np.cumsum(n_b) - n_b
    if len(large):
        reps = np.where(np.isin(in_a, large), 0, reps)
    group, code = np.repeat(in_a, reps), np.repeat(a << SHIFT, reps) | b[gathered(first[in_a], reps)]
    made = [(group, code, np.ones(len(code), np.int64))]
    for g in large.tolist():
        (x, p), (y, q) = (np.unique(ids[slice(*np.searchsorted(where, [g, g + 1]))], return_counts=True) for ids, where in ((a, in_a), (b, in_b)))
        codes = (x[:, None] << SHIFT | y).ravel()
        made.append((np.full(len(codes), g), codes, np.outer(p, q).ravel()))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def shown(pair: Pair, a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Places in `pair.shown` of the tokens in the order of groups, A's before B's, and each one's group."""
    side = np.concatenate([2 * in_a, 2 * in_b + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    n = len(pair.a_bytes) + len(pair.b_bytes)
    last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
    return (np.concatenate([a, b + len(pair.a_bytes)])[order] + n * last).tolist(), side >> 1


@dataclass(slots=True)
class Fragment:
    """Tokens of a byte range. Without a cut all of them are in the prefix."""

    cut: bool
    head: tuple[list[int], list[int]]
    tail: tuple[list[int], list[int]]
    groups: str  # the closed ones, as text
    n_a: int  # tokens of the closed groups
    n_b: int
    n_groups: int
    n_links: int
    links: tuple[np.ndarray, np.ndarray]  # of the closed groups: codes in order, and how often each comes


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def closed(pair: Pair, a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, n: int) -> Fragment:
    """The fragment of n whole groups."""
    _, codes, times = linked(a, in_a, b, in_b, n)
    text = "".join(map(pair.shown.__getitem__, shown(pair, a, in_a, b, in_b)[0]))[:-1]
    return Fragment(True, ([], []), ([], []), text, len(a), len(b), n, int(times.sum()), exchange.add_up(codes, times))


def fragment(pair: Pair, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """Of the tokens that end within a range."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(cuts):
        return Fragment(False, (a.tolist(), b.tolist()), ([], []), "", 0, 0, 0, 0, NONE)
    (a_from, a_to), (b_from, b_to) = (np.searchsorted(ends, cuts[[0, -1]], "right") for ends in (a_ends, b_ends))
    own = closed(pair, a[a_from:a_to], np.searchsorted(cuts[1:], a_ends[a_from:a_to]), b[b_from:b_to], np.searchsorted(cuts[1:], b_ends[b_from:b_to]), len(cuts) - 1)
    own.head, own.tail = (a[:a_from].tolist(), b[:b_from].tolist()), (a[a_to:].tolist(), b[b_to:].tolist())
    return own


def composed(pair: Pair, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two ranges side by side."""
    beside = lambda x, y: (x[0] + y[0], x[1] + y[1])
    if not left.cut and not right.cut:
        return replace(left, head=beside(left.head, right.head))
    if not left.cut:
        return replace(right, head=beside(left.head, right.head))
    if not right.cut:
        return replace(left, tail=beside(left.tail, right.head))
    a, b = (np.array(x, np.int64) for x in beside(left.tail, right.head))
    parts = [left, right]
    if len(a) or len(b):
        parts.insert(1, closed(pair, a, np.zeros(len(a), np.int64), b, np.zeros(len(b), np.int64), 1))
    total = lambda name: sum(getattr(p, name) for p in parts)
    links = exchange.add_up(*[np.concatenate(x) for x in zip(*[p.links for p in parts], strict=True)])
    return Fragment(True, left.head, right.tail, ";".join(p.groups for p in parts if p.n_groups), total("n_a"), total("n_b"), total("n_groups"), total("n_links"), links)


#: What a text begins with: a cut.
BEGIN = Fragment(True, ([], []), ([], []), "", 0, 0, 0, 0, NONE)


class Block:
    """Documents gathered until their pairs fill a block; `row` gives it as arrays."""

    def __init__(self) -> None:
        self.ids, self.numbers, self.codes, self.times, self.sizes, self.total = [], [], [], [], [], 0

    def add(self, ids: list, numbers: list[tuple], codes: np.ndarray, times: np.ndarray, sizes: list[int]) -> None:
        """Documents: ids, (n_a, n_b, n_groups, n_links, sha) of each, their pairs and how many are whose."""
        self.ids += ids
        self.numbers += numbers
        self.codes.append(codes)
        self.times.append(times)
        self.sizes += sizes
        self.total += len(codes)

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        codes, places, docs = np.unique(np.concatenate(self.codes).astype(np.uint64), return_inverse=True, return_counts=True)
        times = np.concatenate(self.times).astype(np.int32)
        held = {"block": pa.array([number], pa.int64()), "ids": pa.array([self.ids], pa.list_(id_type))}
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            held[name] = pa.array([[x[k] for x in self.numbers]], pa.list_(pa.int64()))
        held["sha"] = pa.array([[x[4] for x in self.numbers]], pa.list_(pa.string()))
        held["sizes"] = pa.array([self.sizes], pa.list_(pa.int64()))
        for name, x in (("codes", codes), ("docs", docs.astype(np.int64)), ("places", places.astype(np.int32)), ("times", times)):
            held[name] = pa.array([x.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(list(held.values()), names=list(held))


def aligned(pair: Pair, ids: list, texts: list[str | None], into: Block) -> None:
    """Adds whole texts to a block: groups, links and counts of all of them at once."""
    parts = pair.numbers([PLACE.split(t) if t else [] for t in texts])
    parts = [p if pair.fits[p].all() else p[:0] for p in parts]
    numbers = np.concatenate(parts)
    (a, a_ends), (b, b_ends) = pair.spread(numbers)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    in_a, in_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    # Every text ends with a cut.
    of_part = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    of_a, of_b = (np.repeat(of_part, pair.sizes[side][numbers]) for side in (0, 1))
    of_group = np.zeros(len(cuts), np.int64)
    of_group[in_a] = of_a
    group, codes, times = linked(a, in_a, b, in_b, len(cuts))
    places, their_group = shown(pair, a, in_a, b, in_b)
    ends = np.searchsorted(of_group[their_group], np.arange(len(texts) + 1)) if len(cuts) else np.zeros(len(texts) + 1, np.int64)
    shas = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text = "".join(map(pair.shown.__getitem__, places[lo:hi]))[:-1]
        shas.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
    count = lambda of, weights=None: np.bincount(of, weights, len(texts)).astype(np.int64).tolist()
    of_link = of_group[group] if len(cuts) else group
    held, times_held = exchange.add_up(of_link << 44 | codes, times)
    into.add(ids, list(zip(count(of_a), count(of_b), count(of_group), count(of_link, times), shas, strict=True)), held & ((1 << 44) - 1), times_held, count(held >> 44))


FRAGMENT = "key long, at long, bytes long, bad boolean, cut boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, groups string, n_a long, n_b long, n_groups long, n_links long, codes binary, times binary"


def as_row(f: Fragment | None) -> dict:
    f = f or replace(BEGIN, cut=False)
    return {"cut": f.cut, "head_a": f.head[0], "head_b": f.head[1], "tail_a": f.tail[0], "tail_b": f.tail[1], "groups": f.groups, "n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "n_links": f.n_links, "codes": f.links[0].tobytes(), "times": f.links[1].tobytes()}


def from_row(x: dict) -> Fragment:
    links = np.frombuffer(x["codes"], np.int64), np.frombuffer(x["times"], np.int64)
    return Fragment(x["cut"], (x["head_a"], x["head_b"]), (x["tail_a"], x["tail_b"]), x["groups"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], links)


def pieces_of(text: str):
    """(first byte, all bytes of the text with its space, piece): pieces of `RANGE` bytes or more that begin at a place to cut."""
    parts = PLACE.split(text)
    sizes = [1 + len(p.encode()) for p in parts]
    total, at, begin, held = sum(sizes), 0, 0, []
    for p, n in zip(parts, sizes, strict=True):
        held.append(p)
        at += n
        if at - begin >= RANGE:
            yield begin, total, " ".join(held)
            begin, held = at, []
    if held:
        yield begin, total, " ".join(held)


def ranges_of(pair: Pair, begin: int, piece: str):
    """(first byte, fragment) for each range that the piece touches; None as the fragment of a piece that isn't spelled."""
    numbers = pair.numbers([PLACE.split(piece)])[0]
    if not pair.fits[numbers].all():
        yield begin, None
        return
    (a, a_ends), (b, b_ends) = ((ids, ends + begin) for ids, ends in pair.spread(numbers))
    at = int(a_ends[-1])
    i = j = 0
    for start in range(begin - begin % RANGE, at, RANGE):
        end = min(start + RANGE, at)
        p, q = int(np.searchsorted(a_ends, end, "right")), int(np.searchsorted(b_ends, end, "right"))
        yield max(begin, start), fragment(pair, a[i:p], a_ends[i:p], b[j:q], b_ends[j:q])
        i, j = p, q


def long_texts(texts: DataFrame, pair: Pair) -> DataFrame:
    """One row of FRAGMENT for each of `texts` (key, text), which are long."""

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for begin, total, piece in pieces_of(text):
                    yield pa.RecordBatch.from_pydict({"key": [key], "begin": [begin], "total": [total], "piece": [piece]})

    def fragments(batches):
        for batch in batches:
            for x in batch.to_pylist():
                for at, f in ranges_of(pair, x["begin"], x["piece"]):
                    yield rows([{"key": x["key"], "at": at, "bytes": x["total"], "bad": f is None} | as_row(f)])

    def compose(table: pa.Table) -> pa.Table:
        if not hasattr(pair, "a"):
            pair.open()
        each = table.sort_by("at").to_pylist()
        bad, whole = any(x["bad"] for x in each), None
        for x in each if not bad else []:
            whole = from_row(x) if whole is None else composed(pair, whole, from_row(x))
        return pa.Table.from_batches([rows([{"key": each[0]["key"], "at": each[0]["at"], "bytes": each[0]["bytes"], "bad": bad} | as_row(whole)])])

    # A hot document's pieces go to as many tasks as there are.
    pieces = texts.select("key", "text").mapInArrow(cut, "key long, begin long, total long, piece string").repartition(F.col("key"), F.col("begin"))
    level = stored(pieces.mapInArrow(fragments, FRAGMENT))
    longest = level.agg(F.max("bytes")).first()[0] or 0
    width = RANGE
    while width < longest:
        width *= FAN
        level = level.groupBy("key", F.floor(F.col("at") / width)).applyInArrow(lambda _, table: compose(table), FRAGMENT)
    return level


LISTS = {"key": pa.int64(), "at": pa.int64(), "bytes": pa.int64(), "bad": pa.bool_(), "cut": pa.bool_()} | dict.fromkeys(("head_a", "head_b", "tail_a", "tail_b"), pa.list_(pa.int32())) | {"groups": pa.string(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "codes": pa.binary(), "times": pa.binary()}


def rows(made: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array([x[name] for x in made], kind) for name, kind in LISTS.items()})


def blocks(docs: DataFrame, pair: Pair, id_col: str, text_col: str) -> DataFrame:
    """Documents in blocks, with their own figures and the pairs that they hold."""
    spark = docs.sparkSession
    used = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_kind = dict(used.dtypes)["id"]
    schema = f"block long, ids array<{id_kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, sizes array<long>, codes binary, docs binary, places binary, times binary"
    short = F.coalesce(F.length("text") <= LONG, F.lit(True))

    def gather(batches, add, series: int):
        from pyspark import TaskContext

        number, block, kind = (2 * TaskContext.get().partitionId() + series) << 32, Block(), None
        for batch in batches:
            kind = batch["id"].type
            for at in range(0, batch.num_rows, TEXTS):
                add(batch.slice(at, TEXTS), block)
                if block.total >= BLOCK:
                    yield block.row(number, kind)
                    number, block = number + 1, Block()
        if block.ids:
            yield block.row(number, kind)

    def of_texts(batch, block):
        aligned(pair, batch["id"].to_pylist(), batch["text"].to_pylist(), block)

    def of_fragments(batch, block):
        for x in batch.to_pylist():
            if not hasattr(pair, "a"):
                pair.open()
            # What is open at the start of a text is a group like the others.
            f = BEGIN if x["bad"] else composed(pair, BEGIN, from_row(x))
            sha = hashlib.sha256(f.groups.encode()).hexdigest() if f.n_groups else ""
            block.add([x["id"]], [(f.n_a, f.n_b, f.n_groups, f.n_links, sha)], *f.links, [len(f.links[0])])

    written = stored(used.filter(short).mapInArrow(lambda batches: gather(batches, of_texts, 0), schema))
    keyed = stored(used.filter(~short).select(F.monotonically_increasing_id().alias("key"), "id", "text"))
    if keyed.isEmpty():
        return written
    whole = long_texts(keyed, pair).join(keyed.select("key", "id"), "key").drop("key")
    return written.unionByName(stored(whole.mapInArrow(lambda batches: gather(batches, of_fragments, 1), schema)))


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    with limited_batches(spark):
        id_kind = dict(docs.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]
        held = blocks(docs, pair, id_col, text_col)
        n_blocks, n_codes = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("codes") / 8), F.lit(0))).first()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_codes) // 1_000_000)
        groups = max(1, n_blocks)
        numbered = held.select("block", "codes", "docs").withColumn("grp", F.pmod(hash60(F.col("block")), F.lit(groups)))

        def deal(batches):
            for batch in batches:
                for x in batch.to_pylist():
                    codes, n = np.frombuffer(x["codes"], np.uint64), np.frombuffer(x["docs"], np.int64)
                    for bucket, at in exchange.dealt(codes >> np.uint64(SHIFT), buckets):
                        yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [x["block"]], "grp": [x["grp"]], "codes": [codes[at].tobytes()], "docs": [n[at].tobytes()]})

        pieces = stored(numbered.mapInArrow(deal, "bucket long, block long, grp long, codes binary, docs binary"))
        table = exchange.tree_sum(pieces, {"docs": np.int64}, groups)

        def answer(left: pa.Table, right: pa.Table):
            codes, n = exchange.joined(right["codes"], np.uint64), exchange.joined(right["docs"], np.int64)
            # A bucket has all pairs of its A ids, and they stand together.
            a = codes >> np.uint64(SHIFT)
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            best = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(a)))) == n
            for block, own in zip(left["block"].to_pylist(), left["codes"].to_pylist(), strict=True):
                at = np.searchsorted(codes, np.frombuffer(own, np.uint64))
                yield {"block": block, "bucket": left["bucket"][0].as_py(), "found": n[at].tobytes(), "best": best[at].tobytes()}

        answers = exchange.answered(pieces.drop("docs"), table, groups, answer, "block long, bucket long, found binary, best binary")
        out = f"`{id_col}` {id_kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            made = [[] for _ in range(8)]
            for x in left.to_pylist():
                codes = np.frombuffer(x["codes"], np.uint64)
                found, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
                got = {b: (f, t) for b, f, t in zip(*[right[c].to_pylist() for c in ("bucket", "found", "best")], strict=True)}
                for bucket, at in exchange.dealt(codes >> np.uint64(SHIFT), buckets):
                    found[at], best[at] = np.frombuffer(got[bucket][0], np.int64), np.frombuffer(got[bucket][1], bool)
                places, times = np.frombuffer(x["places"], np.int32), np.frombuffer(x["times"], np.int32)
                ends = np.concatenate([[0], np.cumsum(x["sizes"])]).astype(np.int64)
                sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])  # noqa: B023, E731
                columns = [x["ids"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], sums(times * best[places]).tolist(), sums(times * found[places]).tolist(), x["sha"]]
                for to, more in zip(made, columns, strict=True):
                    to.extend(more)
            kind = left.schema.field("ids").type.value_type
            fields = [kind, *[pa.int64()] * 6, pa.string()]
            return pa.table([pa.array(m, f) for m, f in zip(made, fields, strict=True)], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        return held.drop("docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out)
