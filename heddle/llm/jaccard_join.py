"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed word shingles. In each run a set chooses shared tokens by a hash of the
run's seed: a token is chosen where its hash falls below `choices` / (threshold * size), so that two sets
above the threshold choose a common one with a probability that doesn't depend on their size. Sets that
choose a token form a bucket. A bucket of at most `small` sets is compared by brute force; a larger one
is split again, by tokens chosen with a hash of its path, up to `levels` levels. Independent runs repeat
this until the expected recall at the threshold reaches `recall`.

Later levels choose from a sketch of the set, its least hashes, which is the whole set where that is
small. Brute force within a bucket compares sketches first; only sets with a partner that could reach the
threshold meet again in the same bucket with all their tokens, read from the texts once.

A pair that meets in several buckets belongs to the one of least path: every set carries the paths of its
buckets, and a bucket leaves out the pairs with a common path below its own. So links are counted once
without writing or comparing lists of pairs: a bucket yields a count of links for each member and the edges
of a spanning forest.

What is still large after the last level are sets that are truly alike but not equal. Their pairs are many
by themselves, so they are compared in blocks of at most `block` sets and `block_bytes` of tokens, each pair
of blocks a task's work of its own; only counts leave it. A set is then copied once for each block of its
bucket. No group is held by one task as a whole, and no pair is left out.

Equal sets are one class from the start, so copies are neither shuffled nor compared. Links between classes
are weighed by the number of their documents.

Words are runs of characters other than white space; a text of fewer than `width` words is one shingle.

Defined results: null, empty and blank texts have no shingles, no links and a class of their own each;
texts of any length are read whole; rows that repeat are copies of each other; null ids are ordinary
members (a class takes its least id that isn't null); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import hash60, persisted, small_batches, whole_text

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[str, int] = {}
#: Tokens of a sketch. Sets at the threshold share two thirds of them or more; pairs that share less than
#: this part are far below it (over four deviations).
SKETCH, SKETCH_THRESHOLD, SKETCH_SHARED = 96, 0.4, 0.6
#: Words whose hashes a worker remembers (a few megabytes), and sets of a tile of a comparison.
REMEMBERED, TILE = 50_000, 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that scatters its input."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    found = _WORDS.get(word)
    if found is None:
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(_WORDS) >= REMEMBERED:
            _WORDS.clear()
        _WORDS[word] = found
    return found


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's word shingles."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    n = max(1, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(hashes))):
        total = mixed(total + _STEP) + hashes[i : i + n]
    return np.unique(mixed(total))


def chosen(tokens: np.ndarray, path: int, threshold: float, choices: float) -> np.ndarray:
    """The paths that continue `path` by the tokens that a set chooses there."""
    hashes = mixed(tokens ^ mixed(np.array([path], np.uint64) + _STEP))
    limit = min(1.0, choices / (threshold * max(1, len(tokens))))
    return hashes if limit >= 1 else hashes[hashes < np.uint64(int(limit * 2**64))]


def needed_runs(threshold: float, choices: float, later: float, levels: int, recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, however deep its buckets.

    At the threshold t, sets of equal size share 2t / (1 + t) of their tokens, and the number of common
    choices is about Poisson; sketches share two thirds or more. A pair survives a level if one of its
    common choices survives the next.
    """
    survive = 1.0
    for level in reversed(range(levels)):
        mean = later * 2 / 3 / SKETCH_SHARED if level else choices * 2 / (1 + threshold)
        survive = 1 - math.exp(-mean * survive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survive)))


def _tiles(sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile of sets: the owner (within the tile) and token of each of their tokens, in the tokens' order, and the distinct tokens."""
    out = []
    for at in range(0, len(sets), TILE):
        part = sets[at : at + TILE]
        owner, token = np.repeat(np.arange(len(part)), [len(x) for x in part]), np.concatenate(part)
        order = np.argsort(token, kind="stable")
        out.append((owner[order], token[order], np.unique(token)))
    return out


def _common(a: tuple, b: tuple, width: int = 2048) -> np.ndarray:
    """The numbers of common tokens of the sets of two tiles: only tokens that both tiles have are looked at."""
    shared = a[2] if a is b else np.intersect1d(a[2], b[2], assume_unique=True)
    common = np.zeros((TILE, TILE), np.float32)
    if a is b:  # tokens of one set alone only matter on the diagonal, which nobody reads
        shared = shared[np.diff(np.append(np.searchsorted(a[1], shared), len(a[1]))) > 1]
    for low in range(0, len(shared), width):
        tokens, sides = shared[low : low + width], []
        for owner, token, _ in (a,) if a is b else (a, b):
            first, last = np.searchsorted(token, tokens[0]), np.searchsorted(token, tokens[-1], "right")
            at = np.searchsorted(tokens, token[first:last])
            own = tokens[at] == token[first:last]
            part = np.zeros((TILE, len(tokens)), np.float32)
            part[owner[first:last][own], at[own]] = 1
            sides.append(part)
        common += sides[0] @ sides[-1].T
    return common


def links_of(sets: list[np.ndarray], lower: list[np.ndarray], threshold: float, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i < j, with a Jaccard similarity of at least `threshold` and no common element of `lower`.

    With `left`, only pairs with i < left <= j. Sets are compared tile by tile.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float32)
    tiles, lowers, found = _tiles(sets), _tiles(lower), []
    for p, a in enumerate(tiles):
        for q in range(p, len(tiles)):
            rows, columns = np.arange(p * TILE, min(n, (p + 1) * TILE)), np.arange(q * TILE, min(n, (q + 1) * TILE))
            if left is not None and (rows[0] >= left or columns[-1] < left):
                continue
            common = _common(a, tiles[q])[: len(rows), : len(columns)]
            alike = (common > 0) & (common >= threshold * (sizes[rows][:, None] + sizes[columns][None, :] - common) - 1e-4)
            alike &= rows[:, None] < columns[None, :]
            if left is not None:
                alike &= (rows[:, None] < left) & (columns[None, :] >= left)
            if alike.any():
                alike &= _common(lowers[p], lowers[q])[: len(rows), : len(columns)] == 0
            i, j = np.nonzero(alike)
            found.append((rows[i], columns[j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            edges.append((a, b))
    return edges


def _choose_all(rows: DataFrame, seeds: list[int], threshold: float, choices: float, width: int) -> DataFrame:
    """Each row's id and key, and its set's signature, size, sketch and first paths, from (id, key, text)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sigs, sizes, sketches, all_paths = [], [], [], []
            for text in frame["text"]:
                tokens = shingles(text, width)
                sigs.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                sizes.append(len(tokens))
                # Hashes are sorted and scattered: the first ones are a sample of the set.
                sketches.append((tokens[:SKETCH] >> np.uint64(20)).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                all_paths.append(np.unique(np.concatenate([chosen(tokens, s, threshold, choices) for s in seeds])).view(np.int64) if len(tokens) else np.empty(0, np.int64))
            yield frame[["id", "key"]].assign(sig=sigs, n=sizes, sketch=sketches, paths=all_paths)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(batches, f"id {kind}, key binary, sig binary, n long, sketch binary, paths array<long>")


def _unpacked(sketch: bytes) -> np.ndarray:
    """A sketch's tokens, of 44 bits in 6 bytes each."""
    wide = np.zeros((len(sketch) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(sketch, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64)[:, 0]


def _choose_again(rows: DataFrame, choices: float) -> DataFrame:
    """(rep, path): how each set of `rows` (rep, sketch, within) continues the large buckets that it is in."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 1000):
                reps, paths = [], []
                for rep, sketch, within in frame.iloc[low : low + 1000][["rep", "sketch", "within"]].itertuples(index=False, name=None):
                    own = _unpacked(sketch)
                    for path in within:
                        new = chosen(own, int(path) & (1 << 64) - 1, SKETCH_SHARED, choices).view(np.int64)
                        reps += [rep] * len(new)
                        paths += new.tolist()
                yield pd.DataFrame({"rep": pd.Series(reps, dtype=object), "path": pd.Series(paths, dtype=np.int64)})

    return rows.mapInPandas(batches, "rep binary, path long")


def _grouped(frames: Iterator[pd.DataFrame], each) -> Iterator[list]:
    """The results of `each` (rows of one place) as a list per batch; a place's rows follow each other."""
    held: list[tuple] = []
    for frame in frames:
        out: list = []
        for row in frame.itertuples(index=False, name=None):
            if held and held[0][0] != row[0]:
                each(held, out)
                held = []
            held.append(row)
        yield out
    out = []
    if held:
        each(held, out)
    yield out


def _sides(rows: list[tuple]) -> tuple[list[tuple], int | None]:
    """A place's rows, the left block first, and the size of that block; None where all are compared with all."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    sides = [r[1] for r in rows]
    return rows, None if sides[-1] == 2 else sides.count(0)


def _lower(rows: list[tuple]) -> list[np.ndarray]:
    """The paths below a place's own that its members have."""
    return [np.asarray(r[5], np.int64)[np.asarray(r[5], np.int64) < r[4]] for r in rows]


def _pairs(rows: list[tuple], read, threshold: float) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The rows (place, side, rep, set, path, paths, ...) of a place, and its own pairs of them."""
    rows, left = _sides(rows)
    if len(rows) < 2 or left == 0 or left == len(rows):
        return rows, np.empty(0, np.int64), np.empty(0, np.int64)
    return rows, *links_of([read(r[3]) for r in rows], _lower(rows), threshold, left)


def _candidates(members: DataFrame) -> DataFrame:
    """(path, rep): the sets with a partner whose similarity may reach the threshold, from (place, side, rep, sketch, path, paths)."""

    def compare(rows: list[tuple], out: list) -> None:
        rows, i, j = _pairs(rows, _unpacked, SKETCH_THRESHOLD)
        out += [(rows[k][4], rows[k][2]) for k in np.union1d(i, j)]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _grouped(frames, compare):
            yield pd.DataFrame(out, columns=["path", "rep"])

    return members.mapInPandas(batches, "path long, rep binary")


def _with_tokens(rows: DataFrame, width: int) -> DataFrame:
    """(place, side, rep, tokens, path, paths, w) for each place of `rows` (rep, text, w, paths, at: its places)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 100):
                out = []
                for rep, text, w, paths, at in frame.iloc[low : low + 100][["rep", "text", "w", "paths", "at"]].itertuples(index=False, name=None):
                    tokens = shingles(text, width).tobytes()
                    out += [(a["place"], a["side"], rep, tokens, a["path"], paths, w) for a in at]
                yield pd.DataFrame(out, columns=["place", "side", "rep", "tokens", "path", "paths", "w"])

    return rows.mapInPandas(batches, "place long, side int, rep binary, tokens binary, path long, paths array<long>, w long")


def _compared(members: DataFrame, threshold: float) -> DataFrame:
    """Links within places, from `members` (place, side, rep, tokens, path, paths, w); a pair belongs to one place only.

    A row (rep, links, other) adds `links` documents to a member's links; with `other`, it is an edge of
    a spanning forest.
    """

    def compare(rows: list[tuple], out: list) -> None:
        rows, i, j = _pairs(rows, lambda tokens: np.frombuffer(tokens, np.uint64), threshold)
        if not len(i):
            return
        weights = np.array([r[6] for r in rows], np.int64)
        links = np.bincount(i, weights[j], len(rows)) + np.bincount(j, weights[i], len(rows))
        out += [(rows[k][2], int(links[k]), None) for k in np.flatnonzero(links)]
        out += [(rows[a][2], 0, rows[b][2]) for a, b in _forest(len(rows), i, j)]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _grouped(frames, compare):
            yield pd.DataFrame(out, columns=["rep", "links", "other"])

    return members.mapInPandas(batches, "rep binary, links long, other binary")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of the nodes of `edges` (a, b): root is the least node that it is connected to.

    Each round, every node takes the least root among its neighbours' and then its root's root.
    """
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))
    both = persisted(edges.select(F.inline(ways)).distinct())
    roots = persisted(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("root")))
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("node").alias("next"), F.col("root").alias("r")), "next").groupBy("node").agg(F.min("r").alias("r"))
        lower = roots.join(near, "node").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).cast("int").alias("moved"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = persisted(lower.join(jump, "root").select("node", F.col("above").alias("root"), F.greatest("moved", (F.col("above") < F.col("root")).cast("int")).alias("moved")))
        moved = new.agg(F.max("moved")).first()[0]
        roots = new.select("node", "root")
        if not moved:
            return roots
    raise RuntimeError("components did not settle")


def buckets(sets: DataFrame, later: float, levels: int, small: int) -> DataFrame:
    """(path, members, rep): the buckets to compare, from `sets` (rep, paths, sketch).

    Those with more than `small` members are those that the last level has left. Of buckets with the same
    members, one is kept.
    """
    path = sets.select("rep", F.explode("paths").alias("path"))
    done = None
    for level in range(levels):
        # Written first, so that the join with a frequent path can be split over tasks.
        counts = persisted(path.groupBy("path").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
        found = persisted(path.join(counts, "path"))
        last = level + 1 == levels
        ready = found if last else found.filter(F.col("members") <= small)
        done = ready if done is None else done.unionByName(ready)
        large = found.filter(F.col("members") > small)
        if last or large.isEmpty():
            break
        within = large.groupBy("rep").agg(F.collect_list("path").alias("within"))
        path = persisted(_choose_again(sets.select("rep", "sketch").join(within, "rep"), later).distinct())
    # Signatures add up 60-bit hashes in three ways; equal ones with equal counts have the same members.
    low = F.lit((1 << 30) - 1)
    mark = [F.sum(part).alias(f"mark{i}") for i, part in enumerate((hash60(F.col("rep")).bitwiseAND(low), F.shiftright(hash60(F.col("rep")), 30), hash60(F.col("rep"), F.lit(1)).bitwiseAND(low)))]
    kept = done.groupBy("path", "members").agg(*mark).groupBy("members", "mark0", "mark1", "mark2").agg(F.min("path").alias("path")).select("path")
    return persisted(done.join(persisted(kept), "path"))


def placed(found: DataFrame, blocks: Column) -> DataFrame:
    """`found` (path, rep, ...) with place and side: a bucket is a place; one of several blocks is a place for each pair of them."""
    own = hash60(F.col("rep"), F.lit("block")) % F.col("blocks")
    parts = found.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("long")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = F.when(F.col("blocks") == 1, F.col("path")).otherwise(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return parts.withColumn("place", place).withColumn("side", side).drop("blocks", "own", "other")


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("place").sortWithinPartitions("place")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, choices: float = 1.6, later: float = 1.0, levels: int = 3, small: int = 128, block: int = 1024, block_bytes: int = 16 << 20, recall: float = 0.999) -> DataFrame:
    """(id, key, class_id, n_links) for each row of `docs`; `key` is a digest of the text.

    `class_id` is the least id of the rows connected by links, and `n_links` the number of other rows with a
    similarity of at least `threshold`.
    """
    small_batches(docs.sparkSession)
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    seeds = list(range(1, needed_runs(threshold, choices, later, levels, recall) + 1))
    rows = persisted(_choose_all(texts, seeds, threshold, choices, width))
    grouped = rows.filter("n > 0").groupBy("sig").agg(F.min(F.struct("key", "id")).alias("first"), F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    sets = persisted(grouped.select("sig", F.col("first.key").alias("rep"), F.col("first.id").alias("rep_id"), "w", "n", "paths", "sketch"))
    found = buckets(sets, later, levels, small)
    # The paths of a set's buckets: a few for each run, whatever the input.
    paths = persisted(found.groupBy("rep").agg(F.sort_array(F.collect_set("path")).alias("paths")))
    met = found.join(sets.select("rep", "sketch").join(paths, "rep"), "rep")
    near = _candidates(together(placed(met, F.ceil(F.col("members") / block)).select("place", "side", "rep", "sketch", "path", "paths")))
    near = persisted(near.distinct().join(sets.select("rep", "rep_id", "w", "n"), "rep"))
    weights = persisted(near.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum(8 * F.col("n")).alias("bytes")))
    at = placed(near.join(weights, "path"), F.ceil(F.greatest(F.col("members") / block, F.col("bytes") / block_bytes)))
    wanted = at.groupBy("rep", "rep_id", "w").agg(F.collect_list(F.struct("place", "side", "path")).alias("at")).join(paths, "rep")
    same = (texts["key"] == wanted["rep"]) & texts["id"].eqNullSafe(wanted["rep_id"])
    # Rows that repeat an id and its text come several times.
    read = texts.join(wanted, same).select("rep", "text", "w", "paths", "at").dropDuplicates(["rep"])
    linked = persisted(_compared(together(_with_tokens(read, width)), threshold))
    roots = components(linked.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = linked.filter("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    of_set = sets.select("sig", "rep", "w").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_set = of_set.select("sig", F.coalesce("root", "rep").alias("root"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    answers = persisted(rows.select("id", "key", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(of_set, "sig", "left").drop("sig"))
    # A class is named by its least id, null last; of texts that share it, the one of least key stands for the class.
    least = answers.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    alone, own = F.col("root").isNull(), F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    named = answers.join(least, "root", "left")
    return named.select("id", "key", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | own).alias("stays"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, class_id and n_links."""
    return classes(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class: that of the least id (null last) and, where different texts share it, of the least digest.
    Columns are as they were.

    Rows that repeat both an id and its text count as one document; if they differ elsewhere, the first by all columns stays.
    """
    found = persisted(classes(docs, id_col, text_col, **options))
    gone = found.filter(~F.col("stays")).select("id", "key").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(whole_text(text_col))).alias("key"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"))
    kept = rows.join(gone, (rows["key"] == gone["gone_key"]) & rows["id"].eqNullSafe(gone["gone_id"]), "left_anti")
    repeated = found.groupBy("id", "key").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*")
