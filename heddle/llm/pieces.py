"""SentencePiece encoding and decoding with N-best segmentation.

Segmentations are paths through the lattice of a model file's pieces, scored by the sum of the pieces'
scores. A model of the unigram kind gives log-probabilities. One of the BPE kind only gives the order in
which pieces were merged, the most frequent first: the r-th piece then scores as the r-th most frequent
under Zipf's law (`zipf_scores`), so that sums are log-probabilities and fewer, more frequent pieces win.
Ids are the model file's, but the best segmentation isn't what that model's own greedy merging gives. A forward Viterbi pass gives the best score up to every position; these are exact heuristics
for an A* search from the end backward, which yields the N best paths in order.

No piece has a space mark after another character, so the lattice of a text is a chain of the lattices
of its units (a run of space marks and what follows it; a character in no piece is a unit too), and the N best paths of the chain differ from
the best one only in the units of smallest loss. The forward pass notes each unit's loss (the least that
any second path costs), so the search runs only in the units that can matter; this leaves the results of
a search over the whole text unchanged. Equal scores are ordered by the position of the first piece that
differs from the end; `encode_exhaustive` in the tests fixes this.

Characters without a piece become their UTF-8 bytes, at `UNKNOWN` below the least score. A space mark
within a text is encoded as bytes too, so that decoding gives back every text exactly.

Defined results: null and empty text have no pieces and score 0; very long texts and units are encoded
whole; rows that repeat give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches

MARK = "▁"
#: The score of a character without a piece, below the least score of any piece.
UNKNOWN = 10.0
#: Units whose best path a worker remembers, about 250 bytes each, and units whose n best paths it remembers.
REMEMBERED, SEARCHED = 150_000, 10_000
#: Scores are multiples of this, so that their sums are exact in any order.
GRAIN = 2.0**-20


def zipf_scores(scores: dict[str, float]) -> dict[str, float]:
    """Log-probabilities by Zipf's law, from scores of which only the order counts."""
    ordered = sorted(scores, key=lambda p: -scores[p])
    total = sum(1 / r for r in range(1, len(ordered) + 1))
    return {p: round(-math.log(r * total) / GRAIN) * GRAIN for r, p in enumerate(ordered, 1)}


#: Fixed values of the model file format: numbers of the trainer specification, of its model type, and of BPE.
TRAINER, MODEL_TYPE, BPE = 2, 3, 2


def _fields(data: bytes):
    """The (number, value) of the fields of a serialised message; values are ints or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def model_type(data: bytes) -> int:
    """The model type that a model file names: 1 (the default) is unigram, 2 is BPE."""
    return next((value for number, trainer in _fields(data) if number == TRAINER for inner, value in _fields(trainer) if inner == MODEL_TYPE), 1)


class Known:
    """The best paths of units: ids, score and loss, as arrays. Unit 0 is a space mark of a text's own."""

    def __init__(self, mark_ids: tuple[int, ...], mark_score: float):
        self.index: dict[str | None, int] = {}
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.score, self.loss = np.zeros(1024), np.zeros(1024)
        self.ids, self.used = np.zeros(8192, np.int32), 0
        self.add([None], np.array(mark_ids, np.int32), np.array([len(mark_ids)]), np.array([mark_score]), np.array([np.inf]))

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array)), array.dtype)])

    def add(self, units: list[str | None], ids: np.ndarray, count: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        at, end = len(self.index), len(self.index) + len(units)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        for name, values in (("start", self.used + np.cumsum(count) - count), ("count", count), ("score", score), ("loss", loss)):
            room = self._room(getattr(self, name), end)
            room[at:end] = values
            setattr(self, name, room)
        self.used += len(ids)
        self.index.update(zip(units, range(at, end), strict=True))

    def path(self, unit: str | None) -> tuple[tuple[int, ...], float, float]:
        i = self.index[unit]
        return tuple(self.ids[self.start[i] : self.start[i] + self.count[i]].tolist()), float(self.score[i]), float(self.loss[i])


def gathered(source: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The parts of `source` from each start, `count` long, one after another."""
    ends = np.cumsum(count)
    return source[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


#: Kinds of characters in the tables: in no piece, and in pieces but not in the tables.
NONE, OTHER = 0, 255


class Tables:
    """The trie of the pieces that consist of the most frequent characters, as arrays.

    State 0 is the end of all walks and state 1 the root.
    """

    def __init__(self, pieces: Pieces, characters: int = 160):
        from collections import Counter

        often = Counter(c for p in pieces.scores for c in set(p))
        kinds = {c: k for k, (c, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:characters], 1)}
        self.kind = np.full(0x110000, NONE, np.uint8)
        for c in often:
            self.kind[ord(c)] = kinds.get(c, OTHER)
        inside = [p for p in pieces.scores if all(c in kinds for c in p)]
        states = {"": 1} | {x: i for i, x in enumerate(sorted({p[:n] for p in inside for n in range(1, len(p) + 1)}), 2)}
        self.step = np.zeros((len(states) + 1, characters + 1), np.int32)
        self.score, self.piece = np.full(len(states) + 1, -np.inf), np.full(len(states) + 1, -1, np.int32)
        for x, i in states.items():
            if x:
                self.step[states[x[:-1]], kinds[x[-1]]] = i
        for p in inside:
            self.score[states[p]], self.piece[states[p]] = pieces.scores[p], pieces.ids[p]


class Pieces:
    """The pieces of a model file. Made on the driver and sent to the executors: its size is the vocabulary's."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int]):
        self.scores, self.ids, self.byte_ids = scores, ids, byte_ids
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self._spelled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._prefixes = {p[:n] for p in scores for n in range(1, len(p) + 1)}
        self._known: Known | None = None
        self._searched: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self._tabled: Tables | None = None
        held = set().union(*scores)
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in held)
        self._units = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has a space mark after another character")

    def __reduce__(self):
        return Pieces, (self.scores, self.ids, self.byte_ids)

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        scores, ids, byte_ids = {}, {}, [0] * 256
        with open(model_file, "rb") as file:
            bpe = model_type(file.read()) == BPE
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                scores[piece], ids[piece] = model.get_score(i), i
        return cls(zipf_scores(scores) if bpe else {p: round(x / GRAIN) * GRAIN for p, x in scores.items()}, ids, byte_ids)

    def edges(self, unit: str) -> list[list[tuple[int, float]]]:
        """For each end position, the (start, score) of the pieces that end there, shortest first."""
        found: list[list[tuple[int, float]]] = [[] for _ in range(len(unit) + 1)]
        scores, prefixes, n = self.scores, self._prefixes, len(unit)
        for start in range(n):
            if unit[start] not in scores:
                found[start + 1].append((start, self.unknown))
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = unit[start:end]
                if piece in scores:
                    found[end].append((start, scores[piece]))
                elif piece not in prefixes:
                    break
        return found

    def forward(self, unit: str) -> tuple[list[float], list[int], list[float]]:
        """Best scores up to each position, the start of the best last piece there, and the loss of the second best."""
        scores, prefixes, n, longest = self.scores, self._prefixes, len(unit), self.longest
        least = float("-inf")
        best, start_of, second = [least] * (n + 1), [0] * (n + 1), [least] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if unit[start] not in scores:
                self._offer(best, start_of, second, start + 1, here + self.unknown, start)
            for end in range(start + 1, min(n, start + longest) + 1):
                piece = unit[start:end]
                score = scores.get(piece)
                if score is not None:
                    total = here + score
                    if total >= best[end]:
                        second[end], best[end], start_of[end] = best[end], total, start
                    elif total > second[end]:
                        second[end] = total
                elif piece not in prefixes:
                    break
        return best, start_of, second

    @staticmethod
    def _offer(best: list[float], start_of: list[int], second: list[float], end: int, total: float, start: int) -> None:
        if total >= best[end]:
            second[end], best[end], start_of[end] = best[end], total, start
        elif total > second[end]:
            second[end] = total

    def known(self) -> Known:
        if self._known is None:
            self._known = Known(tuple(self.byte_ids[b] for b in MARK.encode("utf-8")), self.unknown)
        return self._known

    def learn(self, units) -> None:
        """Find and remember the best paths of units, many at once."""
        known = self.known()
        fresh = [u for u in units if u not in known.index]
        if len(known.index) + len(fresh) > REMEMBERED:
            # Of what is known, only these units' paths stay.
            old, known = known, Known(tuple(self.byte_ids[b] for b in MARK.encode("utf-8")), self.unknown)
            stay = [u for u in units if u is not None and u in old.index]
            at = np.fromiter(map(old.index.__getitem__, stay), np.int64, len(stay))
            known.add(stay, gathered(old.ids, old.start[at], old.count[at]), old.count[at], old.score[at], old.loss[at])
            self._known = known
        fresh.sort(key=len)
        tables = self._tables()
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            kinds = tables.kind[codes]
            odd = np.bincount(np.repeat(np.arange(len(part)), lengths), kinds == OTHER, len(part)) > 0
            odd |= lengths > 64
            even = np.flatnonzero(~odd)
            single = [part[i] for i in np.flatnonzero(odd)]
            if len(even):
                own = ~np.repeat(odd, lengths)
                single += self._best_many(known, [part[i] for i in even], codes[own], kinds[own], lengths[even])
            for unit in single:
                ids, score, loss = self.best_of(unit)
                known.add([unit], np.array(ids, np.int32), np.array([len(ids)]), np.array([score]), np.array([loss]))

    def _best_many(self, known: Known, units: list[str], codes: np.ndarray, kinds: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Adds the `best_of` units by one forward pass over all: from each start, walk the trie of pieces in step.

        Returns the units whose best path holds characters of several bytes without a piece, which it leaves out."""
        tables, (n, width) = self._tables(), (len(units), int(lengths[-1]))
        letters = np.zeros((n, width), np.uint8)
        letters[np.arange(width) < lengths[:, None]] = kinds
        # The id of a character's byte, where it has one byte.
        bytes_of = np.full((n, width), -1, np.int32)
        bytes_of[np.arange(width) < lengths[:, None]] = np.append(np.array(self.byte_ids[:128], np.int32), -1)[np.minimum(codes, 128)]
        best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        start_of, piece_of = np.zeros((width + 1, n), np.int16), np.full((width + 1, n), -1, np.int32)
        best[0] = 0.0

        def offer(rows: np.ndarray, start: int, end: int, score, piece) -> None:
            total, so_far = best[start][rows] + score, best[end][rows]
            better = total >= so_far
            second[end][rows] = np.where(better, so_far, np.maximum(second[end][rows], total))
            up = rows[better]
            best[end][up], start_of[end][up] = total[better], start
            piece_of[end][up] = piece[better] if isinstance(piece, np.ndarray) else piece

        for start in range(width):
            rows = np.arange(np.searchsorted(lengths, start, "right"), n)
            state = tables.step[1][letters[rows, start]]
            lone = rows[tables.score[state] == -np.inf]
            if len(lone):
                offer(lone, start, start + 1, self.unknown, -1)
            end = start
            while True:
                alive = state > 0
                rows, state = rows[alive], state[alive]
                score = tables.score[state]
                ends = score > -np.inf
                if ends.any():
                    offer(rows[ends], start, end + 1, score[ends], tables.piece[state[ends]])
                end += 1
                longer = lengths[rows] > end
                rows = rows[longer]
                if not len(rows):
                    break
                state = tables.step[state[longer], letters[rows, end]]
        every, at, loss, back = np.arange(n), lengths.copy(), np.full(n, np.inf), []
        while at.any():
            live = at > 0
            loss = np.where(live, np.minimum(loss, best[at, every] - second[at, every]), loss)
            start, piece = np.where(live, start_of[at, every], 0), piece_of[at, every]
            back.append(np.where(live, np.where(piece < 0, bytes_of[every, start], piece), -2))
            at = start
        ids = np.stack(back[::-1], axis=1)
        plain = ~(ids == -1).any(axis=1)
        ids = ids[plain]
        known.add([units[i] for i in np.flatnonzero(plain)], ids[ids >= 0], (ids >= 0).sum(axis=1), best[lengths, every][plain], loss[plain])
        return [units[i] for i in np.flatnonzero(~plain)]

    def _tables(self) -> Tables:
        if self._tabled is None:
            self._tabled = Tables(self)
        return self._tabled

    def best(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """The ids and score of the best path, and the loss of the second best path."""
        if unit not in self.known().index:
            self.learn([unit])
        return self.known().path(unit)

    def best_of(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        best, start_of, second = self.forward(unit)
        cuts, end, loss = [], len(unit), float("inf")
        while end > 0:
            loss = min(loss, best[end] - second[end])
            cuts.append((start_of[end], end))
            end = start_of[end]
        return self.to_ids(unit, reversed(cuts)), best[len(unit)], loss

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a unit, best first, by A* from its end with the forward scores as heuristics."""
        best, _, _ = self.forward(unit)
        edges, out = self.edges(unit), []
        # (-(score of the whole), order, position, score behind the position, cuts behind it as a linked list)
        heap, order = [(-best[len(unit)], 0, len(unit), 0.0, None)], 1
        while heap and len(out) < n:
            total, _, at, behind, cuts = heapq.heappop(heap)
            if at == 0:
                path = []
                while cuts:
                    start, end, cuts = cuts
                    path.append((start, end))
                out.append((-total, self.to_ids(unit, path)))
                continue
            for start, score in edges[at]:
                heapq.heappush(heap, (-(best[start] + score + behind), -order, start, behind + score, (start, at, cuts)))
                order += 1
        return out

    def to_ids(self, unit: str, cuts) -> tuple[int, ...]:
        out: list[int] = []
        for start, end in cuts:
            i = self.ids.get(unit[start:end])
            out += [i] if i is not None else [self.byte_ids[b] for b in unit[start:end].encode("utf-8")]
        return tuple(out)

    def units(self, text: str) -> list[str]:
        """The text's units; a space mark of the text's own becomes a unit that no piece matches."""
        if not text:
            return []
        if MARK not in text:
            return self._units.findall(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for i, part in enumerate((" " + text).split(MARK)):
            out += [None] * (i > 0) + self._units.findall(part.replace(" ", MARK))
        return out

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a text, best first: (score, ids)."""
        score, ids, others = next(self.encode_many([text or ""], n))
        return [(score, ids), *((other, make()) for other, make in others)]

    def encode_many(self, texts: list[str], n: int = 1) -> Iterator[tuple[float, np.ndarray, list]]:
        """For each text: the score and ids of its best segmentation; for the n - 1 next, scores and
        functions that make the ids."""
        per_text = [self.units(text) for text in texts]
        fresh = set(chain.from_iterable(per_text))
        fresh.discard(None)
        self.learn(fresh)
        known = self.known()
        ends = np.cumsum([0, *map(len, per_text)])
        at = np.fromiter(map(known.index.__getitem__, chain.from_iterable(per_text)), np.int64, ends[-1])
        count, score, loss = known.count[at], known.score[at], known.loss[at]
        flat, cuts = gathered(known.ids, known.start[at], count), np.concatenate([[0], np.cumsum(count)])
        for units, a, b in zip(per_text, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            ids, total = flat[cuts[a] : cuts[b]], float(score[a:b].sum())
            yield total, ids, self._others(units, cuts[a : b + 1] - cuts[a], ids, total, loss[a:b], n) if n > 1 and units else []

    def _searches(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        found = self._searched.get((unit, n))
        if found is None:
            found = self.n_best(unit, n)
            if len(unit) <= 64:
                if len(self._searched) >= SEARCHED:
                    self._searched.clear()
                self._searched[unit, n] = found
        return found

    def _others(self, units: list[str], starts: np.ndarray, flat: np.ndarray, score: float, losses: np.ndarray, n: int) -> list[tuple[float, object]]:
        """The second to n-th best choices of paths: only the n - 1 units of least loss can leave their best path."""
        kth = min(n - 1, len(losses)) - 1
        limit = np.partition(losses, kth)[kth]
        # Where losses tie, the last units come first.
        at = [int(i) for i in np.flatnonzero(losses <= limit)[::-1] if np.isfinite(losses[i])]
        at = sorted(at, key=lambda i: losses[i])[: n - 1]
        options = [self._searches(units[i], n) for i in at]

        def maker(choice: tuple[int, ...]):
            def make() -> np.ndarray:
                parts, done = [], 0
                for i, option, k in sorted(zip(at, options, choice, strict=True), key=lambda x: x[0]):
                    parts += [flat[done : starts[i]], np.array(option[k][1], np.int32)]
                    done = starts[i + 1]
                return np.concatenate([*parts, flat[done:]])

            return make

        heap, seen, out = [(0.0, (0,) * len(at))], {(0,) * len(at)}, []
        while heap and len(out) < n:
            loss, choice = heapq.heappop(heap)
            out.append((score - loss, maker(choice)))
            for j, option in enumerate(options):
                if choice[j] + 1 < len(option):
                    nxt = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (sum(o[0][0] - o[k][0] for o, k in zip(options, nxt, strict=True)), nxt))
        return out[1:]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the pieces, one after another, and the number of bytes of each."""
        if self._spelled is None:
            each = {i: p.replace(MARK, " ").encode("utf-8") for p, i in self.ids.items()} | {i: bytes((b,)) for b, i in enumerate(self.byte_ids)}
            size = np.zeros(max(each) + 1, np.int64)
            size[list(each)] = list(map(len, each.values()))
            self._spelled = np.frombuffer(b"".join(each.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size, size
        table, start, size = self._spelled
        return gathered(table, start[ids], size[ids]), size[ids]

    def decode(self, ids: list[int]) -> str:
        return self.spelled(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", errors="replace")[1:]


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", n: int = 3, keep_ids: bool = True) -> DataFrame:
    """Each row's id, n_pieces, score, n_best (score and ids of each segmentation, best first), ids_crc32 (of
    the best path's ids as little-endian 32-bit integers), decodes (whether the best ids give back the text)
    and, unless left out, the best ids once more as a column of their own."""
    import zlib

    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]), pa.int32()))

    def batches(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for record in records:
            for at in range(0, record.num_rows, 250):
                part = record.slice(at, 250)
                texts = part.column(1).to_pylist()
                best, scores, crcs, right, paths, path_scores, ends = [], [], [], [], [], [], [0]
                for text, (score, ids, others) in zip(texts, own.encode_many(texts, n), strict=True):
                    best.append(ids)
                    scores.append(score)
                    crcs.append(zlib.crc32(ids.astype("<i4").tobytes()))
                    right.append(own.spelled(ids)[0].tobytes() == b" " * (text != "") + text.encode("utf-8"))
                    paths += [ids, *(make() for _, make in others)]
                    path_scores += [score, *(other for other, _ in others)]
                    ends.append(len(paths))
                each = pa.StructArray.from_arrays([pa.array(path_scores, pa.float64()), lists(paths)], ["score", "ids"])
                n_best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
                columns = [part.column(0), pa.array(list(map(len, best)), pa.int64()), pa.array(scores, pa.float64()), n_best, pa.array(crcs, pa.int64()), pa.array(right, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, *([lists(best)] if keep_ids else [])], names)

    names = ["id", "n_pieces", "score", "n_best", "ids_crc32", "decodes", *(["ids"] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_pieces long, score double, n_best array<struct<score:double,ids:array<int>>>, ids_crc32 long, decodes boolean" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """`rows` with `text`, decoded from the ids; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else sent.value.decode([int(i) for i in x]) if len(x) else "")

    return rows.withColumn("text", text_of(F.col(ids_col)))
