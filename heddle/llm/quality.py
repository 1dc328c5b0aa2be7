"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of their vote patterns, taken over all documents, estimates each labeller's accuracy;
the posterior labels train a linear scorer on hashed word shapes, which generalises beyond the votes'
thresholds. No true label is used.

The scorer is fitted on at most `sample` documents, those of the smallest id hashes; vote counts cover
all documents, and the scorer is applied to all whole texts.

Defined results: null text is empty; empty text is rejected with score 0; with no documents (or none
that a labeller votes on) every non-empty text scores the prior; repeated rows score equally; extra
columns pass through `keep` untouched.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import hash60, persisted, small_batches, whole_text

#: Hashed features of the scorer.
DIMENSIONS = 1 << 12
GOOD, BAD, NONE = "+", "-", "0"


def _shape_table() -> np.ndarray:
    """For each character, the byte that stands for it in word shapes."""
    table = np.full(0x110000, ord("u"), np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.isspace():
            shape = "\n" if c == "\n" else " "
        elif c.isalpha():
            shape = "A" if unicodedata.category(c) == "Lu" else "a"
        elif c.isdigit():
            shape = "0"
        else:
            shape = c if code < 128 and c.isprintable() else "u"
        table[code] = ord(shape)
    table[0x3000:0xE000] = ord("a")  # scripts without case
    table[0x3000] = ord(" ")
    return table


SHAPES = _shape_table()
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in map(chr, range(33, 127)) if not c.isalnum()]] = True
_BUCKETS: dict[bytes, int] = {}


def _bucket(token: bytes) -> int:
    found = _BUCKETS.get(token)
    if found is None:
        found = zlib.crc32(token) % DIMENSIONS
        if len(_BUCKETS) < 20_000 and len(token) < 100:  # a few megabytes a worker
            _BUCKETS[token] = found
    return found


@dataclass
class Reading:
    """What labellers and the scorer see of a text."""

    words: int
    shapes: Counter
    marks: float  # share of ASCII punctuation among characters that aren't white space
    doubled: float  # punctuation marks that repeat the one before, by word
    upper: float  # share of upper-case among letters
    bars: float  # bars by word
    cells: float  # share of lines with several bars
    stutter: float  # share of words equal to the one before
    fresh: float  # share of distinct words
    line_repeats: float
    lines: int
    ends: float  # share of words with a full stop or the like at their end
    word_length: float


def read_text(text: str) -> Reading:
    words = text.split()
    n = max(1, len(words))
    codes = SHAPES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    count = np.bincount(codes, minlength=256)
    visible = max(1, len(codes) - int(count[32] + count[10]))
    same = codes[1:] == codes[:-1]
    marked = _MARKS[codes]
    doubled = int(np.count_nonzero(same & marked[1:]))
    keep = np.ones(len(codes), bool)
    keep[1:] = ~same
    shapes = Counter(codes[keep].tobytes().split())
    upper, lower = int(count[65]), int(count[97])
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(k for s, k in shapes.items() if s[-1:] in b".?!:;")
    stutter = sum(map(str.__eq__, words, words[1:]))
    return Reading(len(words), shapes, int(np.count_nonzero(marked)) / visible, doubled / n, upper / max(1, upper + lower), int(count[124]) / n, sum(x.count("|") > 1 for x in lines) / max(1, len(lines)), stutter / n, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), len(lines), ends / n, visible / n)


def _vote(value: float, good_to: float, bad_from: float) -> str:
    return GOOD if value <= good_to else BAD if value >= bad_from else NONE


#: Each votes on a reading; thresholds are on shares of words or characters.
LABELLERS = {
    "doubled marks": lambda r: _vote(r.doubled, 0.03, 0.15),
    "capitals": lambda r: NONE if r.words < 8 else _vote(r.upper, 0.2, 0.35),
    "bars": lambda r: _vote(r.bars, 0.02, 0.15),
    "table lines": lambda r: _vote(r.cells, 0.05, 0.3),
    "stutter": lambda r: _vote(r.stutter, 0.05, 0.15),
    "fresh words": lambda r: NONE if r.words < 30 else _vote(1 - r.fresh, 0.6, 0.8),
    "mark share": lambda r: NONE if r.words < 12 else _vote(r.marks, 0.06, 0.14),
    "repeated lines": lambda r: NONE if r.lines < 4 else _vote(r.line_repeats, 0.2, 0.5),
    "sentence ends": lambda r: NONE if r.words < 20 else GOOD if 0.01 <= r.ends <= 0.3 else BAD,
    "word length": lambda r: NONE if r.words < 20 else GOOD if 2.5 <= r.word_length <= 12 else BAD,
}


def votes(reading: Reading) -> str:
    return "".join(label(reading) for label in LABELLERS.values()) if reading.words else NONE * len(LABELLERS)


def features(reading: Reading) -> tuple[list[int], list[float]]:
    """Hashed features: shares of word shapes, and the levels of the other shares."""
    n = max(1, reading.words)
    found: dict[int, float] = {}
    for shape, k in reading.shapes.items():
        at = _bucket(b"shape " + shape)
        found[at] = found.get(at, 0.0) + min(1.0, k / n)
    for name, share in (("doubled", reading.doubled), ("upper", reading.upper), ("bars", reading.bars), ("cells", reading.cells), ("stutter", reading.stutter), ("stale", 1 - reading.fresh), ("marks", reading.marks), ("lines", reading.line_repeats), ("ends", reading.ends)):
        found[_bucket(f"share {name} {min(9, int(share * 20))}".encode())] = 1.0
        found[_bucket(f"level {name}".encode())] = min(1.0, share)
    return list(found), list(found.values())


@dataclass
class LabelModel:
    prior: float
    #: accuracy[labeller, class, vote]; classes bad and good, votes bad and good
    accuracy: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of good for each vote pattern."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for j in range(len(self.accuracy)):
            for vote, mark in enumerate((BAD, GOOD)):
                log[[p[j] == mark for p in patterns]] += np.log(self.accuracy[j, :, vote])
        log -= log.max(axis=1, keepdims=True)
        return np.exp(log[:, 1]) / np.exp(log).sum(axis=1)


def fit_labels(counts: dict[str, int], rounds: int = 100, tolerance: float = 1e-7) -> LabelModel:
    """EM from the vote patterns' counts: at most 3 ** labellers of them, whatever the number of documents.

    Starts from the view that one bad vote weighs as much as the good ones together, since labellers
    look for different faults.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    m = len(LABELLERS)
    good = np.array([0.05 if BAD in p else 0.95 if GOOD in p else 0.5 for p in patterns])
    model = LabelModel(0.8, np.tile(np.array([[0.5, 0.5], [0.05, 0.95]]), (m, 1, 1)))
    if not patterns:
        return model
    for _ in range(rounds):
        prior = (weight @ good + 8) / (weight.sum() + 10)
        accuracy = np.empty((m, 2, 2))
        for j in range(m):
            for vote, mark in enumerate((BAD, GOOD)):
                has = np.array([p[j] == mark for p in patterns])
                # Smoothing that keeps each labeller better than chance.
                accuracy[j, 1, vote] = (weight * good)[has].sum() + (1 if vote == 0 else 9)
                accuracy[j, 0, vote] = (weight * (1 - good))[has].sum() + 5
        accuracy /= accuracy.sum(axis=2, keepdims=True)
        model = LabelModel(float(prior), accuracy)
        new = model.posterior(patterns)
        moved, good = np.abs(new - good).max(), new
        if moved < tolerance:
            break
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        if not text or not text.strip():
            return 0.0
        at, values = features(read_text(text))
        return float(1 / (1 + np.exp(-(self.weights[at] @ values + self.bias))))


def fit_scorer(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, prior: float, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, full batches with adaptive steps; both classes weigh the same."""
    bias = float(np.log(prior / (1 - prior)))
    weights = np.zeros(DIMENSIONS)
    if not rows:
        return Scorer(weights, bias)
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at = np.concatenate([np.asarray(a, np.int64) for a, _ in rows])
    values = np.concatenate([np.asarray(v, float) for _, v in rows])
    weigh = labels / max(labels.sum(), 1e-9) + (1 - labels) / max((1 - labels).sum(), 1e-9)
    weigh /= weigh.sum()
    seen, seen_bias = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, values * weights[at], len(rows)) + bias
        error = weigh * (1 / (1 + np.exp(-z)) - labels)
        slope = np.bincount(at, values * error[owner], DIMENSIONS) + decay * weights
        seen, seen_bias = seen + slope**2, seen_bias + error.sum() ** 2
        weights -= rate * slope / np.sqrt(seen)
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return Scorer(weights, float(bias))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> tuple[LabelModel, Scorer]:
    """The label model of all documents and a scorer fitted on at most `sample` of them."""
    small_batches(docs.sparkSession)
    total = docs.count()
    below = min(1 << 60, int((1 << 60) * sample / max(1, total)) + 1)
    key = hash60(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(key.alias("key"), whole_text(text_col).alias("text"))

    def read_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text in zip(frame["key"], frame["text"], strict=True):
                reading = read_text(text)
                at, values = features(reading) if k < below and reading.words else (None, None)
                out.append((k, votes(reading), at, values))
            yield pd.DataFrame(out, columns=["key", "votes", "at", "values"])

    seen = persisted(rows.mapInPandas(read_all, "key long, votes string, at array<int>, values array<double>"))
    labels = fit_labels({r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()})
    chosen = seen.filter(F.col("at").isNotNull()).orderBy("key", "votes").limit(sample).collect()
    known = {p: g for p in {r["votes"] for r in chosen} for g in labels.posterior([p])}
    scorer = fit_scorer([(r["at"], r["values"]) for r in chosen], np.array([known[r["votes"]] for r in chosen]), labels.prior)
    return labels, scorer


def _scores(spark, scorer: Scorer):
    sent = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.score)

    return score


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """One row per document: its id, score and whether it is kept."""
    score = _scores(docs.sparkSession, fit(docs, id_col, text_col, **options)[1])
    return docs.select(F.col(id_col), score(whole_text(text_col)).alias("score")).select(id_col, "score", (F.col("score") >= least).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """The documents that are not rejected, with their columns as they were."""
    score = _scores(docs.sparkSession, fit(docs, id_col, text_col, **options)[1])
    return docs.filter(score(whole_text(text_col)) >= least)
