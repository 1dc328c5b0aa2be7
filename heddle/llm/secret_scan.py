"""Secrets in texts: base patterns, and a battery of randomness tests, with built-in functions only.

Besides the matches of three base patterns, long runs of code-like characters are tested. The encoding of
a run is inferred from its characters. A run is a discovery if

* the battery can tell: at the run's length, text in the corpus' own symbols would exceed the coincidences
  of a uniform source by `POWER` deviations. Where an alphabet's own symbols are near uniform already (the
  digits of card numbers) or the run is short, chance and text look alike, and nothing is discovered;
* it is unlike text: the probability that symbols drawn as the corpus' runs draw them would all lie in the
  run's alphabet and coincide as rarely as they do. Within each band of lengths, the Benjamini-Hochberg
  bound holds the expected share of false discoveries at `fdr`;
* it is like chance: chi-squared uniformity over the alphabet, a runs test around the alphabet's middle and
  the serial correlation of neighbours give three p-values under a uniform, independent source, combined by
  Fisher's method. Within each band of lengths, the Benjamini-Hochberg bound at `fdr` names the runs that
  are not like chance, which go.

Their kind is `random`. Defined results: null text is empty; a text of any length is read whole; runs
that overlap a base span are left out; repeated rows and ids are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import persisted, whole_text
from heddle.llm.spans import beside, counted, listed, located, ranked

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]{6,}+$"""
ACCESS = r"AKIA[A-Z0-9]++"
#: Runs of at least 24: shorter ones would be dropped as a whole.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")
#: A run may begin after an equals sign, as values of names and URL parameters do; padding belongs to the run before it.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+"
#: Alphabets in the order in which they are tried.
ALPHABETS = (
    ("decimal", "0123456789", "^[0-9]+$"),
    ("hex", "0123456789abcdef", "^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", "^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[A-Za-z0-9+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", ""),
)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Lower ends of the length bands.
BANDS = (16, 24, 32, 48, 80)
#: Bins of -log10(p): tenths, up to 300.
TENTHS = 3000
#: Deviations between text and chance that the uniformity test needs: a level of 0.05 with a power of 0.99.
POWER = 4.0


def base_spans(text: Column) -> dict[str, Column]:
    sign = text.contains("=") | text.contains(":")
    return {
        "assign": F.filter(located(text, ASSIGN, sign & text.rlike("(?i)passw|secret|token|api_?key")), lambda s: s["value"].rlike(ASSIGNED)),
        "access": F.filter(located(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["value"]) >= 20),
        "hex": located(text, HEX, text.rlike("[0-9a-f]{24}")),
    }


def normal_tail(z: Column) -> Column:
    """P(Z >= z) of the normal distribution."""
    # Fixed values of a published approximation (Abramowitz and Stegun, 26.2.17).
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _pick(attribute) -> Column:
    out = None
    for name, symbols, pattern in reversed(ALPHABETS):
        value = F.lit(attribute(name, symbols))
        out = value if out is None else F.when(F.col("run").rlike(pattern), value).otherwise(out)
    return out


def measured(runs: DataFrame) -> DataFrame:
    """`runs` (run) with its encoding, alphabet and its size k, length n and ordered pairs of equal symbols."""
    each = F.array_distinct(F.split("run", ""))
    n_of = lambda c: F.length("run").cast("long") - F.length(F.replace("run", c, F.lit("")))
    pairs = F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0).cast("long"), lambda total, c: total + n_of(c) * n_of(c))
    return runs.withColumn("n", F.length("run").cast("long")).withColumn("pairs", pairs - F.col("n")).withColumn("encoding", _pick(lambda name, _: name)).withColumn("k", _pick(lambda _, symbols: len(symbols))).withColumn("symbols", _pick(lambda _, symbols: symbols))


def text_likeness(runs: DataFrame) -> DataFrame:
    """Adds `tenths`, minus ten times the logarithm of the probability of the run under the corpus' own symbols,
    and `power`, the deviations by which such symbols would fail the uniformity test."""
    # A row per symbol, at most len(SYMBOLS) of them.
    counts = runs.groupBy(*[]).agg(*[F.sum(F.col("n") - F.length(F.replace("run", F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(SYMBOLS)]).first()
    seen = {c: (counts[i] or 0) + 1 for i, c in enumerate(SYMBOLS)}
    share = {c: v / sum(seen.values()) for c, v in seen.items()}

    def moments(symbols: str) -> tuple[float, float, float]:
        mass = sum(share[c] for c in symbols)
        return math.log10(mass), sum((share[c] / mass) ** 2 for c in symbols), sum((share[c] / mass) ** 3 for c in symbols)

    mass, s2, s3 = (_pick(lambda _, symbols, i=i: moments(symbols)[i]) for i in range(3))
    n = F.col("n")
    mean = n * (n - 1) * s2
    spread = F.sqrt(F.greatest(F.lit(1e-9), 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)))
    fewer = F.log10(F.greatest(F.lit(1e-300), normal_tail((mean - F.col("pairs")) / spread)))
    k = F.col("k")
    power = n * (n - 1) * (s2 - 1 / k) / F.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
    return runs.withColumn("tenths", _tenths(-(n * mass + fewer))).withColumn("power", power)


def _tenths(digits: Column) -> Column:
    """Tenths of -log10(p), from 0 to TENTHS."""
    return F.greatest(F.lit(0), F.floor(10 * F.least(F.lit(TENTHS / 10), digits)).cast("int"))


def band(n: Column) -> Column:
    return sum(((n >= low).cast("int") for low in BANDS), F.lit(0))


def significant(runs: DataFrame, fdr: float) -> DataFrame:
    """`runs` (n, tenths) with `significant`: whether the Benjamini-Hochberg bound of their length band rejects them."""
    runs = runs.withColumn("band", band(F.col("n")))
    # At most len(BANDS) * TENTHS rows.
    bins = runs.groupBy("band", "tenths").agg(F.count(F.lit(1)).alias("count"))
    whole, upper = Window.partitionBy("band"), Window.partitionBy("band").orderBy(F.desc("tenths")).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("ranks", F.sum("count").over(upper)).withColumn("all", F.sum("count").over(whole))
    # The largest p of a bin is 10 ** (-tenths / 10).
    bound = bins.filter(F.pow(F.lit(10.0), -F.col("tenths") / 10) <= fdr * F.col("ranks") / F.col("all")).groupBy("band").agg(F.min("tenths").alias("bound"))
    # One row per band.
    return runs.join(F.broadcast(bound), "band", "left").withColumn("significant", F.coalesce(F.col("tenths") >= F.col("bound"), F.lit(False))).drop("bound", "band")


def battery(runs: DataFrame) -> DataFrame:
    """Adds the p-values p_uniform, p_runs and p_serial of a uniform, independent source, and `p`, which combines them."""
    n, k = F.col("n"), F.col("k")
    most = (n - 1).cast("int")
    runs = runs.withColumn("x", F.transform(F.filter(F.split("run", ""), lambda c: c != ""), lambda c: F.instr(F.col("symbols"), c).cast("double") - 1))
    # Chi-squared = k / n * (pairs + n) - n, from the coincidences of a uniform source.
    chi_z = (F.col("pairs") - n * (n - 1) / k) / F.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
    high = F.transform("x", lambda v: (v >= k / 2).cast("int"))
    turns = lambda bits: F.aggregate(F.zip_with(F.slice(bits, 1, most), F.slice(bits, 2, most), lambda a, b: (a != b).cast("int")), F.lit(1), lambda t, v: t + v)
    ones = F.aggregate(high, F.lit(0), lambda t, v: t + v)
    runs = runs.withColumn("ones", ones).withColumn("turns", turns(high))
    expected = 2 * F.col("ones") * (n - F.col("ones")) / n + 1
    spread = F.sqrt(F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1)))
    # Sums of whole numbers, from which the mean is taken afterwards: within the lambdas it would be computed for every symbol.
    total = F.aggregate("x", F.lit(0.0), lambda t, v: t + v)
    squares = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v) - total * total / n
    neighbours = F.aggregate(F.zip_with(F.slice("x", 1, most), F.slice("x", 2, most), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    products = neighbours - total / n * (2 * total - F.element_at("x", 1) - F.element_at("x", -1)) + (n - 1) * (total / n) * (total / n)
    serial = (products / F.greatest(squares, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    tests = {"p_uniform": normal_tail(chi_z), "p_runs": 2 * normal_tail(F.abs((F.col("turns") - expected) / spread)), "p_serial": 2 * normal_tail(F.abs(serial))}
    runs = runs.withColumns({name: F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p)) for name, p in tests.items()})
    # Fisher: twice the sum of -log(p) is chi-squared with six degrees of freedom, whose tail is closed.
    h = -(F.log("p_uniform") + F.log("p_runs") + F.log("p_serial"))
    return runs.withColumn("p", F.exp(-h) * (1 + h + h * h / 2))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """One row per document: its id, `base` and `added` spans (start, rank, kind, end)."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    base = base_spans(text)
    rows = rows.select("id", *[spans.alias(kind) for kind, spans in base.items()], located(text, RUN, text.rlike("[A-Za-z0-9+/_-]{16}")).alias("runs"))
    for kind in KINDS:
        rows = rows.withColumn(f"{kind}_by", F.transform(beside(F.col("runs"), F.col(kind)), lambda x: x["covered"]))
    known = lambda x: x["assign_by"] | x["access_by"] | x["hex_by"]
    marked = F.transform(F.arrays_zip("runs", *[f"{kind}_by" for kind in KINDS]), lambda x: F.struct(x["runs"]["start"].alias("start"), x["runs"]["end"].alias("end"), x["runs"]["value"].alias("value"), known(x).alias("known")))
    rows = rows.withColumn("runs", marked)
    all_base = F.concat(*[ranked(F.col(kind), kind, i) for i, kind in enumerate(KINDS)])
    # The key marks rows; it is fixed by being written.
    rows = persisted(rows.select(F.monotonically_increasing_id().alias("key"), "id", all_base.alias("base"), "runs"))
    runs = rows.select("key", F.inline("runs")).select("key", "known", "start", "end", F.regexp_replace("value", "=+$", "").alias("run"))
    tested = text_likeness(measured(runs))
    # Written, so that the battery reads columns: pushed down with its filter, it would test every run, and find the alphabet anew for each symbol.
    unlike_text = persisted(significant(tested.filter(F.col("power") >= POWER), fdr).filter("significant").drop("tenths", "significant"))
    tried = persisted(battery(unlike_text).select("key", "known", "start", "end", "n", _tenths(-F.log10(F.greatest(F.lit(1e-300), F.col("p")))).alias("tenths")))
    sure = significant(tried, fdr).filter("NOT significant")
    new = sure.filter(~F.col("known"))
    added = new.groupBy("key").agg(F.collect_set(F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.lit("random").alias("kind"), F.col("end"))).alias("added"))
    joined = rows.select("key", "id", "base").join(added, "key", "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("added"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, the count of each base kind, the digest of base spans, and all spans as text."""
    found = scan(docs, id_col, text_col, **options)
    counts = [counted(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
