"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Valid matches of four base patterns (email, ip, card, phone) are the seeds. The words around a seed form
lexical patterns, which back off from each other: the two words before it, the one word before it, that word
with the token's shape, the word after it, and that word with the shape (a shape has one letter for a run of
letters and one 0 for a run of digits). Every token with a digit or an at sign in the same surroundings is an
instance of that pattern. Scores go back and forth over this graph of patterns and instances for a few rounds:
a pattern is trusted for the share of its occurrences that hold trusted instances, an instance for the
patterns that it occurs with. Patterns of high confidence and enough different seeds then discover
identifiers that no base pattern matches; their kinds are named ctx_email and so on.

Edges are summed by pattern and token before any join, and the joined sides are written first, so that
adaptive execution can split a frequent pattern or token over tasks.

Defined results: null text is empty; a text of any length is read whole; base spans of a kind are
leftmost and do not overlap, spans of different kinds may; repeated rows and ids are documents of their
own; an empty table gives an empty result; with no seeds nothing is discovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import persisted, whole_text
from heddle.llm.spans import beside, counted, listed, located, ranked, uncovered

LOCAL = "A-Za-z0-9._%+-"
#: Matching may go on within a run of characters only where the last match ended.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
VALID_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}"
#: Maximal runs of 12 to 19 digits: longer and shorter ones would be dropped as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Tokens that may be identifiers, and the words before them.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Numbers written in parts with spaces between, which are one candidate.
PARTS = r"(?<![^\x20\x09-\x0D])[+(]{0,2}+[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+(?![^\x20\x09-\x0D,;:!?\"']))++"
#: Characters that a token needs to be a candidate.
SHORTEST = 5
WHITE = r"\x20\x09-\x0D"
#: In reversed text from a token backward, the two words before it; in text from a token's end, the word after it.
BEFORE = rf"^[{WHITE}]*+([^{WHITE}]++)(?:[{WHITE}]++([^{WHITE}]++))?"
AFTER = rf"^[^{WHITE}]*+[{WHITE}]++([^{WHITE}]++)"
#: Texts are cut into pieces of so many characters; a piece and its neighbour have the words around a token, unless they are longer.
PIECE = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    number = digits(value)
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {
        "email": located(text, EMAIL, text.contains("@")),
        "ip": F.filter(located(text, IP, digit & text.rlike(r"[0-9]\.[0-9]")), lambda s: s["value"].rlike(VALID_IP)),
        "card": F.filter(located(text, CARD, digit), lambda s: luhn(s["value"])),
        "phone": F.filter(located(text, PHONE, text.contains("+")), lambda s: F.length(digits(s["value"])).between(9, 15)),
    }


def shape(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}++", "a"), "[0-9]++", "0")


def patterns(token: Column, before: Column, earlier: Column, after: Column) -> Column:
    """The patterns of a token after the words `earlier` and `before` and ahead of `after`; empty words make none."""
    made = {"two before": (F.concat_ws(" ", earlier, before), (before != "") & (earlier != "")), "before": (before, before != ""), "before and shape": (F.concat_ws(" ", before, shape(token)), before != ""), "after": (after, after != ""), "shape and after": (F.concat_ws(" ", shape(token), after), after != "")}
    each = [F.when(given, F.concat(F.lit(f"{name}: "), words)) for name, (words, given) in made.items()]
    return F.filter(F.array(*each), lambda p: p.isNotNull())


def witnesses(pattern: Column, seeds: int) -> Column:
    """The number of different seeds that a pattern needs: the more it has backed off, the more."""
    return F.when(pattern.startswith("two before"), F.lit(seeds)).when(pattern.startswith("before and shape") | pattern.startswith("shape and after"), F.lit(3 * seeds)).otherwise(F.lit(6 * seeds))


def occurrences(rows: DataFrame) -> DataFrame:
    """(key, start, end, token, pattern, seed) of each token of `rows` (key, tokens) and each of its patterns."""
    each = rows.select("key", F.inline("tokens"))
    words = [F.lower(F.regexp_replace(w, "[0-9]", "0")) for w in ("before", "earlier", "after")]
    return each.select("key", "start", "end", F.col("value").alias("token"), F.explode(patterns(F.col("value"), *words)).alias("pattern"), "seed")


def trusted_patterns(found: DataFrame, rounds: int, seeds: int, least: float) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that end with confidence of `least` or more and `seeds` different seeds, or more where they have backed off."""
    edges = persisted(found.groupBy("pattern", "token").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("seed")))
    several = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("total"), F.count("seed").alias("seeded")).filter("tokens > 1 AND seeded > 0")
    edges = persisted(edges.join(persisted(several.select("pattern", "total")), "pattern"))
    start = edges.filter("seed IS NOT NULL").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("trust")).distinct()
    trust, scored = persisted(start), None
    enough = F.col("seeds") >= witnesses(F.col("pattern"), seeds)
    for _ in range(rounds):
        # Smoothed towards no trust, so that rare patterns need more than one witness.
        scored = edges.join(trust, "token").groupBy("pattern", "kind").agg((F.sum(F.col("n") * F.col("trust")) / (F.first("total") + 0.5)).alias("confidence"), F.countDistinct(F.when(F.col("seed") == F.col("kind"), F.col("token"))).alias("seeds"))
        scored = persisted(scored)
        strong = scored.filter((F.col("confidence") >= least / 2) & enough)
        spread = edges.join(strong, "pattern").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))).alias("trust"))
        trust = persisted(start.unionByName(spread).groupBy("token", "kind").agg(F.max("trust").alias("trust")))
    best = Window.partitionBy("pattern").orderBy(F.desc("confidence"), "kind")
    sure = scored.filter((F.col("confidence") >= least) & enough)
    return sure.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("pattern", "kind", "confidence")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, seeds: int = 3, least: float = 0.8) -> DataFrame:
    """One row per document: its id, `base` and `added` spans (start, rank, kind, end)."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    base = base_spans(text)
    rows = rows.select("id", "text", *[spans.alias(kind) for kind, spans in base.items()])
    rows = rows.withColumn("pieces", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0))
    parts = located(text, PARTS, text.rlike(r"[0-9][0-9().-]*+\x20\(?[0-9]"))
    rows = rows.withColumn("parts", uncovered(parts, *map(F.col, KINDS))).withColumn("single", located(text, TOKEN, text.rlike("[0-9@]")))
    rows = rows.withColumn("tokens", joined_tokens(F.col("parts"), F.col("single"))).withColumn("tokens", F.filter(F.transform("tokens", bare), lambda t: t["value"] != ""))
    for kind in KINDS:
        rows = rows.withColumn(f"{kind}_by", beside(F.col("tokens"), F.col(kind)))
    marked = F.arrays_zip(F.col("tokens").alias("token"), *[F.col(f"{kind}_by") for kind in KINDS])
    rows = rows.withColumn("tokens", F.filter(F.transform(marked, candidate), lambda t: t["start"].isNotNull()))
    tokens = F.transform("tokens", lambda t: with_words(t, F.col("pieces"), text))
    all_base = F.concat(*[ranked(F.col(kind), kind, i) for i, kind in enumerate(KINDS)])
    # The key marks rows; it is fixed by being written.
    rows = persisted(rows.select(F.monotonically_increasing_id().alias("key"), "id", all_base.alias("base"), tokens.alias("tokens")))
    found = occurrences(rows.filter(F.size("tokens") > 0))
    sure = persisted(trusted_patterns(found, rounds, seeds, least))
    new = found.filter("seed IS NULL").join(sure, "pattern")
    # Of the kinds that a token's patterns name, the most confident one.
    new = new.groupBy("key", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("key", "start", "end", "best.kind")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") + len(KINDS) - 1
    added = new.groupBy("key").agg(F.collect_set(F.struct(F.col("start"), rank.alias("rank"), F.concat(F.lit("ctx_"), F.col("kind")).alias("kind"), F.col("end"))).alias("added"))
    joined = rows.select("key", "id", "base").join(added, "key", "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("added"))


def joined_tokens(parts: Column, single: Column) -> Column:
    """Numbers in parts, and the tokens that don't begin one, in order."""
    alone = F.filter(F.arrays_zip(single.alias("token"), beside(single, parts).alias("by")), lambda x: x["by"]["begun"].isNull() | (x["by"]["begun"]["start"] != x["token"]["start"]))
    return F.array_sort(F.concat(parts, F.transform(alone, lambda x: x["token"])))


def bare(token: Column) -> Column:
    """A token without the marks around it."""
    start = token["start"] + F.length(F.regexp_extract(token["value"], r"^[^A-Za-z0-9@+(]*+", 0))
    core = F.regexp_replace(token["value"], r"^[^A-Za-z0-9@+(]*+|[^A-Za-z0-9)]++$", "")
    return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"))


def candidate(x: Column) -> Column:
    """(start, end, value, from, seed) of a token; start is null where it is none.

    A token that begins a base span is a seed of its kind and stands for the whole span, which may go on
    over later tokens; those within one are left out. Other tokens need `SHORTEST` characters.
    """
    token, begun = x["token"], F.lit(None).cast("struct<start:int,end:int,value:string,kind:string>")
    covered = F.lit(False)
    for kind in reversed(KINDS):
        own = x[f"{kind}_by"]["begun"]
        begun = F.when(own.isNotNull(), F.struct(own["start"].alias("start"), own["end"].alias("end"), own["value"].alias("value"), F.lit(kind).alias("kind"))).otherwise(begun)
        covered = covered | x[f"{kind}_by"]["covered"]
    stands = begun.isNotNull() | (~covered & (F.length(token["value"]) >= SHORTEST))
    of = lambda name: F.coalesce(begun[name], token[name]).alias(name)
    return F.struct(F.when(stands, F.coalesce(begun["start"], token["start"])).alias("start"), of("end"), of("value"), token["start"].alias("from"), begun["kind"].alias("seed"))


def word_after(pieces: Column, text: Column, end: Column) -> Column:
    """The word after the token that `end` lies in or ends, "" where there is none."""
    piece = F.floor(end / PIECE).cast("int")
    near = F.substring(F.concat(F.coalesce(F.get(pieces, piece), F.lit("")), F.coalesce(F.get(pieces, piece + 1), F.lit(""))), end - piece * PIECE + 1, F.lit(2 * PIECE))
    found = F.regexp_extract(near, AFTER, 0)
    whole = F.when((F.size(pieces) > piece + 2) & ((found == "") | (F.length(found) == F.length(near))), F.substring(text, end + 1, F.length(text) - end)).otherwise(near)
    return F.regexp_extract(whole, AFTER, 1)


def words_before(pieces: Column, text: Column, start: Column) -> Column:
    """(before, earlier): the word before a token and the one before that, "" where there is none."""
    piece = F.floor(start / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, piece - 1), F.lit("")), F.coalesce(F.get(pieces, piece), F.lit("")))
    near = F.reverse(F.substring(both, F.lit(1), start - F.greatest(F.lit(0), piece - 1) * PIECE))
    found = F.regexp_extract(near, BEFORE, 0)
    whole = F.when((piece > 1) & ((F.length(found) == F.length(near)) | (F.regexp_extract(near, BEFORE, 2) == "")), F.reverse(F.substring(text, F.lit(1), start))).otherwise(near)
    return F.struct(F.reverse(F.regexp_extract(whole, BEFORE, 1)).alias("before"), F.reverse(F.regexp_extract(whole, BEFORE, 2)).alias("earlier"))


def with_words(t: Column, pieces: Column, text: Column) -> Column:
    """A candidate with the two words before its token and the one after it."""
    words = words_before(pieces, text, t["from"])
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), words["before"].alias("before"), words["earlier"].alias("earlier"), word_after(pieces, text, t["end"]).alias("after"), t["seed"].alias("seed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, the count of each base kind, the digest of base spans, and all spans as text."""
    found = scan(docs, id_col, text_col, **options)
    counts = [counted(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
