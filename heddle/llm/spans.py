"""Spans of pattern matches in texts, with built-in functions only.

A text split by a pattern and the matches themselves give every match's place: both are cut from left to
right, so lengths add up to positions (in code points). Patterns must not match the empty string. They
are written with possessive repeats and look-behinds so that matching takes linear time on any text.

Running sums within an array take as many passes over it as its size has binary digits, each adding the sums of
the neighbours twice as far away; so a text with n matches costs n log n, not the square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column) -> Column:
    """The running sums of an array of ints."""

    def doubled(array: Column) -> Column:
        n = F.size(array)
        # 0 to 30; a shift beyond the size leaves the sums as they are.
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")))
        shifts = F.filter(F.transform(steps, lambda i: F.pow(F.lit(2.0), i).cast("int")), lambda k: k < n)
        return F.aggregate(shifts, array, lambda sums, k: F.zip_with(sums, F.concat(F.array_repeat(F.lit(0), k), F.slice(sums, F.lit(1), n - k)), lambda x, y: x + y))

    return let(numbers.cast("array<int>"), doubled)


def located(text: Column, pattern: str, gate: Column) -> Column:
    """The matches of `pattern` as an array of SPAN; empty where `gate` is false, without any matching."""

    def placed(cut: Column) -> Column:
        hits = cut["hits"]
        lengths = F.zip_with(F.slice(cut["gaps"], F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(running(lengths), hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value")))

    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    return F.when(gate, let(cut, placed).cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def ranks(points: Column, starts: Column) -> Column:
    """For each of `points`, which are in order, how many of `starts` are less."""
    mark = lambda tag: lambda p: F.struct(p.alias("at"), F.lit(tag).alias("tag"))
    merged = F.array_sort(F.concat(F.transform(points, mark(0)), F.transform(starts, mark(1))))
    counts = let(merged, lambda m: F.zip_with(m, running(F.transform(m, lambda x: x["tag"])), lambda x, n: F.struct(x["tag"].alias("tag"), n.alias("n"))))
    return F.transform(F.filter(counts, lambda x: x["tag"] == 0), lambda x: x["n"])


def beside(items: Column, spans: Column) -> Column:
    """For each of `items` (start, end, ...), `begun`, the first of `spans` that begins within it, and `covered`, whether any shares a
    character with it. Items, and spans, are in order and disjoint."""

    def each(both: Column) -> Column:
        items, spans = both["items"], both["spans"]

        def one(x: Column, n: Column) -> Column:
            begun = F.when(F.get(spans, n)["start"] < x["end"], F.get(spans, n))
            return F.struct(begun.alias("begun"), (begun.isNotNull() | F.coalesce(F.get(spans, n - 1)["end"] > x["start"], F.lit(False))).alias("covered"))

        return F.zip_with(items, ranks(F.transform(items, lambda x: x["start"]), F.transform(spans, lambda s: s["start"])), one)

    return let(F.struct(items.alias("items"), spans.alias("spans")), each)


def uncovered(items: Column, *spans: Column) -> Column:
    """The items that share no character with any of several lists of spans."""
    kept = items
    for own in spans:
        kept = let(F.struct(kept.alias("items"), own.alias("spans")), lambda b: F.transform(F.filter(F.arrays_zip(b["items"].alias("item"), beside(b["items"], b["spans"]).alias("by")), lambda x: ~x["by"]["covered"]), lambda x: x["item"]))
    return kept


def listed(spans: Column) -> Column:
    """Spans with (start, rank, kind, end) as the text kind:start:end by start and rank, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ranked(spans: Column, kind: str, rank: int) -> Column:
    """Spans as structs that sort by start, then by the rank of their kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

