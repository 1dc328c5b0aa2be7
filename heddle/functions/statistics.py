"""Statistics with the semantics that the anomaly jobs need.

Medians are the lower of two middle values, quantiles interpolate linearly, counts round half to even,
and means skip NaN. Order statistics of groups of any size are exact: a sketch brackets the value, the rows
below the bracket are only counted, and those inside are the only ones that move. Running sums are taken
within ranges of values, so that no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.storage import stored

#: A sketch is off by at most a part of `ACCURACY` of a group's rows; a bracket reaches `SLACK` such parts to either side.
ACCURACY, SLACK = 2000, 1.25
#: Values of a group that a window orders at once; of more, running sums are taken within ranges.
ORDERED = 1_000_000


def lower_median(column: str) -> Column:
    return F.expr(f"percentile_disc(0.5D) WITHIN GROUP (ORDER BY `{column}`)")


def linear_quantile(column: str, q: float) -> Column:
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    return F.percentile(column, F.lit(q))


def rounded_count(n: Column, fraction: float) -> Column:
    return F.bround(n * F.lit(float(fraction)), 0).cast("long")


def nan_mean(column: str) -> Column:
    """The mean without NaN; NaN if nothing else is there."""
    return F.coalesce(F.avg(F.when(~F.isnan(column), F.col(column))), F.lit(float("nan")))


def describe(column: str, parts: tuple[str, ...] = ("mean", "std", "min", "max", "range"), prefix: str | None = None) -> list[Column]:
    """Aggregates named after the column and the statistic; the deviation is that of a population."""
    made = {"mean": F.avg(column), "std": F.stddev_pop(column), "min": F.min(column), "max": F.max(column), "range": F.max(column) - F.min(column)}
    return [made[part].alias(f"{prefix or column}_{part}") for part in parts]


def running_sums(counts: DataFrame, keys: list[str], order: str, columns: list[str], descending: bool = False, parts: int = 32, rows: DataFrame | None = None) -> DataFrame:
    """`counts` with running_<column>: the sums of each column up to a row's own in the order within `keys`.

    Approximate quantiles bound `parts` ranges of a group; sums run within a range, and those of the ranges
    before are added. Where the bounds lie doesn't change the sums. Bounds and sums of ranges, a row per group
    or range, come from `rows`, which add up to `counts`, so that `counts` itself is moved by range only.
    """
    rows = counts if rows is None else rows
    grid = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = stored(rows.groupBy(*keys).agg(F.percentile_approx(order, grid, 1000).alias("bounds")))
    nth = F.size(F.filter("bounds", lambda b: (b > F.col(order)) if descending else (b < F.col(order))))
    ranged = lambda df: df.join(bounds, keys).withColumn("part", nth).drop("bounds")
    totals = ranged(rows).groupBy(*keys, "part").agg(*[F.sum(c).alias(f"part_{c}") for c in columns])
    # A row per group and part.
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(totals.select(*keys, "part", *[F.coalesce(F.sum(f"part_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in columns]))
    within = Window.partitionBy(*keys, "part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged(counts).select("*", *[F.sum(c).over(within).alias(f"within_{c}") for c in columns]).join(totals, [*keys, "part"])
    return summed.select(*counts.columns, *[(F.col(f"within_{c}") + F.col(f"before_{c}")).alias(f"running_{c}") for c in columns])


def bracketed(rows: DataFrame, keys: list[str], qs: list[float], slack: float) -> DataFrame:
    """(keys, exact, n, value, total): a histogram of the values (`exact`) within `slack` of one of the fractions `qs` of a group;
    rows between two brackets are one bin with `exact` null and their greatest value."""
    ends = [(max(0.0, q - slack), min(1.0, q + slack)) for q in qs]
    sketch = F.percentile_approx("value", F.array(*[F.lit(x) for pair in ends for x in pair]), ACCURACY)
    # A row per group, of a size that Spark sees when it plans the join.
    bounds = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), sketch.alias("ends")))
    inside, gap = F.lit(False), F.lit(0)
    for i, (low, high) in enumerate(ends):
        above = F.lit(True) if low == 0 else F.col("value") >= F.col("ends")[2 * i]
        beyond = F.lit(False) if high == 1 else F.col("value") > F.col("ends")[2 * i + 1]
        inside, gap = inside | (above & ~beyond), gap + beyond.cast("int")
    marked = rows.join(bounds, keys).select(*keys, "value", F.when(inside, F.col("value")).alias("exact"), F.when(~inside, gap).alias("gap"))
    counts = marked.groupBy(*keys, "exact", "gap").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("exact").isNull(), F.col("value"))).alias("value"))
    return stored(counts.join(bounds, keys).select(*keys, "exact", "n", F.coalesce("exact", "value").alias("value"), "total"))


def values_at(df: DataFrame, keys: list[str], column: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """(keys, a column for each of `ranks`, total): the values at ranks from 0, given as about which fraction of a group lies before
    them, and as expressions of the group's count `total`.

    A group whose bracket misses a rank, which a sketch within its error can't cause, gets a wider one.
    """
    todo = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("value"))
    slack, made = SLACK / ACCURACY, None
    while True:
        counts = bracketed(todo, keys, sorted({q for q, _ in ranks.values()}), slack)
        largest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if largest > ORDERED:
            rows = running_sums(counts, keys, "value", ["n"])
        else:
            rows = counts.withColumn("running_n", F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda rank: (F.col("running_n") > rank) & (F.col("running_n") - F.col("n") <= rank)
        found = stored(rows.groupBy(*keys).agg(*[F.max(F.when(at(rank), F.col("exact"))).alias(name) for name, (_, rank) in ranks.items()], F.first("total").alias("total")))
        whole = F.lit(True)
        for name in ranks:
            whole &= F.col(name).isNotNull()
        sure, missed = found.filter(whole), found.filter(~whole).select(*keys)
        made = sure if made is None else made.unionByName(sure)
        if missed.isEmpty():
            return made
        todo, slack = todo.join(missed, keys, "left_semi"), 10 * slack


def exact_median(df: DataFrame, keys: list[str], column: str, name: str = "median") -> DataFrame:
    """(keys, median): lower medians of groups of any size."""
    return values_at(df, keys, column, {name: (0.5, F.floor((F.col("total") - 1) / 2))}).drop("total")


def exact_quantiles(df: DataFrame, keys: list[str], column: str, qs: dict[str, float]) -> DataFrame:
    """(keys, a column for each of `qs`): linear quantiles of groups of any size, all from the same passes."""
    if not all(0 <= q <= 1 for q in qs.values()):
        raise ValueError("a quantile lies between 0 and 1")
    rank = {name: F.lit(float(q)) * (F.col("total") - 1) for name, q in qs.items()}
    ranks = {f"{name}_first": (q, F.floor(rank[name])) for name, q in qs.items()} | {f"{name}_second": (q, F.least(F.floor(rank[name]) + 1, F.col("total") - 1)) for name, q in qs.items()}
    found = values_at(df, keys, column, ranks)
    between = lambda name: F.col(f"{name}_first") + (F.col(f"{name}_second") - F.col(f"{name}_first")) * (rank[name] - F.floor(rank[name]))
    return found.select(*keys, *[between(name).alias(name) for name in qs])


def exact_quantile(df: DataFrame, keys: list[str], column: str, q: float) -> DataFrame:
    """(keys, quantile): linear quantiles of groups of any size."""
    return exact_quantiles(df, keys, column, {"quantile": q})
