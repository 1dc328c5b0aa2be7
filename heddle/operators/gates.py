"""Gates before reports: configurations taken apart into fields, and compared field by field.

A configuration becomes rows (case, path, value), whatever fields it has, and each rule compares the values of
some paths with those of one reference case. The reference's values are a row per path of a rule, so that they
go to every task; cases never meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fingerprints import PROTOCOL, THRESHOLD
from heddle.operators.reports import LAYER_CASES, METHODS

#: The fields that the runs of a layer study share.
LAYER_FIELDS = ("experiment.seed", "data.image_size", "data.calibration_fraction", "model.checkpoint", "model.token_norm", "memory.sampling", "memory.ratio", "retrieval.spatial_mode", "retrieval.lambda_max")
#: How diagnostics are taken, and how many categories each stage has.
HELD_OUT, STAGE_SIZES = "held_out_from_threshold_fit", (5, 10)
BASE_FIELDS = tuple(f"{part}.{name}" for part, fields in PROTOCOL.items() for name in fields)
THRESHOLD_FIELDS = tuple(f"calibration.{name}" for name in THRESHOLD)
ROWS = "array<struct<category:string,normal_diagnostic_mode:string,normal_validation_images:int>>"


def config_values(cases: DataFrame, keys: list[str], config_col: str = "config_json") -> DataFrame:
    """(keys, path, value): a row for each field of a section of each configuration; numbers alike however they are written."""
    spark = cases.sparkSession
    sections = cases.select(*keys, F.parse_json(config_col).alias("config"))
    sections = sections.lateralJoin(spark.tvf.variant_explode(F.col("config").outer())).select(*keys, F.col("key").alias("section"), F.col("value").alias("inner"))
    fields = sections.lateralJoin(spark.tvf.variant_explode(F.col("inner").outer())).filter("key IS NOT NULL")
    number = F.schema_of_variant("value").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    text = F.when(number, F.try_variant_get("value", "$", "double").cast("string")).otherwise(F.to_json("value"))
    return fields.select(*keys, F.concat_ws(".", "section", "key").alias("path"), text.alias("value"))


def spread(values: DataFrame) -> DataFrame:
    """(path, different, cases): how many values a path has over all cases; null where a case lacks it isn't counted."""
    return values.groupBy("path").agg(F.countDistinct("value").alias("different"), F.count(F.lit(1)).alias("cases"))


def differing(cases: DataFrame, keys: list[str], reference: DataFrame, paths: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path): the fields of `paths` in which a case differs from the reference case, also by lacking them.

    `cases` and `reference` have config_json; `within` names columns whose values have a reference case each, fewer than methods.
    """
    wanted = F.explode(F.array(*map(F.lit, paths))).alias("path")
    own = config_values(cases, keys).filter(F.col("path").isin(*paths))
    # A row per path (and value of `within`).
    other = config_values(reference, list(within)).filter(F.col("path").isin(*paths)).withColumnRenamed("value", "other")
    every = cases.select(*keys, *within, wanted).join(F.broadcast(other), [*within, "path"], "left")
    return every.join(own, [*keys, "path"], "left").filter(~F.col("value").eqNullSafe(F.col("other"))).select(*keys, "path")


def first_case(cases: DataFrame, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """The first case in order, or the first for each value of `within`."""
    by = F.min_by(F.struct(*[F.col(c) for c in cases.columns if c not in within]), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("first")
    return (cases.groupBy(*within) if within else cases.groupBy()).agg(by).select(*within, "first.*")


def listed_rows(cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, listed): the rows of categories of the metrics."""
    return cases.select(*keys, F.from_json("metrics_json", f"struct<categories:{ROWS}>")["categories"].alias("listed"))


def threshold_faults(cases: DataFrame, keys: list[str], methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """(keys, rule, path): what breaks the protocol of a threshold study, from (keys, method, threshold_split_seed, config_json, metrics_json).

    The first case of the first method is the reference for the model seed, the protocol and the order of
    categories over all methods; each method's first case is for its threshold parameters. Faults of a whole
    method (unknown, missing, or without a split seed that others have) have null keys and name it in `path`.
    """
    position = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    known = cases.filter(position > 0)
    order = [position, F.col("threshold_split_seed"), *map(F.col, keys)]
    first, own_first = first_case(known, order), first_case(known.select("method", "threshold_split_seed", *[c for c in keys if c != "method"], "config_json"), [F.col("threshold_split_seed"), *[F.col(k) for k in keys if k != "method"]], ("method",))
    stage = '"development"' if len(methods) > 1 else '"validation"'
    named = lambda df, rule: df.select(*keys, F.lit(rule).alias("rule"), "path")
    wrong_stage = known.select(*keys, F.lit("experiment.protocol_stage").alias("path")).join(config_values(known, keys).filter(F.col("path") == "experiment.protocol_stage").drop("path"), keys, "left").filter(~F.col("value").eqNullSafe(F.lit(stage)))
    out = [
        named(wrong_stage, "stage"),
        named(differing(known, keys, first, ("experiment.seed",)), "model seed"),
        named(differing(known, keys, first, BASE_FIELDS), "base protocol"),
        named(differing(known, keys, own_first, THRESHOLD_FIELDS, ("method",)), "threshold parameters"),
    ]
    names = F.from_json("config_json", "struct<data:struct<categories:array<string>>>")["data"]["categories"]
    rows = listed_rows(known, keys).crossJoin(F.broadcast(first.select(names.alias("names"))))  # one row
    order_of = F.transform("listed", lambda r: r["category"])
    out.append(named(rows.filter(~order_of.eqNullSafe(F.col("names"))).withColumn("path", F.lit("categories")), "category order"))
    each = rows.select(*keys, F.inline("listed")).withColumn("path", F.col("category"))
    out.append(named(each.filter(~F.col("normal_diagnostic_mode").eqNullSafe(F.lit(HELD_OUT))), "not held out"))
    out.append(named(each.filter(F.coalesce("normal_validation_images", F.lit(0)) < 1), "no validation images"))
    whole = [F.lit(None).cast(cases.schema[k].dataType).alias(k) for k in keys]
    of_method = lambda df, rule: df.select(*whole, F.lit(rule).alias("rule"), F.col("method").alias("path"))
    found, expected = cases.select("method").distinct(), cases.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    out.append(of_method(found.exceptAll(expected), "unexpected method"))
    out.append(of_method(expected.exceptAll(found), "missing method"))
    pairs = known.select("method", "threshold_split_seed").distinct()
    # Two short lists of parameters.
    grid = pairs.select("method").distinct().crossJoin(pairs.select("threshold_split_seed").distinct())
    out.append(of_method(grid.exceptAll(pairs).select("method").distinct(), "missing split seeds"))
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def layer_faults(cases: DataFrame, keys: list[str], study: list[str], expected: tuple[str, ...] = tuple(LAYER_CASES)) -> DataFrame:
    """(study, case, rule, path): what breaks the protocol of layer studies, from (study and keys, case, config_json, metrics_json).

    A study's first case by `expected` is the reference; a missing case is named in `case`.
    """
    by = Window.partitionBy(*study)
    position = F.array_position(F.array(*map(F.lit, expected)), F.col("case"))
    # A study has a handful of cases: its first is found beside them.
    marked = cases.withColumn("place", F.min(F.when(position > 0, position)).over(by)).withColumn("first", position == F.col("place"))
    own = config_values(marked, [*study, "case"]).filter(F.col("path").isin(*LAYER_FIELDS))
    other = config_values(marked.filter("first"), study).filter(F.col("path").isin(*LAYER_FIELDS)).withColumnRenamed("value", "other")
    every = marked.select(*study, "case", F.explode(F.array(*map(F.lit, LAYER_FIELDS))).alias("path"))
    fields = every.join(own, [*study, "case", "path"], "left").join(other, [*study, "path"], "left").filter(~F.col("value").eqNullSafe(F.col("other"))).select(*study, "case", F.lit("protocol").alias("rule"), "path")
    listed = marked.select(*study, "case", "first", F.transform(F.from_json("metrics_json", f"struct<categories:{ROWS}>")["categories"], lambda r: r["category"]).alias("listed"))
    listed = listed.withColumn("other", F.max(F.when(F.col("first"), F.col("listed"))).over(by))
    order = listed.filter(~F.col("listed").eqNullSafe(F.col("other"))).select(*study, "case", F.lit("category order").alias("rule"), F.lit("categories").alias("path"))
    absent = cases.groupBy(*study).agg(F.collect_set("case").alias("there")).select(*study, F.explode(F.array_except(F.array(*map(F.lit, expected)), F.col("there"))).alias("case"), F.lit("missing case").alias("rule"), F.lit(None).cast("string").alias("path"))
    return fields.unionByName(order).unionByName(absent)


def stage_faults(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rules): which rules between the stages are broken, from (keys, dev_json, validation_json, selection_json, validation_selection_json),
    summaries of the stages and the selection that each of them had."""
    parsed = pairs.select(*keys, *[F.parse_json(f"{n}_json").alias(n) for n in ("dev", "validation", "selection", "validation_selection")])
    text = lambda v: F.to_json(v)
    get = lambda of, path: F.to_json(F.try_variant_get(of, f"$.{path}", "variant"))
    plain = lambda of, path: F.try_variant_get(of, f"$.{path}", "string")
    names = lambda of: F.array_distinct(F.try_variant_get(of, "$.categories", "array<string>"))
    method = plain("selection", "selected_method")
    chosen = lambda path: F.map_from_entries(F.transform(F.map_entries(F.from_json(get("validation", path), "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))[method]
    same = {
        "dev stage": plain("dev", "stage") == "development", "validation stage": plain("validation", "stage") == "validation", "selection kept": text("selection") == text("validation_selection"),
        "only the selected method": F.try_variant_get("validation", "$.methods", "array<string>") == F.array(method), "model seed": get("dev", "model_seed") == get("validation", "model_seed"),
        "split seeds": get("dev", "threshold_split_seeds") == get("validation", "threshold_split_seeds"), "base protocol": get("dev", "base_protocol_fingerprint") == get("validation", "base_protocol_fingerprint"),
        "selected protocol": plain("selection", "selected_protocol_fingerprint") == chosen("method_protocol_fingerprints"), "locked parameters": get("selection", "selected_parameters") == chosen("threshold_parameters"),
        "dev diagnostics": plain("dev", "normal_diagnostic_mode") == HELD_OUT, "validation diagnostics": plain("validation", "normal_diagnostic_mode") == HELD_OUT,
        "disjoint categories": ~F.arrays_overlap(names("dev"), names("validation")), "category counts": (F.size(names("dev")) == STAGE_SIZES[0]) & (F.size(names("validation")) == STAGE_SIZES[1]),
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in same.items()]), lambda r: r.isNotNull())
    return parsed.select(*keys, broken.alias("rules")).filter(F.size("rules") > 0)
