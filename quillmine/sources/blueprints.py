"""Blueprints of an architecture (layers, rules, modules), parsed from JSON or YAML texts into tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "version double, layers array<struct<name: string, allow: array<string>>>, rules array<struct<source: string, target: string, mode: string>>, modules array<struct<name: string, layer: string, paths: array<string>>>"
KNOWN = ("version", "layers", "rules", "modules")
MODES = ("allow", "forbid")


@dataclass
class Blueprints:
    """Tables keyed by id: layers (id, name, allow), rules (id, source, target, mode), modules (id, name, layer, paths), metadata (id, key, value), problems (id, code, detail).

    An id with a problem is in no other table.
    """

    layers: DataFrame
    rules: DataFrame
    modules: DataFrame
    metadata: DataFrame
    problems: DataFrame


def yaml_as_json(texts: DataFrame) -> DataFrame:
    """(id, text) with YAML texts as JSON ones; what can't be read stays as it is. Needs the yaml library on the executors."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def read(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(yaml.safe_load(text), default=str)
            except yaml.YAMLError:
                return text

        for batch in batches:
            yield batch.assign(text=[read(t) for t in batch["text"]])

    return texts.select("id", "text").mapInPandas(work, texts.select("id", "text").schema)


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _blank(c: Column) -> Column:
    return F.coalesce(_clean(c), F.lit("")) == ""


def parse_blueprints(texts: DataFrame) -> Blueprints:
    """The blueprints of texts (id, text: JSON objects).

    Needed: a whole version above 0, layers and rules. Names are unique and not blank; layers that are allowed, and
    those of rules and modules, must be layers of the blueprint; a path belongs to one module. Names, allowed
    layers and paths come trimmed, once and in order. Other keys are metadata and must be scalars.
    """
    rows = texts.select("id", F.try_parse_json("text").alias("v"), "text")
    root = F.schema_of_variant("v").startswith("OBJECT")
    rows = rows.withColumn("ok", F.col("v").isNotNull() & F.coalesce(root, F.lit(False)))
    b = F.from_json(F.when(F.col("ok"), F.col("text")), SHAPE)
    rows = rows.withColumn("b", b)
    tidy = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), _clean)))
    path = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.replace(_clean(p), F.lit("\\"), F.lit("/")))))
    layers = rows.select("id", F.explode("b.layers").alias("l")).select("id", _clean(F.col("l.name")).alias("name"), tidy(F.col("l.allow")).alias("allow"))
    rules = rows.select("id", F.explode("b.rules").alias("r")).select("id", *[_clean(F.col(f"r.{c}")).alias(c) for c in ("source", "target", "mode")])
    modules = rows.select("id", F.explode("b.modules").alias("m")).select("id", _clean(F.col("m.name")).alias("name"), _clean(F.col("m.layer")).alias("layer"), path(F.col("m.paths")).alias("paths"))
    keys = rows.where("ok").select("id", F.explode(F.from_json("text", "map<string, string>")).alias("key", "value"), "v").where(~F.col("key").isin(*KNOWN))
    metadata = keys.select("id", "key", "value")

    def problem(df: DataFrame, code: str, detail: Column) -> DataFrame:
        return df.select("id", F.lit(code).alias("code"), detail.cast("string").alias("detail"))

    def unknown(df: DataFrame, code: str, name: str) -> DataFrame:
        given = df.where(~_blank(F.col(name))).select("id", F.col(name).alias("name"))
        return problem(given.join(layers.select("id", "name"), ["id", "name"], "left_anti"), code, F.col("name"))

    def twice(df: DataFrame, code: str, *names: str) -> DataFrame:
        return problem(df.groupBy("id", *names).agg(F.count("*").alias("n")).where("n > 1"), code, F.concat_ws("|", *names))

    none = lambda c: F.coalesce(F.size(f"b.{c}"), F.lit(0)) < 1
    version = F.col("b.version")
    wrong_mode = ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    owners = modules.select("id", "name", F.explode("paths").alias("path"))
    found = [
        problem(rows.where(_blank(F.col("text"))), "EMPTY", F.lit("")),
        problem(rows.where("not ok").where(~_blank(F.col("text"))), "INVALID_ROOT", F.lit("")),
        problem(rows.where("ok").where(~F.coalesce((version > 0) & (version == F.floor(version)), F.lit(False))), "INVALID_VERSION", version),
        problem(rows.where("ok").where(none("layers")), "INVALID_LAYERS", F.lit("")),
        problem(rows.where("ok").where(none("rules")), "INVALID_RULES", F.lit("")),
        problem(layers.where(_blank(F.col("name"))), "INVALID_LAYER_NAME", F.lit("")),
        twice(layers, "DUPLICATE_LAYER_NAME", "name"),
        unknown(layers.select("id", F.explode("allow").alias("name")), "UNKNOWN_ALLOWED_LAYER", "name"),
        problem(rules.where(_blank(F.col("source")) | _blank(F.col("target"))), "INVALID_RULE", F.concat_ws("|", "source", "target")),
        problem(rules.where(wrong_mode), "INVALID_RULE_MODE", F.col("mode")),
        unknown(rules.select("id", F.explode(F.array("source", "target")).alias("name")), "UNKNOWN_RULE_LAYER", "name"),
        twice(rules, "DUPLICATE_RULE", "source", "target", "mode"),
        problem(modules.where(_blank(F.col("name")) | _blank(F.col("layer")) | (F.size("paths") < 1)), "INVALID_MODULE", F.col("name")),
        twice(modules, "DUPLICATE_MODULE_NAME", "name"),
        unknown(modules, "UNKNOWN_MODULE_LAYER", "layer"),
        twice(owners.select("id", "path"), "DUPLICATE_MODULE_PATH", "path"),
        problem(metadata.where("value rlike '^[\\\\[{]'"), "INVALID_METADATA", F.col("key")),
    ]
    problems = found[0]
    for part in found[1:]:
        problems = problems.unionByName(part)
    problems = problems.distinct()
    bad = problems.select("id").distinct()
    good = lambda df: df.join(bad, "id", "left_anti")
    return Blueprints(good(layers), good(rules), good(modules), good(metadata), problems)
