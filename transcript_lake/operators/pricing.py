"""Prices of models, and their cost on usage entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.functions.usage import DEFAULT_CACHE_READ_FACTOR, DEFAULT_CACHE_WRITE_FACTOR, entry_cost, missing_model, names_match
from transcript_lake.operators.common import small

RATES = ["input", "output", "cache_write", "cache_read", "input_above", "output_above", "cache_write_above", "cache_read_above"]


def pricing_table(published: DataFrame) -> DataFrame:
    """Per-token rates from (map_key, id, input, output, cache_write, cache_read) in dollars a million.

    Rows without input or output go. The key is id, else the map's; of rows with one key the least map key stays.
    Cache rates that are not published follow from input. Rates above the tier are nullable and not published."""
    key = F.coalesce(F.nullif("id", F.lit("")), F.col("map_key"))
    rows = published.where("input is not null and output is not null").withColumn("model_key", key)
    first = Window.partitionBy("model_key").orderBy("map_key")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    per = lambda c: c / 1e6
    return rows.select(
        "model_key", per(F.col("input")).alias("input"), per(F.col("output")).alias("output"),
        per(F.coalesce("cache_write", F.col("input") * DEFAULT_CACHE_WRITE_FACTOR)).alias("cache_write"),
        per(F.coalesce("cache_read", F.col("input") * DEFAULT_CACHE_READ_FACTOR)).alias("cache_read"),
        *[F.lit(None).cast("double").alias(r) for r in RATES[4:]],
    )


def resolve_models(models: DataFrame, pricing: DataFrame) -> DataFrame:
    """(model, model_key) for the distinct models that have a price: the key itself, else the longest and then least key
    of those that match. Only distinct names meet the price list, which is small by its nature and checked."""
    names = models.select("model").where("model is not null").distinct()
    pairs = names.join(small(pricing.select("model_key")), (F.col("model") == F.col("model_key")) | names_match(F.col("model"), F.col("model_key")))
    best = Window.partitionBy("model").orderBy((F.col("model") != F.col("model_key")).cast("int"), F.desc(F.length("model_key")), "model_key")
    return pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def with_cost(entries: DataFrame, pricing: DataFrame, mode: str = "auto", names: DataFrame | None = None) -> DataFrame:
    """entries with cost and missing_model; native_cost is the log's own, if any. The models are looked for in names, which holds
    all that entries have: rows as they were before dedup, so that their count need not run it."""
    known = resolve_models(entries if names is None else names, pricing).join(pricing, "model_key").select("model", F.struct(*RATES).alias("_rates"))
    rows = entries.join(small(known), "model", "left")
    native = F.col("native_cost") if "native_cost" in entries.columns else F.lit(None).cast("double")
    return rows.withColumns({"cost": entry_cost(native, F.col("_rates"), mode), "missing_model": missing_model(native, F.col("_rates"), mode)}).drop("_rates")
