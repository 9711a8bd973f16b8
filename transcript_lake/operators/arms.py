"""Experiment arms: branches of sessions with the configuration and the metrics stamped on them.

The custom types of the two stamps are parameters: the names are the writer's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.functions.text import METRIC_KEY, config_hash, filled, same_model

CONFIG_TYPE, METRIC_TYPE = "experiment_config", "experiment_metric"
# The words for parts of a configuration, and what the old flat stamp holds besides components.
COMPONENTS = ("prompt", "context", "memory", "skills", "plan", "briefing")
KEY = ["session_id", "leaf_id"]
LEGACY_PLAIN = ("job_id", "provider", "schema", "config_hash", "task_id", "replicate", "sweep", "bundle_files")


def _text(path: str) -> Column:
    return filled(F.try_variant_get("data", path, "string"))


def parsed(custom: DataFrame) -> DataFrame:
    """custom (key, pos, id, custom_type, data_json) with data as a variant, null where it is not an object."""
    data = F.try_parse_json("data_json")
    return custom.withColumn("data", F.when(F.schema_of_variant(data).startswith("OBJECT"), data))


def config_stamps(custom: DataFrame, config_type: str = CONFIG_TYPE) -> DataFrame:
    """Per branch, the last stamp that can be read: model, provider, worktree_commit, components, config_hash, schema, job_id, task_id, replicate, bundle_files and is_legacy.

    A stamp without a config is of the old flat shape: its other filled string fields are the components, the provider is pi unless
    given, and there is no model and no hash. Fields whose names end in _version are no components."""
    rows = parsed(custom).where((F.col("custom_type") == config_type) & F.col("data").isNotNull())
    nested = F.try_variant_get("data", "$.config", "variant").isNotNull()
    fields = F.try_variant_get("data", "$", "map<string, variant>")
    plain = F.map_filter(fields, lambda k, v: ~k.isin(*LEGACY_PLAIN) & ~k.endswith("_version") & (F.schema_of_variant(v) == "STRING"))
    flat = F.map_filter(F.transform_values(plain, lambda k, v: F.try_variant_get(v, "$", "string")), lambda k, v: v != "")
    own = lambda c: F.when(nested, c)
    stamp = F.struct(
        _text("$.config.model").alias("model"), F.when(nested, _text("$.config.provider")).otherwise(F.coalesce(_text("$.provider"), F.lit("pi"))).alias("provider"), _text("$.config.worktree_commit").alias("worktree_commit"),
        F.when(nested, F.try_variant_get("data", "$.config.components", "map<string, string>")).otherwise(flat).alias("components"),
        own(_text("$.config_hash")).alias("config_hash"), own(F.try_variant_get("data", "$.schema", "int")).alias("schema"), _text("$.job_id").alias("job_id"), own(_text("$.task_id")).alias("task_id"),
        own(F.try_variant_get("data", "$.replicate", "int")).alias("replicate"), own(F.try_variant_get("data", "$.bundle_files", "array<string>")).alias("bundle_files"), (~nested).alias("is_legacy"), F.col("id").alias("entry_id"),
    )
    return rows.groupBy(*KEY).agg(F.max_by(stamp, "pos").alias("s")).select(*KEY, "s.*")


def metric_stamps(custom: DataFrame, metric_type: str = METRIC_TYPE) -> DataFrame:
    """Per branch with a readable metric stamp: component_metrics (good keys only; a later stamp's value wins; empty is not null), turns and tool_counts (the last ones given)."""
    rows = parsed(custom).where((F.col("custom_type") == metric_type) & F.col("data").isNotNull()).withColumn("m", F.try_variant_get("data", "$.metrics", "map<string, double>"))
    last = rows.groupBy(*KEY).agg(
        F.max_by(F.try_variant_get("data", "$.turns", "int"), F.when(F.try_variant_get("data", "$.turns", "int").isNotNull(), F.col("pos"))).alias("turns"),
        F.max_by(F.try_variant_get("data", "$.tool_counts", "map<string, int>"), F.when(F.try_variant_get("data", "$.tool_counts", "map<string, int>").isNotNull(), F.col("pos"))).alias("tool_counts"),
    )
    each = rows.select(*KEY, "pos", F.explode("m")).where(F.col("key").rlike(METRIC_KEY)).groupBy(*KEY, "key").agg(F.max_by("value", "pos").alias("value"))
    merged = each.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("component_metrics"))
    return last.join(merged, KEY, "left").withColumn("component_metrics", F.coalesce("component_metrics", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))


def arm_warnings(custom: DataFrame, stamps: DataFrame, models: DataFrame, compacted: DataFrame, config_type: str = CONFIG_TYPE, metric_type: str = METRIC_TYPE) -> DataFrame:
    """(session_id, leaf_id, code, entry_id, message): what is odd about arms; never an error."""
    stamped = F.col("custom_type").isin(config_type, metric_type)
    warn = lambda df, code, message, entry="id": df.select(*KEY, F.lit(code).alias("code"), (F.col(entry) if entry else F.lit(None)).cast("string").alias("entry_id"), message.cast("string").alias("message"))
    rows = parsed(custom)
    bad_keys = rows.where((F.col("custom_type") == metric_type) & F.col("data").isNotNull()).select(*KEY, "id", F.explode(F.try_variant_get("data", "$.metrics", "map<string, double>"))).where(~F.col("key").rlike(METRIC_KEY))
    own = config_hash(F.col("model"), F.col("provider"), F.col("worktree_commit"), F.col("components"))
    seen = models.join(stamps.select(*KEY, "model"), KEY, "left")
    differs = (F.size("models") > 1) | (F.col("model").isNotNull() & (F.size("models") == 1) & ~same_model(F.col("model"), F.element_at("models", 1)))
    found = [
        warn(rows.where(stamped & F.col("data").isNull()), "malformed_entry", F.concat(F.lit("cannot be read: "), F.col("custom_type"))),
        warn(stamps.where("is_legacy"), "legacy_config_shape", F.lit("configuration in the old flat shape"), "entry_id"),
        warn(stamps.where(~F.col("is_legacy") & F.col("config_hash").isNotNull() & (own != F.col("config_hash"))), "config_hash_mismatch", F.concat(F.lit("computed "), own), "entry_id"),
        warn(bad_keys, "bad_metric_key", F.col("key")),
        warn(seen.where(differs), "model_disagreement", F.concat_ws(", ", "models"), None),
        warn(compacted.where("compacted"), "compacted_arm", F.lit("the conversation was compacted"), None),
    ]
    return reduce(DataFrame.unionByName, found)


def arm_table(branches: DataFrame, stamps: DataFrame, metrics: DataFrame, cost: DataFrame, process: DataFrame, compacted: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row an arm: stamp, metrics, cost, tool calls and turns, compaction, count of warnings."""
    out = branches.select(*KEY, "is_active").distinct()
    counted = warnings.groupBy(*KEY).agg(F.count("*").alias("warnings"))
    own = process.select(*KEY, F.col("tool_calls").alias("tool_calls"), F.col("turns").alias("process_turns"))
    for other in (stamps, metrics, cost, own, compacted, counted):
        out = out.join(other, KEY, "left")
    return out.withColumns({"turns": F.coalesce("turns", "process_turns"), "compacted": F.coalesce("compacted", F.lit(False)), "warnings": F.coalesce("warnings", F.lit(0))}).drop("process_turns")


def summary(value: str | Column) -> Column:
    """n, mean, min and max of the values that are there; null if none is."""
    return F.when(F.count(value) > 0, F.struct(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max")))


def check_component(name: str) -> None:
    if name not in COMPONENTS:
        raise ValueError(f"unknown component {name!r}; one of {', '.join(COMPONENTS)}")


def by_component(arms: DataFrame, component: str) -> DataFrame:
    """Arms grouped by one component of their configuration: n, hashes, sessions, summaries, compacted ones. Arms whose
    configuration lacks the component are in no group; counted_out tells how many."""
    check_component(component)
    value = F.col("components")[component]
    rows = arms.where(F.map_contains_key("components", component)).withColumn("value", value)
    return rows.groupBy("value").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("config_hash")).alias("config_hashes"), F.array_sort(F.collect_set("session_id")).alias("session_ids"),
        summary("tool_calls").alias("tool_calls"), summary("turns").alias("turns"), F.count_if("compacted").alias("compacted"),
    )


def component_metrics(arms: DataFrame, component: str) -> DataFrame:
    """Per group and metric key, the summary over the arms that report it."""
    check_component(component)
    rows = arms.where(F.map_contains_key("components", component)).select(F.col("components")[component].alias("value"), F.explode("component_metrics").alias("metric", "v"))
    return rows.groupBy("value", "metric").agg(summary("v").alias("summary"))


def counted_out(arms: DataFrame, component: str) -> DataFrame:
    """Arms that by_component leaves out: those without a configuration, and those without the component."""
    check_component(component)
    return arms.agg(F.count_if(F.col("components").isNull()).alias("unattributed"), F.count_if(F.col("components").isNotNull() & ~F.map_contains_key("components", component)).alias("without_component"))


def arm_partials(arms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skipped): a record for each attributed arm with a replicate, the others with the reason. df.write.json leaves nulls out."""
    known = F.col("components").isNotNull()
    record = F.struct(F.lit(1).alias("schema"), F.struct("session_id", "leaf_id", "task_id", "replicate").alias("key"), F.struct("model", "provider", "worktree_commit", "components").alias("config"), F.col("component_metrics"))
    good = arms.where(known & F.col("replicate").isNotNull()).select(record.alias("r")).select("r.*")
    return good, arms.where(~known | F.col("replicate").isNull()).select(*KEY, F.when(~known, "unattributed").otherwise("no replicate").alias("reason"))
