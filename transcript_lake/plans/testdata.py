"""The driver's tables read as usage entries, sessions and trees, by rules that DuckDB can repeat."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model names by event type: one plain, one with a date, one with a vendor's dots, one that matches two keys, one unknown.
MODELS = {"click": "claude-opus-4-5-20251101", "view": "claude-sonnet-4.5", "purchase": "vendor/claude-haiku-4-5", "error": "claude-opus-4", "signup": "mystery-1"}
PRICES = [("claude-opus-4-5", 5.0, 25.0), ("claude-opus-4", 15.0, 75.0), ("claude-sonnet-4-5", 3.0, 15.0), ("claude-haiku-4-5", 1.0, 5.0), ("claude", 2.0, 8.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def published_prices(spark: SparkSession) -> DataFrame:
    """Dollars a million tokens; whole numbers, so that sums are exact."""
    return spark.createDataFrame([(k, None, i, o, None, None) for k, i, o in PRICES], "map_key string, id string, input double, output double, cache_write double, cache_read double")


def usage_entries(events: DataFrame) -> DataFrame:
    """Usage entries from events: every third event a message, two requests, one event type a sidechain."""
    user, event = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    provider = F.element_at(F.array(*map(F.lit, ("claude", "codex", "opencode", "pi"))), (F.pmod(user, F.lit(4)) + 1).cast("int"))
    model = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(m)) for e, m in MODELS.items()])
    return events.select(
        event.alias("arrival"), F.col("ts").cast("timestamp").alias("ts"), provider.alias("provider"), F.concat(F.lit("p"), user % 10).alias("project"), F.concat(F.lit("s"), user).alias("session_id"),
        F.when(event % 50 == 0, "").otherwise(F.concat(F.lit("m"), F.floor(event / 3))).alias("message_id"), F.concat(F.lit("r"), event % 2).alias("request_id"), (F.col("event_type") == "error").alias("is_sidechain"), model.alias("model"),
        F.when(event % 7 == 0, F.concat(F.lit("a"), event % 21)).alias("agent_id"), F.floor(F.col("value") * 10).cast("long").alias("input"), F.floor("value").cast("long").alias("output"), (k * 100).alias("cache_read"), (k * 10).alias("cache_write_5m"),
        F.lit(0).cast("long").alias("cache_write_1h"), F.lit(0).cast("long").alias("reasoning"), F.lit(None).cast("double").alias("native_cost"),
    )


ENTRIES_SQL = """
e AS (
  SELECT event_id AS arrival, ts, ['claude','codex','opencode','pi'][(user_id % 4 + 1)::INT] AS provider, 'p' || (user_id % 10) AS project, 's' || user_id AS session_id,
    CASE WHEN event_id % 50 = 0 THEN '' ELSE 'm' || (event_id // 3) END AS message_id, 'r' || (event_id % 2) AS request_id, event_type = 'error' AS is_sidechain,
    CASE event_type WHEN 'click' THEN 'claude-opus-4-5-20251101' WHEN 'view' THEN 'claude-sonnet-4.5' WHEN 'purchase' THEN 'vendor/claude-haiku-4-5' WHEN 'error' THEN 'claude-opus-4' WHEN 'signup' THEN 'mystery-1' END AS model,
    CASE WHEN event_id % 7 = 0 THEN 'a' || (event_id % 21) END AS agent_id,
    floor(value * 10)::BIGINT AS input, floor(value)::BIGINT AS output, (props->>'$.k')::BIGINT * 100 AS cache_read, (props->>'$.k')::BIGINT * 10 AS cache_write_5m
  FROM events)"""

DEDUP_SQL = (
    ENTRIES_SQL
    + """,
f AS (
  SELECT *, min(CASE WHEN NOT is_sidechain THEN arrival END) OVER (PARTITION BY message_id) AS n0, min(arrival) OVER (PARTITION BY message_id, request_id) AS f0,
    first(is_sidechain) OVER (PARTITION BY message_id, request_id ORDER BY arrival) AS fs FROM e WHERE message_id <> ''),
s AS (SELECT *, CASE WHEN fs OR f0 IS NOT DISTINCT FROM n0 THEN NULL ELSE request_id END AS slot FROM f),
n AS (
  SELECT *, row_number() OVER (PARTITION BY message_id, slot ORDER BY is_sidechain, input + output + cache_read + cache_write_5m DESC, arrival) AS k,
    min(arrival) OVER (PARTITION BY message_id, slot) AS position FROM s),
d AS (
  SELECT arrival, ts, provider, project, session_id, message_id, request_id, is_sidechain, model, agent_id, input, output, cache_read, cache_write_5m, position FROM n WHERE k = 1
  UNION ALL SELECT *, arrival FROM e WHERE message_id = '')"""
)

RATE_SQL = """
r(model, i, o) AS (VALUES ('claude-opus-4-5-20251101', 5, 25), ('claude-sonnet-4.5', 3, 15), ('vendor/claude-haiku-4-5', 1, 5), ('claude-opus-4', 15, 75))"""


def tree_rows(conversations: DataFrame) -> DataFrame:
    """Turns as tree entries: the parent is the turn before; of every third turn, the one before that."""
    parent = F.when(F.col("turn") == 0, None).when(F.col("turn") % 3 == 2, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("message").alias("type"), F.col("turn").alias("id"), parent.alias("parent_id"), "role", F.length("text").cast("long").alias("input"), F.col("text").alias("content"))


TREE_SQL = """
t AS (SELECT conv_id AS session_id, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent_id, role, length(text)::BIGINT AS input FROM conversations),
leaf AS (SELECT session_id, id FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.session_id = t.session_id AND c.parent_id = t.id)),
top AS (SELECT session_id, max(id) AS last FROM t GROUP BY session_id),
ends AS (SELECT session_id, id FROM leaf UNION SELECT session_id, last FROM top),
walk AS (
  SELECT ends.session_id, ends.id AS leaf_id, ends.id AS id, 0 AS up FROM ends
  UNION ALL SELECT walk.session_id, leaf_id, t.parent_id, up + 1 FROM walk JOIN t ON t.session_id = walk.session_id AND t.id = walk.id WHERE t.parent_id IS NOT NULL AND EXISTS (SELECT 1 FROM t p WHERE p.session_id = t.session_id AND p.id = t.parent_id)),
b AS (SELECT walk.session_id, leaf_id, leaf_id = last AS is_active, max(up) OVER (PARTITION BY walk.session_id, leaf_id) - up AS pos, id FROM walk JOIN top USING (session_id))"""


def write_logs(lines: DataFrame, folder: str) -> None:
    """Writes lines (path, line_no, line) as files below folder, each in the order of line_no; a task that runs again writes the
    same files again. For queries that read logs as they lie on disk. Rows meet by path and are streamed to its file, so that
    neither many small files nor a large one are ever held."""

    def write(batches):
        from transcript_lake.sources.line_source import file_system

        system, root, _ = file_system(folder)

        def opened(path):
            try:
                return system.open_output_stream(path)
            except FileNotFoundError:
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                return system.open_output_stream(path)

        at = out = None
        for batch in batches:
            for path, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                if path != at:
                    if out is not None:
                        out.close()
                    at, out = path, opened(f"{root}/{path}")
                out.write("".join(f"{line}\n" for _, line in rows).encode())
        if out is not None:
            out.close()
        yield from ()

    rows = lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", "line")
    rows.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
