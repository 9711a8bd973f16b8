"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.functions.text import agent_label, clean_path, config_hash, line_churn, provider_of, session_parts, shortened
from transcript_lake.functions.usage import context_tokens, limit_status, raw_cost, tiered_cost, total_tokens
from transcript_lake.operators import arms, blocks, catalog, codex, messages, metrics, outline, paths, pricing, rollup, tree
from transcript_lake.operators.common import shared_folder, small
from transcript_lake.operators.dedup import dedup
from transcript_lake.plans import arms as arm_plans
from transcript_lake.sources import claude, codex as codex_log, jsonl, opencode, pi, usage, workflow
from transcript_lake.plans.testdata import DEDUP_SQL, ENTRIES_SQL, RATE_SQL, TREE_SQL, published_prices, table, tree_rows, usage_entries, write_logs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return usage_entries(table(spark, sf, "events"))


def priced(spark: SparkSession, sf: str) -> DataFrame:
    rows = entries(spark, sf)
    return pricing.with_cost(dedup(rows), pricing.pricing_table(published_prices(spark)), names=rows)


SUMS = "sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write_5m)::BIGINT AS cache_write_5m, sum(input + output + cache_read + cache_write_5m)::BIGINT AS total_tokens, count(*) AS messages"
COST = "round(sum(coalesce(input * i + output * o + cache_write_5m * i * 1.25 + cache_read * i * 0.1, 0)) / 1e6, 9) AS cost"
SUMMED = ["input", "output", "cache_read", "cache_write_5m", "total_tokens", "messages"]


@query(f"WITH {DEDUP_SQL} SELECT arrival, message_id, request_id, session_id, is_sidechain, input, output, position FROM d")
def dedup_entries(spark, sf):
    return dedup(entries(spark, sf)).select("arrival", "message_id", "request_id", "session_id", "is_sidechain", "input", "output", "position")


@query(
    f"WITH {DEDUP_SQL}, {RATE_SQL} SELECT provider, project, session_id, {SUMS}, {COST}, bool_or(i IS NULL AND input + output + cache_read + cache_write_5m > 0) AS missing_pricing, max(input + cache_read + cache_write_5m) AS peak_context, "
    "array_to_string(list_sort(list_distinct(list(model))), ',') AS models, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM d LEFT JOIN r USING (model) GROUP BY ALL HAVING sum(input + output + cache_read + cache_write_5m) > 0"
)
def session_usage(spark, sf):
    out = rollup.session_usage(priced(spark, sf))
    return out.select(*rollup.SESSION, *SUMMED, F.round("cost", 9).alias("cost"), "missing_pricing", "peak_context", F.array_join("models", ",").alias("models"), F.unix_micros("first_activity").alias("first_us"), F.unix_micros("last_activity").alias("last_us"))


@query(f"WITH {DEDUP_SQL}, {RATE_SQL} SELECT provider, project, session_id, model, {SUMS}, {COST} FROM d LEFT JOIN r USING (model) GROUP BY ALL")
def model_usage(spark, sf):
    return rollup.model_usage(priced(spark, sf)).select(*rollup.SESSION, "model", *SUMMED, F.round("cost", 9).alias("cost"))


@query(f"WITH {DEDUP_SQL} SELECT provider, project, session_id, agent_id, {SUMS}, arg_min(model, arrival) AS model FROM d WHERE agent_id IS NOT NULL GROUP BY provider, project, session_id, agent_id")
def agent_usage(spark, sf):
    return rollup.agent_usage(dedup(entries(spark, sf))).select(*rollup.SESSION, "agent_id", *SUMMED, "model")


@query(f"WITH {DEDUP_SQL}, {RATE_SQL} SELECT provider, project, session_id, provider IS NULL AS is_total, {SUMS}, {COST} FROM d LEFT JOIN r USING (model) GROUP BY GROUPING SETS ((provider, project, session_id), ())")
def usage_totals(spark, sf):
    return rollup.usage_with_total(priced(spark, sf)).select(*rollup.SESSION, "is_total", *SUMMED, F.round("cost", 9).alias("cost"))


@query(f"WITH {DEDUP_SQL.replace('FROM events)', 'FROM events WHERE ts IS NULL OR ts >= TIMESTAMP ' + chr(39) + '2024-01-15 00:00:00' + chr(39) + ')')} SELECT session_id, {SUMS} FROM d WHERE provider IN ('claude', 'pi') GROUP BY ALL")
def usage_since(spark, sf):
    rows = dedup(rollup.since(entries(spark, sf), datetime(2024, 1, 15)))
    return rollup.only_providers(rows, ["claude", "pi"]).groupBy("session_id").agg(*rollup.sums()).select("session_id", *SUMMED)


@query(
    f"WITH {ENTRIES_SQL} SELECT model, CASE model WHEN 'claude-opus-4-5-20251101' THEN 'claude-opus-4-5' WHEN 'claude-sonnet-4.5' THEN 'claude-sonnet-4-5' WHEN 'vendor/claude-haiku-4-5' THEN 'claude-haiku-4-5' WHEN 'claude-opus-4' THEN 'claude-opus-4' END AS model_key, "
    "count(*) AS entries FROM e WHERE model <> 'mystery-1' GROUP BY ALL"
)
def priced_models(spark, sf):
    rows = entries(spark, sf)
    found = pricing.resolve_models(rows, pricing.pricing_table(published_prices(spark)))
    return rows.join(small(found), "model").groupBy("model", "model_key").agg(F.count("*").alias("entries"))


@query(
    f"WITH {ENTRIES_SQL}, t AS (SELECT session_id, sum(input + cache_read)::BIGINT AS tokens FROM e GROUP BY session_id) SELECT session_id, tokens, CASE WHEN tokens > 200000 THEN 200000 * 3 + (tokens - 200000) * 6 ELSE tokens * 3 END::BIGINT AS tiered, tokens * 3 AS flat FROM t"
)
def tiered_costs(spark, sf):
    rows = entries(spark, sf).groupBy("session_id").agg(F.sum(F.col("input") + F.col("cache_read")).alias("tokens"))
    return rows.select("session_id", "tokens", tiered_cost(F.col("tokens"), F.lit(3), F.lit(6)).cast("long").alias("tiered"), tiered_cost(F.col("tokens"), F.lit(3), F.lit(None).cast("int")).cast("long").alias("flat"))


@query(f"WITH {ENTRIES_SQL} SELECT arrival, input + output + cache_read + cache_write_5m AS total, input + cache_read + cache_write_5m AS context, round((input * 3 + output * 15 + cache_write_5m * 3.75 + cache_read * 0.3) / 1e6, 9) AS cost FROM e")
def raw_costs(spark, sf):
    rates = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in zip(pricing.RATES, (3e-6, 15e-6, 3.75e-6, 0.3e-6, None, None, None, None), strict=True)])
    return entries(spark, sf).select("arrival", total_tokens().alias("total"), context_tokens().alias("context"), F.round(raw_cost(rates), 9).alias("cost"))


BLOCK_WALK = """
o AS (SELECT session_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, arrival) AS n, input + output + cache_read + cache_write_5m AS tokens, input + output AS plain, model FROM e),
w AS (
  SELECT session_id, n, ts, date_trunc('hour', ts) AS start, ts AS first, NULL::TIMESTAMP AS gap FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, o.ts, CASE WHEN o.ts - w.start > INTERVAL 5 HOUR OR o.ts - w.ts > INTERVAL 5 HOUR THEN date_trunc('hour', o.ts) ELSE w.start END,
    CASE WHEN o.ts - w.start > INTERVAL 5 HOUR OR o.ts - w.ts > INTERVAL 5 HOUR THEN o.ts ELSE w.first END, CASE WHEN o.ts - w.ts > INTERVAL 5 HOUR THEN w.ts END
  FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1)"""
BLOCK_SQL = f"WITH RECURSIVE {ENTRIES_SQL}, {BLOCK_WALK}"


@query(
    f"{BLOCK_SQL} SELECT session_id, epoch_us(w.start) AS start_us, epoch_us(w.start) + 18000000000 AS end_us, epoch_us(min(w.ts)) AS first_us, epoch_us(max(w.ts)) AS last_us, count(*) AS entries, sum(tokens)::BIGINT AS total_tokens, "
    "array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM w JOIN o USING (session_id, n) GROUP BY session_id, w.start"
)
def usage_blocks(spark, sf):
    us = F.unix_micros
    rows = blocks.usage_blocks(entries(spark, sf), ["session_id"]).where("not is_gap")
    return rows.select("session_id", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "entries", "total_tokens", F.array_join("models", ",").alias("models"))


@query(
    f"{BLOCK_SQL.replace('INTERVAL 5 HOUR', 'INTERVAL 90 MINUTE')} SELECT session_id, epoch_us(w.start) AS start_us, epoch_us(w.first) AS first_us, epoch_us(max(w.ts)) AS last_us, count(*) AS entries, sum(tokens)::BIGINT AS total_tokens "
    "FROM w JOIN o USING (session_id, n) GROUP BY session_id, w.start, w.first"
)
def short_blocks(spark, sf):
    """Blocks of 90 minutes."""
    rows = blocks.usage_blocks(entries(spark, sf), ["session_id"], 1.5).where("not is_gap")
    return rows.select("session_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "entries", "total_tokens")


@query(f"{BLOCK_SQL} SELECT session_id, epoch_us(gap) + 18000000000 AS start_us, epoch_us(ts) AS end_us FROM w WHERE gap IS NOT NULL")
def gap_blocks(spark, sf):
    return blocks.usage_blocks(entries(spark, sf), ["session_id"]).where("is_gap").select("session_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"))


@query(f"WITH RECURSIVE {ENTRIES_SQL.replace('FROM events)', 'FROM events)')}, {BLOCK_WALK.replace('session_id, ts, row_number', chr(39) + 'all' + chr(39) + ' AS session_id, ts, row_number').replace('PARTITION BY session_id ORDER', 'ORDER')} SELECT epoch_us(w.start) AS start_us, count(*) AS entries, sum(tokens)::BIGINT AS total_tokens FROM w JOIN o USING (session_id, n) GROUP BY w.start")
def global_blocks(spark, sf):
    return blocks.usage_blocks(entries(spark, sf)).where("not is_gap").select(F.unix_micros("start_ts").alias("start_us"), "entries", "total_tokens")


@query(
    f"{BLOCK_SQL}, b AS (SELECT session_id, w.start, sum(tokens)::BIGINT AS total FROM w JOIN o USING (session_id, n) GROUP BY ALL), "
    "m AS (SELECT b.session_id, b.start, total, sum(o.tokens) AS tokens, (epoch_us(max(o.ts)) - epoch_us(min(o.ts))) / 60e6 AS minutes FROM b JOIN o ON o.session_id = b.session_id AND o.ts >= b.start AND o.ts < b.start + INTERVAL 5 HOUR GROUP BY ALL) "
    "SELECT session_id, epoch_us(start) AS start_us, total AS total_tokens, round(CASE WHEN minutes > 0 THEN tokens / minutes END, 4) AS tokens_per_minute, "
    "CASE WHEN total > 50000 THEN 'exceeds' WHEN total > 40000 THEN 'warning' ELSE 'ok' END AS limit_status FROM m"
)
def block_burn(spark, sf):
    rows = entries(spark, sf)
    out = blocks.with_burn_rate(blocks.usage_blocks(rows, ["session_id"]), rows, ["session_id"]).where("not is_gap")
    return out.select("session_id", F.unix_micros("start_ts").alias("start_us"), "total_tokens", F.round("tokens_per_minute", 4).alias("tokens_per_minute"), limit_status(F.col("total_tokens"), F.lit(None).cast("long"), 50_000).alias("limit_status"))


@query(
    f"{BLOCK_SQL}, b AS (SELECT session_id, w.start, max(w.ts) AS last, sum(tokens)::BIGINT AS total FROM w JOIN o USING (session_id, n) GROUP BY ALL), now AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now), "
    "l AS (SELECT b.* FROM b, now WHERE last <= now AND now - last < INTERVAL 5 HOUR AND now < start + INTERVAL 5 HOUR), "
    "m AS (SELECT l.session_id, l.start, total, sum(o.tokens) AS tokens, (epoch_us(max(o.ts)) - epoch_us(min(o.ts))) / 60e6 AS minutes FROM l JOIN o ON o.session_id = l.session_id AND o.ts >= l.start AND o.ts < l.start + INTERVAL 5 HOUR GROUP BY ALL) "
    "SELECT session_id, epoch_us(start) AS start_us, CASE WHEN minutes > 0 THEN round((epoch_us(start) + 18000000000 - epoch_us(now)) / 60e6)::BIGINT END AS remaining_minutes, "
    "CASE WHEN minutes > 0 THEN round(total + tokens / minutes * ((epoch_us(start) + 18000000000 - epoch_us(now)) / 60e6))::BIGINT END AS projected_tokens FROM m, now"
)
def block_projection(spark, sf):
    now = datetime(2024, 1, 15, 12)
    rows = blocks.block_report(entries(spark, sf), ["session_id"], now=now).where("is_active").where(F.col("last_ts") <= F.lit(now))
    return rows.select("session_id", F.unix_micros("start_ts").alias("start_us"), "remaining_minutes", "projected_tokens")


@query(
    f"WITH {ENTRIES_SQL}, c AS (SELECT session_id, arrival, input, output, sum(CASE WHEN arrival % 97 = 0 THEN -500 ELSE input END) OVER w AS ti, sum(output) OVER w AS tu FROM e WINDOW w AS (PARTITION BY session_id ORDER BY arrival)), "
    "l AS (SELECT *, ti - coalesce(lag(ti) OVER (PARTITION BY session_id ORDER BY arrival), 0) AS di, tu - coalesce(lag(tu) OVER (PARTITION BY session_id ORDER BY arrival), 0) AS du FROM c) "
    "SELECT session_id, arrival, CASE WHEN least(di, du) < 0 THEN input ELSE di END::BIGINT AS input, CASE WHEN least(di, du) < 0 THEN output ELSE du END::BIGINT AS output FROM l"
)
def cumulative_delta(spark, sf):
    w = Window.partitionBy("session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    planted = F.when(F.col("arrival") % 97 == 0, F.lit(-500)).otherwise(F.col("input"))
    rows = entries(spark, sf).select("session_id", "arrival", F.struct(F.sum(planted).over(w).alias("input"), F.sum("output").over(w).alias("output")).alias("total"), F.struct("input", "output").alias("last"))
    return codex.cumulative_delta(rows, ["input", "output"], "session_id", "arrival").select("session_id", "arrival", "input", "output")


@query(
    f"WITH {ENTRIES_SQL}, c AS (SELECT session_id, arrival, CASE WHEN arrival % 5 = 0 THEN model END AS model, CASE WHEN arrival % 9 = 0 THEN project || arrival END AS project FROM e) "
    "SELECT session_id, arrival, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY arrival) AS model, last_value(project IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS project FROM c"
)
def model_carry_forward(spark, sf):
    rows = entries(spark, sf).select("session_id", "arrival", F.when(F.col("arrival") % 5 == 0, F.col("model")).alias("model"), F.when(F.col("arrival") % 9 == 0, F.concat("project", "arrival")).alias("project"))
    return codex.final_value(codex.carry_forward(rows, ["model"], "session_id", "arrival"), ["project"], "session_id", "arrival")


@query(
    f"WITH {ENTRIES_SQL} SELECT session_id, count(*) AS messages, sum(input + cache_read + cache_write_5m)::BIGINT AS input_tokens, sum(output)::BIGINT AS output_tokens, arg_max(input + cache_read + cache_write_5m, arrival) AS latest_context, arg_max(cache_read, arrival) AS latest_cache_read, arg_max(output, arrival) AS latest_output FROM e GROUP BY session_id"
)
def token_stats(spark, sf):
    return rollup.token_stats(entries(spark, sf), "session_id", "arrival")


@query(f"WITH {DEDUP_SQL}, u AS (SELECT provider, project, 's' || (substr(session_id, 2)::BIGINT % 40) AS session_id, sum(input + output + cache_read + cache_write_5m)::BIGINT AS total_tokens FROM d GROUP BY ALL HAVING total_tokens > 0), k AS (SELECT *, CASE provider WHEN 'claude' THEN 0 WHEN 'codex' THEN 1 WHEN 'opencode' THEN 2 ELSE 3 END AS p FROM u) SELECT provider, project, session_id, total_tokens FROM k QUALIFY p = min(p) OVER (PARTITION BY session_id)")
def first_provider(spark, sf):
    rows = dedup(entries(spark, sf)).withColumn("session_id", F.concat(F.lit("s"), F.substring("session_id", 2, 20).cast("long") % 40))
    return rollup.first_provider_with_usage(rollup.session_usage(rows).select(*rollup.SESSION, "total_tokens"))


def talk(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@query("SELECT conv_id AS session_id, turn AS seq, length(text)::BIGINT AS chars FROM conversations WHERE role = 'user' AND contains(text, 'the')")
def role_messages(spark, sf):
    return messages.with_role(talk(spark, sf), "user", "the").select("session_id", "seq", F.length("content").cast("long").alias("chars"))


@query("SELECT conv_id AS session_id, count(*) AS total, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def message_stats(spark, sf):
    return messages.message_stats(talk(spark, sf))


@query("SELECT conv_id AS session_id, turn AS seq, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def tail_messages(spark, sf):
    return messages.tail(talk(spark, sf), 3, order=["seq"]).select("session_id", "seq", "role")


@query("WITH l AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), u AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM l WHERE back <= 4) SELECT conv_id AS session_id, turn AS seq, used::BIGINT AS used FROM u WHERE used <= 900")
def budget_window(spark, sf):
    return messages.budget_window(talk(spark, sf), 4, 300, order=["seq"]).select("session_id", "seq", F.col("used").cast("long").alias("used"))


@query("WITH n AS (SELECT conv_id AS session_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) SELECT session_id, seq, nth FROM n WHERE nth % 3 = 0")
def summary_due(spark, sf):
    return messages.summary_due(talk(spark, sf), 3, order=["seq"]).select("session_id", "seq", F.col("nth").cast("long").alias("nth"))


@query("SELECT conv_id AS session_id, turn AS line_index, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS end_line FROM conversations WHERE role = 'user' AND turn % 3 = 0")
def job_slices(spark, sf):
    jobs = talk(spark, sf).where("role = 'user' and seq % 3 = 0").select("session_id", F.col("seq").alias("line_index"))
    return messages.job_slices(jobs)


@query("WITH j AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM conversations WHERE role = 'user' AND turn % 3 = 0) SELECT c.conv_id AS session_id, j.turn AS line_index, count(*) AS lines FROM conversations c JOIN j ON c.conv_id = j.conv_id AND c.turn >= j.turn AND (stop IS NULL OR c.turn < stop) GROUP BY ALL")
def job_line_counts(spark, sf):
    rows = talk(spark, sf)
    jobs = rows.where("role = 'user' and seq % 3 = 0").select("session_id", F.col("seq").alias("line_index"))
    return messages.job_lines(rows.withColumnRenamed("seq", "line_no"), jobs).groupBy("session_id", "line_index").agg(F.count("*").alias("lines"))


@query("WITH c AS (SELECT conv_id, turn, turn // 2 AS call_id, length(text) AS n FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, turn // 2 AS call_id FROM conversations WHERE role = 'assistant' AND turn % 4 <> 3) SELECT conv_id AS session_id, arg_max('tool' || (n % 5), turn) AS in_flight_tool, max(turn) AS seq FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id AND r.turn > c.turn) GROUP BY conv_id")
def in_flight_tool(spark, sf):
    rows = talk(spark, sf).withColumn("call_id", F.floor(F.col("seq") / 2))
    calls = rows.where("role = 'user'").select("session_id", "seq", "call_id", F.concat(F.lit("tool"), F.length("content") % 5).alias("name"))
    return messages.in_flight_tool(calls, rows.where("role = 'assistant' and seq % 4 <> 3").select("session_id", "seq", "call_id"))


@query(f"WITH RECURSIVE {TREE_SQL} SELECT session_id, id FROM leaf")
def tree_leaves(spark, sf):
    return tree.leaves(tree.tree_nodes(tree_rows(table(spark, sf, "conversations")))).select("session_id", "id")


@query("WITH t AS (SELECT conv_id AS session_id, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN turn + 1000 ELSE turn - 1 END AS parent_id FROM conversations) SELECT session_id, id, p.there IS NULL AS is_root, parent_id IS NOT NULL AND p.there IS NULL AS is_orphan FROM t LEFT JOIN (SELECT session_id AS s, id AS i, TRUE AS there FROM t) p ON p.s = t.session_id AND p.i = t.parent_id")
def orphan_roots(spark, sf):
    planted = F.when(F.col("id") == 0, None).when(F.col("id") % 5 == 4, F.col("id") + 1000).otherwise(F.col("id") - 1)
    nodes = tree.tree_nodes(tree_rows(table(spark, sf, "conversations"))).withColumn("parent_id", planted)
    return tree.with_roots(nodes).select("session_id", "id", "is_root", "is_orphan")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT session_id, leaf_id, is_active, pos::BIGINT AS pos, id FROM b")
def tree_branches(spark, sf):
    return tree.branches(tree.tree_nodes(tree_rows(table(spark, sf, "conversations"))))


@query(f"WITH RECURSIVE {TREE_SQL}, k AS (SELECT session_id, parent_id AS id FROM t WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT session_id, leaf_id, arg_max(id, pos) AS fork_id FROM b JOIN k USING (session_id, id) GROUP BY ALL")
def tree_forks(spark, sf):
    nodes = tree.tree_nodes(tree_rows(table(spark, sf, "conversations")))
    return tree.forks(tree.branches(nodes), nodes)


@query(f"WITH RECURSIVE {TREE_SQL}, k AS (SELECT session_id, parent_id AS id FROM t WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1), f AS (SELECT session_id, arg_max(id, pos) AS fork_id FROM b JOIN k USING (session_id, id) WHERE is_active GROUP BY ALL), a AS (SELECT b.session_id, leaf_id, pos AS at FROM b JOIN f USING (session_id) WHERE id = fork_id) SELECT b.session_id, b.leaf_id, b.pos::BIGINT AS pos, b.id FROM b JOIN a USING (session_id, leaf_id) WHERE b.pos > a.at")
def tree_arms(spark, sf):
    nodes = tree.tree_nodes(tree_rows(table(spark, sf, "conversations")))
    found = tree.branches(nodes)
    fork = tree.forks(found.where("is_active"), nodes).select("session_id", "fork_id")
    return tree.arms_below(found, fork).select("session_id", "leaf_id", "pos", "id")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT b.session_id, leaf_id, sum(input)::BIGINT AS input FROM b JOIN t USING (session_id, id) GROUP BY ALL")
def arm_cost(spark, sf):
    nodes = tree.tree_nodes(tree_rows(table(spark, sf, "conversations")))
    return tree.arm_cost(tree.linearised(tree.branches(nodes), nodes.select("session_id", "id", "input")))


@query(f"WITH RECURSIVE {TREE_SQL}, m AS (SELECT b.session_id, leaf_id, role AS model, min(pos) AS p FROM b JOIN t USING (session_id, id) GROUP BY ALL) SELECT session_id, leaf_id, string_agg(model, ',' ORDER BY p) AS models FROM m GROUP BY ALL")
def branch_models(spark, sf):
    nodes = tree.tree_nodes(tree_rows(table(spark, sf, "conversations")))
    out = tree.models_on(tree.linearised(tree.branches(nodes), nodes.select("session_id", "id", F.col("role").alias("model"))))
    return out.select("session_id", "leaf_id", F.array_join("models", ",").alias("models"))


@query(
    "WITH a AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE 'c' || (conv_id % 3) END AS c, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE count(*) END AS calls FROM conversations GROUP BY conv_id) "
    "SELECT c AS value, count(*) AS n, count(calls) AS reporting, round(avg(calls), 9) AS mean, min(calls)::DOUBLE AS lo, max(calls)::DOUBLE AS hi FROM a WHERE c IS NOT NULL GROUP BY c"
)
def by_component(spark, sf):
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("calls"))
    value = F.concat(F.lit("c"), F.col("session_id") % 3)
    given = F.when(F.col("session_id") % 7 == 0, F.create_map(F.lit("model"), F.lit("x"))).otherwise(F.create_map(F.lit("context"), value))
    table_ = rows.select("session_id", given.alias("components"), F.when(F.col("session_id") % 4 == 0, None).otherwise(F.col("calls")).alias("tool_calls"), F.lit(1).alias("turns"), F.lit("h").alias("config_hash"), F.lit(False).alias("compacted"))
    return arms.by_component(table_, "context").select("value", "n", F.coalesce("tool_calls.n", F.lit(0)).alias("reporting"), F.round("tool_calls.mean", 9).alias("mean"), F.col("tool_calls.min").alias("lo"), F.col("tool_calls.max").alias("hi"))


@query("WITH m AS (SELECT source, list(DISTINCT lang) AS langs FROM documents WHERE doc_id % 10 = 0 GROUP BY source) SELECT s.source AS session_id, CASE WHEN s.source = 'src0' THEN NULL ELSE (SELECT count(*) FROM documents d WHERE d.source = s.source AND NOT coalesce(list_contains(m.langs, d.lang), FALSE))::DOUBLE END AS off_bundle_reads FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN m USING (source)")
def off_bundle_reads(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("lang").alias("path"), "doc_id")
    manifest = F.when(F.col("session_id") == "src0", None).otherwise(F.collect_set(F.when(F.col("doc_id") % 10 == 0, F.col("path"))))
    return metrics.off_bundle_reads(docs, docs.groupBy("session_id").agg(manifest.alias("manifest"))).select("session_id", "off_bundle_reads")


@query(
    "WITH c AS (SELECT 's' || user_id AS session_id, event_type, '/repo/f' || ((props->>'$.k')::BIGINT % 9) AS path FROM events WHERE event_type <> 'error') "
    "SELECT session_id, count(*) AS tool_calls, count(DISTINCT path) FILTER (event_type IN ('view', 'click')) AS files_touched, count(DISTINCT path) FILTER (event_type = 'click') AS files_edited, "
    "coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (event_type IN ('view', 'click')), '') AS touched FROM c GROUP BY session_id"
)
def file_touches(spark, sf):
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").otherwise("Bash")
    path = F.concat(F.lit("/repo/f"), F.get_json_object("props", "$.k").cast("long") % 9)
    given = F.parse_json(F.to_json(F.struct(path.alias("file_path"))))
    part = F.struct(F.lit("tool_call").alias("type"), F.lit(None).cast("string").alias("text"), F.col("event_id").cast("string").alias("tool_call_id"), tool.alias("name"), given.alias("input"))
    rows = table(spark, sf, "events").select(F.lit("claude").alias("provider"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit("assistant").alias("role"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_sidechain"), F.array(part).alias("parts"))
    return metrics.process_metrics(rows).select("session_id", F.col("tool_calls").cast("long").alias("tool_calls"), F.col("files_touched").cast("long").alias("files_touched"), F.col("files_edited").cast("long").alias("files_edited"), F.array_join("touched", ",").alias("touched"))


@query("SELECT conv_id AS session_id, count(*) FILTER (role = 'user' AND trim(text) <> '') AS turns FROM conversations GROUP BY conv_id")
def turns_per_session(spark, sf):
    part = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input"))
    rows = talk(spark, sf).select(F.lit("claude").alias("provider"), "session_id", "seq", "role", F.lit(None).cast("timestamp").alias("ts"), F.lit(False).alias("is_sidechain"), F.array(part).alias("parts"))
    return metrics.process_metrics(rows).select("session_id", F.col("turns").cast("long").alias("turns"))


@query(
    "WITH p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source, lang, doc_id // 1000 ORDER BY doc_id) AS old FROM documents), "
    "l AS (SELECT doc_id, CASE WHEN coalesce(old, '') = '' THEN [] ELSE string_split(CASE WHEN ends_with(old, chr(10)) THEN left(old, -1) ELSE old END, chr(10)) END AS a, "
    "CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, -1) ELSE text END, chr(10)) END AS b FROM p), "
    "f AS (SELECT *, least(len(a), len(b)) AS m, coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), FALSE), 0) - 1, least(len(a), len(b))) AS front FROM l), "
    "k AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, m - front + 1), lambda i: a[len(a) + 1 - i] = b[len(b) + 1 - i]), FALSE), 0) - 1, m - front) AS back FROM f) "
    "SELECT doc_id, (len(b) - front - back)::BIGINT AS added, (len(a) - front - back)::BIGINT AS removed FROM k"
)
def line_churns(spark, sf):
    """Each document's lines against those of the document before it in its source and language."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lag("text").over(Window.partitionBy("source", "lang", F.floor(F.col("doc_id") / 1000)).orderBy("doc_id")).alias("old"))
    return docs.select("doc_id", line_churn(F.col("old"), F.col("text")).alias("c")).select("doc_id", "c.added", "c.removed")


@query("SELECT doc_id, CASE WHEN length(line) > 80 THEN left(line, 77) || '...' ELSE line END AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)")
def titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", shortened(F.col("text")).alias("title"))


@query("SELECT page_id, regexp_replace(url, '^https?:/(/[^?#]*?)/*([?#].*)?$', '\\1') AS path FROM pages")
def page_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean_path(F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")).alias("path"))


@query(
    "WITH r AS (SELECT o_custkey AS s, o_orderkey AS k, o_orderstatus AS status, o_orderdate AS started, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a' || o_orderkey END AS attempt FROM orders) "
    "SELECT s AS session_id, k AS order_id, status FROM r QUALIFY row_number() OVER (PARTITION BY s ORDER BY (attempt = '')::INT, started DESC, attempt DESC) = 1"
)
def registry_pick(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("a"), "o_orderkey")).alias("attempt_id"))
    return catalog.latest_attempts(rows, "session_id").select("session_id", "order_id", "status")


@query(
    "WITH l AS (SELECT c_custkey AS s, c_mktsegment AS project FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT o_custkey AS s, arg_max(o_orderpriority, (o_orderdate, 'a' || o_orderkey)) AS project FROM orders GROUP BY o_custkey), "
    "a AS (SELECT c_custkey AS s, c_name AS project FROM customer WHERE c_custkey % 5 = 0) "
    "SELECT l.s AS session_id, coalesce(r.project, a.project, l.project) AS project, CASE WHEN r.s IS NOT NULL THEN 'registry' WHEN a.s IS NOT NULL THEN 'archive' ELSE 'log' END AS origin FROM l LEFT JOIN r USING (s) LEFT JOIN a USING (s) "
    "UNION ALL SELECT s, project, 'registry only' FROM r WHERE s NOT IN (SELECT s FROM l) UNION ALL SELECT s, project, 'archive only' FROM a WHERE s NOT IN (SELECT s FROM l) AND s NOT IN (SELECT s FROM r)"
)
def catalog_precedence(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), "c_mktsegment", "c_name")
    registry = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("started_at"), F.concat(F.lit("a"), "o_orderkey").alias("attempt_id"))
    logs = people.where("session_id % 2 = 0").select("session_id", F.col("c_mktsegment").alias("project"))
    return catalog.catalogue(logs, registry, people.where("session_id % 5 = 0").select("session_id", F.col("c_name").alias("project")))


@query("SELECT user_id % 4 AS provider, user_id AS workdir, arg_max('f' || event_id, (ts, 'f' || event_id)) AS file_path FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL")
def newest_transcript(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("provider"), F.col("user_id").alias("workdir"), F.concat(F.lit("f"), "event_id").alias("file_path"), F.col("ts").cast("timestamp").alias("first_ts"), F.lit(None).cast("timestamp").alias("modified_at"))
    return catalog.newest_transcript(rows, datetime(2024, 1, 10)).drop("at")


@query(
    "WITH i AS (SELECT conv_id AS s, turn AS seq, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 0 END AS level, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) "
    "SELECT s AS session_id, seq, coalesce(lead(level) OVER (PARTITION BY s ORDER BY seq) > level, FALSE) AS has_kids, coalesce((SELECT min(j.k) FROM i j WHERE j.s = i.s AND j.k > i.k AND j.level <= i.level), n + 1) - k - 1 AS descendants FROM i"
)
def outline_folds(spark, sf):
    items = talk(spark, sf).select("session_id", "seq", F.lit(0).cast("long").alias("sub_seq"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("level"))
    return outline.with_folds(items).select("session_id", "seq", "has_kids", F.col("descendants").cast("long").alias("descendants"))


def logged(rows: DataFrame, record) -> DataFrame:
    """Raw lines (file_path, line_no, line) of rows with file_path and line_no: the record as one JSON object each."""
    return rows.select("file_path", F.col("line_no").cast("long").alias("line_no"), F.to_json(record).alias("line"))


@query(f"WITH {ENTRIES_SQL} SELECT arrival AS line_no, session_id, message_id, request_id, is_sidechain, model, input, output, cache_read, cache_write_5m, 0::BIGINT AS cache_write_1h FROM e")
def claude_usage_lines(spark, sf):
    """Every event as a logged line of a session, read by the source."""
    rows = entries(spark, sf).withColumns({"file_path": F.concat(F.lit("/logs/projects/"), "project", F.lit("/"), "session_id", F.lit(".jsonl")), "line_no": F.col("arrival")})
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_write_5m").alias("cache_creation_input_tokens"), F.col("cache_read").alias("cache_read_input_tokens"))
    record = F.struct(F.lit("assistant").alias("type"), F.col("session_id").alias("sessionId"), F.col("request_id").alias("requestId"), F.col("is_sidechain").alias("isSidechain"), F.struct(F.col("message_id").alias("id"), "model", usage.alias("usage")).alias("message"))
    return claude.usage_entries(logged(rows, record)).select("line_no", "session_id", "message_id", "request_id", "is_sidechain", "model", "input", "output", "cache_read", "cache_write_5m", "cache_write_1h")


@query("SELECT 'c' || conv_id AS session_id, turn::BIGINT AS seq, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def claude_message_lines(spark, sf):
    """Every turn as a logged line, read as an entry with one text part."""
    rows = table(spark, sf, "conversations").withColumns({"file_path": F.concat(F.lit("/logs/projects/p/c"), "conv_id", F.lit(".jsonl")), "line_no": F.col("turn")})
    record = F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message"))
    return claude.entries(logged(rows, record)).select("session_id", "seq", "role", F.get("parts", F.lit(0))["text"].alias("text"))


@query(f"WITH {ENTRIES_SQL} SELECT session_id, arrival AS line_no, coalesce(model, 'codex/unknown') AS model, input, output FROM e")
def codex_usage_lines(spark, sf):
    """Every session as a log of cumulative counts, each after its model's line; the source takes the rises, also those of nothing."""
    so_far = Window.partitionBy("session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entries(spark, sf).withColumns({"file_path": F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")), "line_no": 2 * F.col("arrival") + 1, "all_input": F.sum("input").over(so_far), "all_output": F.sum("output").over(so_far)})
    total = F.struct(F.col("all_input").alias("input_tokens"), F.col("all_output").alias("output_tokens"))
    counts = logged(rows, F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")).alias("payload")))
    models = logged(rows.withColumn("line_no", F.col("line_no") - 1), F.struct(F.lit("turn_context").alias("type"), F.struct("model").alias("payload")))
    first = rows.groupBy("file_path", "session_id").agg(F.lit(-1).alias("line_no"))
    heads = logged(first, F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), F.lit("/work").alias("cwd")).alias("payload")))
    found = codex_log.usage_entries(counts.union(models).union(heads))
    return found.select("session_id", F.floor((F.col("line_no") - 1) / 2).cast("long").alias("line_no"), "model", "input", "output")


@query(f"WITH {ENTRIES_SQL} SELECT session_id, '/' || project AS project, arrival AS line_no, model, input, output, cache_read, cache_write_5m, output::DOUBLE AS native_cost FROM e")
def pi_usage_lines(spark, sf):
    """Every session as a tree log with a header; the log's own cost is read with the counts."""
    rows = entries(spark, sf).withColumns({"file_path": F.concat(F.lit("/logs/.pi/"), "session_id", F.lit(".jsonl")), "line_no": F.col("arrival")})
    usage = F.struct("input", "output", F.col("cache_read").alias("cacheRead"), F.col("cache_write_5m").alias("cacheWrite"), F.struct(F.col("output").alias("total")).alias("cost"))
    said = logged(rows, F.struct(F.lit("message").alias("type"), F.struct(F.lit("assistant").alias("role"), "model", usage.alias("usage")).alias("message")))
    first = rows.groupBy("file_path", "session_id", "project").agg(F.lit(-1).alias("line_no"))
    heads = logged(first, F.struct(F.lit("session").alias("type"), F.col("session_id").alias("id"), F.concat(F.lit("/"), "project").alias("cwd")))
    return pi.usage_entries(said.union(heads)).select("session_id", "project", "line_no", "model", "input", "output", "cache_read", "cache_write_5m", "native_cost")


@query(
    f"WITH {ENTRIES_SQL} SELECT session_id, CASE WHEN project = 'p3' THEN 'id3' ELSE '/' || project END AS project, 'e' || arrival AS message_id, concat_ws('/', provider, model) AS model, input, output, cache_read, cache_write_5m, "
    "CASE WHEN output > 0 THEN output::DOUBLE END AS native_cost FROM e WHERE input > 0 OR output > 0"
)
def opencode_usage_fragments(spark, sf):
    """Every event as a message fragment, its session as a session fragment; one project has no directory."""
    rows = entries(spark, sf)
    fragment = lambda record, schema: F.from_json(F.to_json(record), schema)
    where = F.when(F.col("project") == "p3", "").otherwise(F.concat(F.lit("/"), "project"))
    head = F.struct(F.col("session_id").alias("id"), F.lit("id3").alias("projectID"), where.alias("directory"))
    sessions = rows.select("session_id", "project").distinct().select(fragment(head, opencode.SESSION).alias("r"), F.col("session_id").alias("file_path")).select("r.*", "file_path")
    tokens = F.struct("input", "output", F.struct(F.col("cache_read").alias("read"), F.col("cache_write_5m").alias("write")).alias("cache"))
    message = F.struct(F.concat(F.lit("e"), "arrival").alias("id"), F.col("session_id").alias("sessionID"), F.lit("assistant").alias("role"), F.col("provider").alias("providerID"), F.col("model").alias("modelID"), F.col("output").cast("double").alias("cost"), tokens.alias("tokens"))
    messages_ = rows.select(fragment(message, opencode.MESSAGE).alias("r"), F.col("session_id").alias("file_path")).select("r.*", "file_path")
    return opencode.usage_entries(sessions, messages_).select("session_id", "project", "message_id", "model", "input", "output", "cache_read", "cache_write_5m", "native_cost")


FILE_DEDUP_SQL = DEDUP_SQL.replace("\ne AS (", "\ne0 AS (", 1).replace(
    ",\nf AS (", ",\ne AS (SELECT * REPLACE (CASE WHEN message_id = '' THEN '' ELSE session_id || '/' || coalesce(agent_id, '') || '/' || message_id END AS message_id) FROM e0),\nf AS (", 1
)


@query(f"WITH {FILE_DEDUP_SQL} SELECT session_id || '/' || coalesce(agent_id, '') AS file_path, {SUMS} FROM d GROUP BY ALL")
def transcript_usage(spark, sf):
    """A file for each session and agent, replays taken out within it only."""
    rows = entries(spark, sf).withColumn("file_path", F.concat("session_id", F.lit("/"), F.coalesce("agent_id", F.lit(""))))
    return rollup.transcript_totals(rows).select("file_path", *SUMMED)


@query(f"WITH {ENTRIES_SQL} SELECT session_id, CASE WHEN bool_or(agent_id IS NULL) THEN max(project) ELSE 'other' END AS project, {SUMS} FROM e GROUP BY session_id")
def usage_with_agents(spark, sf):
    """Agents' files, under names and projects of their own, count with the session that they name inside."""
    own = F.col("agent_id").isNull()
    name = F.when(own, F.col("session_id")).otherwise(F.concat("agent_id", F.lit("-"), "session_id"))
    rows = entries(spark, sf).withColumns({"project": F.when(own, F.col("project")).otherwise("other"), "file_path": F.concat(F.lit("/logs/"), name, F.lit(".jsonl")), "line_no": F.lit(0).cast("long")})
    inner = catalog.inner_session_ids(rows)
    return rollup.by_inner_session(rows.withColumn("session_id", name), inner).groupBy("session_id", "project").agg(*rollup.sums()).select("session_id", "project", *SUMMED)


@query(
    f"WITH {DEDUP_SQL}, {RATE_SQL}, m AS (SELECT provider, project, session_id, model, sum(input + output + cache_read + cache_write_5m)::BIGINT AS total, max(ts) AS ts FROM d GROUP BY ALL) "
    "SELECT session_id AS \"sessionId\", project AS \"projectPath\", sum(total)::BIGINT AS \"totalTokens\", strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"lastActivity\", "
    "coalesce(array_to_string(list_sort(list(model) FILTER (model IS NOT NULL)), ','), '') AS names FROM m GROUP BY provider, project, session_id HAVING sum(total) > 0"
)
def usage_report(spark, sf):
    """The report's document a session; names are those of its breakdowns."""
    rows = priced(spark, sf)
    out = rollup.report(rollup.session_usage(rows), rollup.model_usage(rows))
    return out.select("sessionId", "projectPath", "totalTokens", "lastActivity", F.array_join(F.transform("modelBreakdowns", lambda m: m["modelName"]), ",").alias("names"))


@query(
    "WITH v AS (SELECT conv_id AS c, turn AS t, TRUE AS s, NULL::VARCHAR AS r FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn - 1, FALSE, '{\"n\":' || coalesce(length(text), 0) || '}' FROM conversations WHERE role = 'assistant'), "
    "j AS (SELECT c, t, bool_or(s) AS started, max(r) AS result FROM v GROUP BY c, t), f AS (SELECT DISTINCT conv_id AS c, turn AS t, '/runs/wf_' || conv_id || '/agent-a' || turn || '.jsonl' AS transcript FROM conversations) "
    "SELECT 'wf_' || c AS run_id, 'a' || t AS agent_id, coalesce(started, FALSE) AS started, result, transcript FROM j FULL JOIN f USING (c, t)"
)
def workflow_runs(spark, sf):
    """Conversations as runs: a user's turn starts an agent, the assistant's brings its result, every turn has a transcript."""
    turns = table(spark, sf, "conversations")
    folder = F.concat(F.lit("/runs/wf_"), "conv_id")
    at = turns.where("role in ('user', 'assistant')").withColumns({"file_path": F.concat(folder, F.lit("/journal.jsonl")), "line_no": F.col("turn")})
    started = F.struct(F.lit("started").alias("type"), F.concat(F.lit("a"), "turn").alias("agentId"))
    result = F.struct(F.lit("result").alias("type"), F.concat(F.lit("a"), F.col("turn") - 1).alias("agentId"), F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n")).alias("result"))
    agents = turns.withColumns({"file_path": F.concat(folder, F.lit("/agent-a"), "turn", F.lit(".jsonl")), "line_no": F.lit(0)})
    lines = logged(at.where("role = 'user'"), started).union(logged(at.where("role = 'assistant'"), result)).union(logged(agents, F.struct(F.lit("user").alias("type"))))
    return workflow.runs(lines)


@query(
    "SELECT doc_id, sha256('{' || CASE WHEN coalesce(lang, '') <> '' THEN '\"model\":\"' || lang || '\",' ELSE '' END || CASE WHEN coalesce(source, '') <> '' THEN '\"provider\":\"' || source || '\",' ELSE '' END || "
    "'\"components\":{\"context\":\"' || coalesce(lang, '') || '\",\"plan\":\"' || coalesce(source, '') || '\"}}') AS config_hash FROM documents"
)
def config_hashes(spark, sf):
    """A configuration for each document; its components are given out of order."""
    components = F.create_map(F.lit("plan"), F.coalesce("source", F.lit("")), F.lit("context"), F.coalesce("lang", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", config_hash(F.col("lang"), F.col("source"), F.lit(None).cast("string"), components).alias("config_hash"))


@query(
    "WITH s AS (SELECT user_id AS session_id, event_id AS pos, event_type, (props->>'$.k')::BIGINT AS k FROM events), t AS (SELECT session_id, arg_max(k, pos) FILTER (event_type = 'click') AS turns FROM s GROUP BY session_id), "
    "m AS (SELECT session_id, 'm.k' || (k % 5) AS metric, arg_max(k, pos)::DOUBLE AS value FROM s WHERE event_type <> 'error' GROUP BY ALL) SELECT session_id, metric, value, turns::INT AS turns FROM m JOIN t USING (session_id)"
)
def merged_metrics(spark, sf):
    """Every event as a metric stamp: a later value wins, keys of another form are left out, turns are the last ones given."""
    k = F.get_json_object("props", "$.k").cast("long")
    name = F.when(F.col("event_type") == "error", "Bad key").otherwise(F.concat(F.lit("m.k"), k % 5))
    data = F.to_json(F.struct(F.create_map(name, k).alias("metrics"), F.when(F.col("event_type") == "click", k).alias("turns")))
    stamps = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.lit("x").alias("leaf_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("id"), F.lit(arms.METRIC_TYPE).alias("custom_type"), data.alias("data_json"))
    return arms.metric_stamps(stamps).select("session_id", F.explode("component_metrics").alias("metric", "value"), "turns")


@query(f"WITH {ENTRIES_SQL} SELECT arrival, provider, session_id, project, coalesce(agent_id, 'parent') AS agent FROM e")
def path_facts(spark, sf):
    """Runtime, session, project and agent, told from a log's path."""
    home = F.element_at(F.create_map(*map(F.lit, ("claude", "/h/.claude", "codex", "/h/.codex", "opencode", "/h/opencode/storage", "pi", "/h/.pi"))), F.col("provider"))
    file = F.when(F.col("agent_id").isNull(), ".jsonl").otherwise(F.concat(F.lit("/subagents/agent-"), "agent_id", F.lit(".jsonl")))
    rows = entries(spark, sf).select("arrival", F.concat(home, F.lit("/projects/"), "project", F.lit("/"), "session_id", file).alias("path"))
    parts = session_parts(F.col("path"))
    return rows.select("arrival", provider_of(F.col("path")).alias("provider"), parts["session_id"].alias("session_id"), parts["project"].alias("project"), agent_label(F.col("path")).alias("agent"))


@query(
    "SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1 AS line_no, conv_id, turn, coalesce(length(text), 0)::BIGINT AS chars FROM conversations"
)
def raw_log_lines(spark, sf):
    """Turns written as one log a role, cut into files as large logs are, each read by ranges of 16 KB, and numbered as lines of
    their log. The folder spells the role's bytes, so any role comes back, also none."""
    folder = shared_folder(spark, "logs")
    turns = table(spark, sf, "conversations")
    log = F.coalesce(F.concat(F.lit("x"), F.hex("role")), F.lit("none"))
    lines = turns.select(log.alias("log"), F.to_json(F.struct("conv_id", "turn", "text")).alias("value"), "conv_id", "turn", "text")
    order = ["log", *[F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "text")]]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("log", "value").write.partitionBy("log").text(folder)
    of = F.regexp_extract("file_path", "log=([^/]*)", 1)
    read = jsonl.raw_lines(spark, folder, "*.txt", split_bytes=16 * 1024, log=of)
    said = read.withColumn("j", F.from_json("line", "conv_id bigint, turn bigint, text string"))
    role = F.when(of != "none", F.unhex(F.substring(of, 2, 2**31 - 1)).cast("string"))
    return said.select(role.alias("role"), "line_no", "j.conv_id", "j.turn", F.coalesce(F.length("j.text"), F.lit(0)).cast("long").alias("chars"))


def experiment_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as tree logs of experiments. What a turn is, the length of a user's text tells: a compaction (to 60),
    a stamp of the old flat shape (to 100), one that cannot be read (to 120), a metric (191 to 280), or a configuration (from 281; from 350
    on with a wrong hash); all else is said."""
    at = F.concat(F.lit("/logs/.pi/c"), "session_id", F.lit(".jsonl"))
    rows = tree_rows(table(spark, sf, "conversations")).withColumns({"file_path": at, "line_no": F.col("seq"), "n": F.col("input")})
    who = [F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("t"), "parent_id")).alias("parentId")]
    custom = lambda kind, data: F.struct(F.lit("custom").alias("type"), *who, F.lit(kind).alias("customType"), data.alias("data"))
    user, n = rows.where("role = 'user'"), F.col("n")
    plan = F.concat(F.lit("p"), F.floor(n / 100).cast("string"))
    told = F.concat(F.lit('{"model":"x/alpha","provider":"pi","components":{"plan":"'), plan, F.lit('"}}'))
    config = F.struct(F.lit("x/alpha").alias("model"), F.lit("pi").alias("provider"), F.struct(plan.alias("plan")).alias("components"))
    nested = F.struct(F.lit(1).alias("schema"), config.alias("config"), F.when(n < 350, F.sha2(told, 256)).otherwise("wrong").alias("config_hash"), F.col("seq").alias("replicate"))
    metric = F.struct(F.create_map(F.lit("plan.chars"), n, F.lit("Bad Key"), F.lit(1).cast("long")).alias("metrics"))
    said = F.struct(
        F.lit("message").alias("type"), *who,
        F.struct(F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), F.when(F.col("role") != "user", F.when(n < 1400, "alpha").otherwise("beta")).alias("model"), F.col("content"), F.struct(n.alias("input")).alias("usage")).alias("message"),
    )
    parts = [
        logged(user.where("n <= 60"), F.struct(F.lit("compaction").alias("type"), *who)),
        logged(user.where("n > 60 and n <= 100"), custom(arms.CONFIG_TYPE, F.struct(F.lit("flat").alias("plan"), F.lit("j1").alias("job_id")))),
        logged(user.where("n > 100 and n <= 120"), custom(arms.CONFIG_TYPE, F.lit("no object"))),
        logged(user.where("n > 190 and n <= 280"), custom(arms.METRIC_TYPE, metric)),
        logged(user.where("n > 280"), custom(arms.CONFIG_TYPE, nested)),
        logged(rows.where("role <> 'user' or (n > 120 and n <= 190)"), said),
        logged(rows.select("file_path", "session_id").distinct().withColumn("line_no", F.lit(-1)), F.struct(F.lit("session").alias("type"), F.concat(F.lit("c"), "session_id").alias("id"), F.lit("/w").alias("cwd"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


ARM_SQL = (
    TREE_SQL
    + """,
x AS (SELECT 'c' || b.session_id AS session_id, 't' || leaf_id AS leaf_id, is_active, pos, 't' || b.id AS id, role = 'user' AS u, input AS n, b.id AS turn FROM b JOIN t USING (session_id, id)),
arm AS (SELECT DISTINCT session_id, leaf_id, is_active FROM x),
stamp AS (
  SELECT session_id, leaf_id, arg_max(id, pos) AS entry_id, arg_max(n, pos) AS n, arg_max(turn, pos) AS turn FROM x WHERE u AND (n > 280 OR (n > 60 AND n <= 100)) GROUP BY ALL),
metric AS (SELECT session_id, leaf_id, arg_max(n, pos)::DOUBLE AS chars FROM x WHERE u AND n > 190 AND n <= 280 GROUP BY ALL),
model AS (SELECT session_id, leaf_id, count(DISTINCT n < 1400) AS models, bool_or(n >= 1400) AS beta FROM x WHERE NOT u GROUP BY ALL),
cost AS (SELECT session_id, leaf_id, sum(CASE WHEN NOT u OR (n > 120 AND n <= 190) THEN n ELSE 0 END)::BIGINT AS input, bool_or(u AND n <= 60) AS compacted FROM x GROUP BY ALL),
warning AS (
  SELECT session_id, leaf_id, 'malformed_entry' AS code, id AS entry_id FROM x WHERE u AND n > 100 AND n <= 120
  UNION ALL SELECT session_id, leaf_id, 'legacy_config_shape', entry_id FROM stamp WHERE n <= 100
  UNION ALL SELECT session_id, leaf_id, 'config_hash_mismatch', entry_id FROM stamp WHERE n >= 350
  UNION ALL SELECT session_id, leaf_id, 'bad_metric_key', id FROM x WHERE u AND n > 190 AND n <= 280
  UNION ALL SELECT session_id, leaf_id, 'model_disagreement', NULL FROM model LEFT JOIN stamp USING (session_id, leaf_id) WHERE models > 1 OR (n > 280 AND beta)
  UNION ALL SELECT session_id, leaf_id, 'compacted_arm', NULL FROM cost WHERE compacted)"""
)


@query(
    f"WITH RECURSIVE {ARM_SQL} SELECT session_id, leaf_id, is_active, CASE WHEN n > 280 THEN 'x/alpha' END AS model, CASE WHEN n > 280 THEN 'p' || (n // 100) WHEN n IS NOT NULL THEN 'flat' END AS plan, "
    "CASE WHEN n >= 350 THEN 'wrong' WHEN n > 280 THEN sha256('{\"model\":\"x/alpha\",\"provider\":\"pi\",\"components\":{\"plan\":\"p' || (n // 100) || '\"}}') END AS config_hash, CASE WHEN n > 280 THEN turn END::INT AS replicate, "
    "CASE WHEN n <= 100 THEN 'j1' END AS job_id, chars, input, compacted, (SELECT count(*) FROM warning w WHERE w.session_id = arm.session_id AND w.leaf_id = arm.leaf_id) AS warnings "
    "FROM arm LEFT JOIN stamp USING (session_id, leaf_id) LEFT JOIN metric USING (session_id, leaf_id) JOIN cost USING (session_id, leaf_id)"
)
def lifted_arms(spark, sf):
    """Every branch as an arm, lifted from its log's lines: the last stamp that can be read, merged metrics, tokens of the branch alone."""
    found, _ = arm_plans.lift_arms(experiment_lines(spark, sf), all_branches=True)
    return found.select("session_id", "leaf_id", "is_active", "model", F.col("components")["plan"].alias("plan"), "config_hash", "replicate", "job_id", F.col("component_metrics")["plan.chars"].alias("chars"), "input", "compacted", "warnings")


@query(f"WITH RECURSIVE {ARM_SQL} SELECT session_id, leaf_id, code, entry_id FROM warning")
def arm_checks(spark, sf):
    """What is odd about the arms: all six checks."""
    _, warnings = arm_plans.lift_arms(experiment_lines(spark, sf), all_branches=True)
    return warnings.select("session_id", "leaf_id", "code", "entry_id")


@query(f"WITH RECURSIVE {ARM_SQL} SELECT session_id, leaf_id, is_active, pos::BIGINT AS pos, entry_id FROM stamp JOIN (SELECT session_id, leaf_id, is_active, id AS entry_id, pos FROM x) USING (session_id, leaf_id, entry_id)")
def stamped_ancestors(spark, sf):
    """The nearest stamped entry above each leaf, from chains alone: no path is spelled out."""
    nodes = tree.tree_nodes(pi.tree_rows(experiment_lines(spark, sf)))
    placed, _ = paths.chains(nodes)
    runs, _ = paths.segments(placed)
    marks = nodes.where(F.col("custom_type") == arms.CONFIG_TYPE).where("data_json like '{%'").select("session_id", "id", F.col("id").alias("entry_id"))
    return paths.latest_along(runs, placed, marks, "entry_id").select("session_id", "leaf_id", "is_active", "pos", "entry_id")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT b.session_id, leaf_id, sum(input)::BIGINT AS input, count(*) AS entries FROM b JOIN t USING (session_id, id) GROUP BY ALL")
def branch_sums(spark, sf):
    """Sums over each branch, from prefix sums of chains."""
    nodes = tree.tree_nodes(tree_rows(table(spark, sf, "conversations")))
    placed, _ = paths.chains(nodes)
    runs, _ = paths.segments(placed)
    return paths.sums_along(runs, placed, nodes.select("session_id", "id", "input", F.lit(1).cast("long").alias("entries")), ["input", "entries"]).select("session_id", "leaf_id", "input", "entries")


SCAN_DEDUP_SQL = DEDUP_SQL.replace("\ne AS (", "\ne0 AS (", 1).replace(
    ",\nf AS (", ",\ne AS (SELECT * REPLACE (row_number() OVER (ORDER BY project || '/' || session_id || '.jsonl', arrival) AS arrival) FROM e0 WHERE provider = 'claude'),\nf AS (", 1
)


@query(
    f"WITH {SCAN_DEDUP_SQL} SELECT 'claude' AS provider, project, session_id, message_id, model, input, output, cache_read, cache_write_5m FROM d "
    "UNION ALL SELECT 'codex', '/work', session_id, '', coalesce(model, 'codex/unknown'), input, output, 0, 0 FROM e0 WHERE provider = 'codex' "
    "UNION ALL SELECT 'opencode', '/' || project, session_id, 'e' || arrival, concat_ws('/', provider, model), input, output, cache_read, cache_write_5m FROM e0 WHERE provider = 'opencode' AND (input > 0 OR output > 0) "
    "UNION ALL SELECT 'pi', '/' || project, session_id, '', model, input, output, cache_read, cache_write_5m FROM e0 WHERE provider = 'pi'"
)
def usage_of_runtimes(spark, sf):
    """Events written as the logs of four runtimes, one file a session (fragments: one a message), read by one entry point, replays
    taken out in the order of the scan."""
    folder = shared_folder(spark, "stores")
    rows = entries(spark, sf)
    of = lambda name: rows.where(F.col("provider") == name)
    file = lambda lines, path: lines.select(path.alias("path"), F.col("line_no").cast("long").alias("line_no"), "line")
    at = lambda *parts: F.concat(*[F.lit(p) if "/" in p or "." in p else F.col(p) for p in parts])
    line = lambda df, record, *keep: df.select(*keep, F.to_json(record).alias("line"))

    c = of("claude").withColumn("line_no", F.col("arrival"))
    used = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_write_5m").alias("cache_creation_input_tokens"), F.col("cache_read").alias("cache_read_input_tokens"))
    said = F.struct(F.lit("assistant").alias("type"), F.col("request_id").alias("requestId"), F.col("is_sidechain").alias("isSidechain"), F.struct(F.col("message_id").alias("id"), "model", used.alias("usage")).alias("message"))
    parts = [file(line(c, said, "project", "session_id", "line_no"), at("claude/projects/", "project", "/", "session_id", ".jsonl"))]

    x = of("codex")
    so_far = Window.partitionBy("session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.struct(F.sum("input").over(so_far).alias("input_tokens"), F.sum("output").over(so_far).alias("output_tokens"))
    count = x.withColumns({"t": total, "line_no": 2 * F.col("arrival") + 1})
    kinds = [
        line(count, F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(F.col("t").alias("total_token_usage")).alias("info")).alias("payload")), "session_id", "line_no"),
        line(x.withColumn("line_no", 2 * F.col("arrival")), F.struct(F.lit("turn_context").alias("type"), F.struct("model").alias("payload")), "session_id", "line_no"),
        line(x.select("session_id").distinct().withColumn("line_no", F.lit(-1).cast("long")), F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), F.lit("/work").alias("cwd")).alias("payload")), "session_id", "line_no"),
    ]
    parts += [file(k, at("codex/sessions/2024/01/02/", "session_id", ".jsonl")) for k in kinds]

    p = of("pi").withColumn("line_no", F.col("arrival"))
    used = F.struct("input", "output", F.col("cache_read").alias("cacheRead"), F.col("cache_write_5m").alias("cacheWrite"))
    kinds = [
        line(p, F.struct(F.lit("message").alias("type"), F.struct(F.lit("assistant").alias("role"), "model", used.alias("usage")).alias("message")), "session_id", "line_no"),
        line(p.select("session_id", "project").distinct().withColumn("line_no", F.lit(-1).cast("long")), F.struct(F.lit("session").alias("type"), F.col("session_id").alias("id"), F.concat(F.lit("/"), "project").alias("cwd")), "session_id", "line_no"),
    ]
    parts += [file(k, at("pi/sessions/", "session_id", ".jsonl")) for k in kinds]

    o = of("opencode").withColumns({"line_no": F.lit(0).cast("long"), "m": F.concat(F.lit("e"), "arrival")})
    used = F.struct("input", "output", F.struct(F.col("cache_read").alias("read"), F.col("cache_write_5m").alias("write")).alias("cache"))
    message = F.struct(F.col("m").alias("id"), F.col("session_id").alias("sessionID"), F.lit("assistant").alias("role"), F.col("provider").alias("providerID"), F.col("model").alias("modelID"), used.alias("tokens"))
    head = F.struct(F.col("session_id").alias("id"), F.lit("id").alias("projectID"), F.concat(F.lit("/"), "project").alias("directory"))
    parts.append(file(line(o, message, "session_id", "m", "line_no"), at("opencode/storage/message/", "session_id", "/", "m", ".json")))
    parts.append(file(line(o.select("session_id", "project", "line_no").distinct(), head, "session_id", "line_no"), at("opencode/storage/session/", "session_id", ".json")))
    for part in parts[1:]:
        parts[0] = parts[0].union(part)
    write_logs(parts[0], folder)
    stores = {"claude": f"{folder}/claude/projects", "codex": f"{folder}/codex/sessions", "pi": f"{folder}/pi/sessions", "opencode": f"{folder}/opencode/storage"}
    return dedup(usage.usage_of(spark, stores)).select("provider", "project", "session_id", "message_id", "model", "input", "output", "cache_read", "cache_write_5m")


def part_rows(found: DataFrame) -> DataFrame:
    """A row for each part of entries."""
    parts = found.select("session_id", "seq", "role", F.posexplode("parts").alias("k", "p"))
    return parts.select("session_id", "seq", "role", F.col("k").cast("long").alias("k"), "p.type", "p.text", "p.name", "p.tool_call_id", F.try_variant_get("p.input", "$.n", "bigint").alias("n"), "p.output", "p.is_error")


def turn_lines(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumns({"n": F.length("text").cast("long"), "t": F.col("turn").cast("long")})
    return turns.withColumns({"file_path": F.concat(F.lit(folder), "conv_id", F.lit(".jsonl")), "line_no": 4 * F.col("t")})


TURN_SQL = "v AS (SELECT 'c' || conv_id AS s, turn::BIGINT AS t, role, text, length(text)::BIGINT AS n FROM conversations)"


@query(
    f"WITH {TURN_SQL}, r AS (SELECT s, t - 1 AS t, text, n > 300 AS bad FROM v WHERE role = 'user') "
    "SELECT s AS session_id, 4 * t AS seq, role, 0::BIGINT AS k, 'text' AS type, text, NULL AS name, NULL AS tool_call_id, NULL::BIGINT AS n, NULL AS output, NULL::BOOLEAN AS is_error FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t, role, 1, 'reasoning', 'hm', NULL, NULL, NULL, NULL, NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT v.s, 4 * v.t, role, 2, 'tool_call', NULL, 'run', 'c' || v.t, v.n, r.text, r.bad FROM v LEFT JOIN r USING (s, t) WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t, role, 0, 'tool_result', NULL, NULL, 'c' || (t - 1), NULL, text, n > 300 FROM v WHERE role = 'user' AND n > 100 "
    "UNION ALL SELECT s, 4 * t, role, 1, 'text', 'go on', NULL, NULL, NULL, NULL, NULL FROM v WHERE role = 'user' AND n > 100"
)
def claude_tool_parts(spark, sf):
    """Assistant turns as text, thinking and a call; user turns as its result, with text beside it if they are long. Each call has its
    result's output; entries that are nothing but results go."""
    rows = turn_lines(spark, sf, "/logs/projects/p/c")
    block = lambda **f: F.struct(*[c.cast(t).alias(k) for k, t in {"type": "string", "text": "string", "thinking": "string", "id": "string", "name": "string", "input": "struct<n: bigint>", "tool_use_id": "string", "content": "string", "is_error": "boolean"}.items() for c in [f.get(k, F.lit(None))]])
    call = block(type=F.lit("tool_use"), id=F.concat(F.lit("c"), "t"), name=F.lit("run"), input=F.struct("n"))
    result = block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("c"), F.col("t") - 1), content=F.col("text"), is_error=F.col("n") > 300)
    own = F.array(block(type=F.lit("text"), text=F.col("text")), block(type=F.lit("thinking"), thinking=F.lit("hm")), call)
    content = F.when(F.col("role") == "assistant", own).otherwise(F.when(F.col("n") > 100, F.array(result, block(type=F.lit("text"), text=F.lit("go on")))).otherwise(F.array(result)))
    record = F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.struct("role", content.alias("content")).alias("message"))
    return part_rows(claude.merged_results(claude.entries(logged(rows, record))))


@query(
    f"WITH {TURN_SQL} SELECT s AS session_id, 4 * t AS seq, 'user' AS role, 0::BIGINT AS k, 'text' AS type, text, NULL AS name, NULL AS tool_call_id, NULL::BIGINT AS n, NULL AS output, NULL::BOOLEAN AS is_error FROM v WHERE role = 'user' AND n > 60 "
    "UNION ALL SELECT s, 4 * t, 'assistant', 0, CASE WHEN n < 500 THEN 'reasoning' ELSE 'text' END, text, NULL, NULL, NULL, NULL, NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t + 1, 'assistant', 0, 'tool_call', NULL, 'shell', 'c' || t, CASE WHEN n < 900 THEN n END, NULL, NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t + 2, 'assistant', 0, 'tool_result', NULL, NULL, 'c' || t, NULL, 'out ' || n, n > 1000 FROM v WHERE role = 'assistant'"
)
def codex_parts(spark, sf):
    """Turns as rollout lines: messages (short ones set the environment and go), reasoning, calls whose arguments may be no JSON, and their outputs with an exit code."""
    rows = turn_lines(spark, sf, "/codex/sessions/2024/01/02/rollout-c")
    said, own = rows.where("role = 'user'"), rows.where("role = 'assistant'")
    item = lambda df, kind, payload, at=0: logged(df.withColumn("line_no", F.col("line_no") + at), F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    text = F.when(F.col("n") > 60, F.col("text")).otherwise(F.concat(F.lit("<environment_context>"), "text"))
    spoken = F.when(F.col("n") < 500, F.lit("agent_reasoning")).otherwise("agent_message")
    given = F.when(F.col("n") < 900, F.to_json(F.struct("n"))).otherwise("no json {")
    out = F.to_json(F.struct(F.concat(F.lit("out "), F.col("n")).alias("output"), F.struct(F.when(F.col("n") > 1000, 1).otherwise(0).alias("exit_code")).alias("metadata")))
    lines = [
        item(said, "response_item", F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"))),
        item(own, "event_msg", F.struct(spoken.alias("type"), F.when(F.col("n") < 500, F.col("text")).alias("text"), F.when(F.col("n") >= 500, F.col("text")).alias("message"))),
        item(own, "response_item", F.struct(F.lit("function_call").alias("type"), F.concat(F.lit("c"), "t").alias("call_id"), F.lit("shell").alias("name"), given.alias("arguments")), 1),
        item(own, "response_item", F.struct(F.lit("function_call_output").alias("type"), F.concat(F.lit("c"), "t").alias("call_id"), out.alias("output")), 2),
        item(rows.select("file_path", "conv_id").distinct().withColumn("line_no", F.lit(-1)), "session_meta", F.struct(F.concat(F.lit("c"), "conv_id").alias("id"))),
    ]
    for x in lines[1:]:
        lines[0] = lines[0].union(x)
    return part_rows(codex_log.entries(lines[0]))


@query(
    f"WITH {TURN_SQL} SELECT s AS session_id, 4 * t AS seq, 'user' AS role, 0::BIGINT AS k, 'text' AS type, text, NULL AS name, NULL AS tool_call_id, NULL::BIGINT AS n, NULL AS output, NULL::BOOLEAN AS is_error FROM v WHERE role = 'user' AND n > 60 "
    "UNION ALL SELECT s, 4 * t, 'assistant', 0, 'reasoning', text, NULL, NULL, NULL, NULL, NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t, 'assistant', 1, 'tool_call', NULL, 'bash', 'c' || t, n, NULL, NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t + 1, 'user', 0, 'tool_result', NULL, 'bash', 'c' || t, NULL, text || chr(10) || 'end', n > 1000 FROM v WHERE role = 'assistant'"
)
def pi_parts(spark, sf):
    """Turns as entries of a tree log; short user turns are injected and hidden."""
    rows = turn_lines(spark, sf, "/h/.pi/x_c")
    said, own = rows.where("role = 'user'"), rows.where("role = 'assistant'")
    id_ = F.concat(F.lit("c"), "t")
    blocks = F.array(
        F.struct(F.lit("thinking").alias("type"), F.col("text").alias("thinking"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<n: bigint>").alias("arguments")),
        F.struct(F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("thinking"), id_.alias("id"), F.lit("bash").alias("name"), F.struct("n").alias("arguments")),
    )
    texts = F.array(*[F.struct(F.lit("text").alias("type"), x.alias("text")) for x in (F.col("text"), F.lit("end"))])
    lines = [
        logged(said.where("n > 60"), F.struct(F.lit("message").alias("type"), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message"))),
        logged(said.where("n <= 60"), F.struct(F.lit("custom_message").alias("type"), F.lit("note").alias("customType"), F.lit(False).alias("display"), F.col("text").alias("content"))),
        logged(own, F.struct(F.lit("message").alias("type"), F.struct(F.lit("assistant").alias("role"), blocks.alias("content")).alias("message"))),
        logged(own.withColumn("line_no", F.col("line_no") + 1), F.struct(F.lit("message").alias("type"), F.struct(F.lit("toolResult").alias("role"), id_.alias("toolCallId"), F.lit("bash").alias("toolName"), (F.col("n") > 1000).alias("isError"), texts.alias("content")).alias("message"))),
        logged(rows.select("file_path", "conv_id").distinct().withColumn("line_no", F.lit(-1)), F.struct(F.lit("session").alias("type"), F.concat(F.lit("c"), "conv_id").alias("id"))),
    ]
    for x in lines[1:]:
        lines[0] = lines[0].union(x)
    return part_rows(pi.entries(lines[0]))


@query(
    f"WITH {TURN_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t) AS seq FROM v) "
    "SELECT s AS session_id, seq, role, 0::BIGINT AS k, 'text' AS type, text, NULL AS name, NULL AS tool_call_id, NULL::BIGINT AS n, NULL AS output, NULL::BOOLEAN AS is_error FROM q WHERE role <> 'system' "
    "UNION ALL SELECT s, seq, role, 1, 'tool_call', NULL, 'grep', 'c' || t, n, 'out ' || n, n > 1000 FROM q WHERE role = 'assistant'"
)
def opencode_parts(spark, sf):
    """Turns as message and part fragments, parts out of order; steps go, and messages of nothing else."""
    rows = turn_lines(spark, sf, "/storage/")
    fragment = lambda df, record, schema: df.select(F.from_json(F.to_json(record), schema).alias("r"), F.col("file_path")).select("r.*", "file_path")
    session, message = F.concat(F.lit("c"), "conv_id"), F.concat(F.lit("m"), "conv_id", F.lit("_"), "t")
    found = fragment(rows, F.struct(message.alias("id"), session.alias("sessionID"), "role", F.struct(F.col("t").alias("created")).alias("time")), opencode.MESSAGE)
    part = lambda df, place, *f: fragment(df, F.struct(F.concat(F.lit(place), message).alias("id"), message.alias("messageID"), *f), opencode.PART)
    state = F.struct(F.when(F.col("n") > 1000, "error").otherwise("completed").alias("status"), F.concat(F.lit("out "), F.col("n")).alias("output"), F.struct("n").alias("input"))
    parts = part(rows.where("role = 'assistant'"), "b", F.lit("tool").alias("type"), F.concat(F.lit("c"), "t").alias("callID"), F.lit("grep").alias("tool"), state.alias("state"))
    parts = parts.unionByName(part(rows, "c", F.lit("step-finish").alias("type"))).unionByName(part(rows.where("role <> 'system'"), "a", F.lit("text").alias("type"), "text"))
    return part_rows(opencode.entries(found, parts))


@query(
    f"WITH {TURN_SQL} SELECT s AS session_id, 4 * t AS seq, role, role || '_u' || t AS message_id, text || chr(10) || 'end' AS content FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t, role, 'id' || t, text FROM v WHERE role = 'user'"
)
def text_messages(spark, sf):
    """Flat messages of logged turns: text blocks in a row, a message without an id by its type and entry."""
    rows = turn_lines(spark, sf, "/logs/projects/p/c")
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    head = [F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.concat(F.lit("u"), "t").alias("uuid")]
    own = logged(rows.where("role = 'assistant'"), F.struct(*head, F.struct(F.array(block("text", F.col("text")), block("thinking", F.lit("no")), block("text", F.lit("end"))).alias("content")).alias("message")))
    said = logged(rows.where("role = 'user'"), F.struct(*head, F.struct(F.concat(F.lit("id"), "t").alias("id"), F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
    return messages.messages(claude.entries(own.union(said))).select("session_id", "seq", "role", "message_id", "content")


@query(
    f"WITH {TURN_SQL} SELECT 'wf_' || s AS session_id, 4 * t AS seq, 'a' || t AS agent_id, CASE role WHEN 'user' THEN 'workflow agent a' || t || ' started (key k)' ELSE 'workflow agent a' || t || ' result (key k)' || chr(10) || '{{\"n\":' || n || '}}' END AS text FROM v WHERE role <> 'system'".replace("{{", "{").replace("}}", "}")
)
def journal_entries(spark, sf):
    """Turns as journal events: starts and results; other events go."""
    rows = turn_lines(spark, sf, "/runs/").withColumn("file_path", F.concat(F.lit("/runs/wf_c"), "conv_id", F.lit("/journal.jsonl")))
    kind = F.when(F.col("role") == "user", "started").when(F.col("role") == "assistant", "result").otherwise("other")
    record = F.struct(kind.alias("type"), F.concat(F.lit("a"), "t").alias("agentId"), F.lit("k").alias("key"), F.when(F.col("role") != "user", F.struct("n")).alias("result"))
    return workflow.entries(logged(rows, record)).select("session_id", "seq", "agent_id", F.col("parts")[0]["text"].alias("text"))


@query(
    f"WITH {TURN_SQL}, q AS (SELECT v.*, (SELECT count(*) FROM v x WHERE x.s = v.s AND x.t < v.t) AS i FROM v), h AS (SELECT * FROM q WHERE i < 3), "
    "j AS (SELECT s, 'p' || (n // 100) AS plan, 'j' || (n // 10) || '.md' AS job, min(i) AS i FROM h WHERE role = 'user' GROUP BY ALL) "
    "SELECT s AS session_id, arg_min('/w/' || role, i) FILTER (i > 0) AS cwd, epoch_us(min(TIMESTAMP '2024-01-01' + t * INTERVAL 1 MINUTE)) AS first_us, "
    "coalesce((SELECT string_agg(plan || '/' || job || '@' || j.i, ',' ORDER BY j.i) FROM j WHERE j.s = h.s), '') AS jobs FROM h GROUP BY s"
)
def header_facts(spark, sf):
    """Conversations written as logs, of which the first three lines are read and no more: where they ran, when, and their jobs."""
    folder = shared_folder(spark, "heads")
    rows = turn_lines(spark, sf, "")
    told = F.concat(F.lit("Read the file /x/plans/p"), F.floor(F.col("n") / 100), F.lit("/j"), F.floor(F.col("n") / 10), F.lit(".md and execute the agent job"))
    record = F.struct(
        F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.when(F.col("t") > 0, F.concat(F.lit("/w/"), "role")).alias("cwd"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct("role", F.when(F.col("role") == "user", told).otherwise(F.col("text")).alias("content")).alias("message"),
    )
    write_logs(rows.select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("path"), "line_no", F.to_json(record).alias("line")), folder)
    found = catalog.header_facts(claude.header_lines(jsonl.head_lines(spark, folder, 3)))
    jobs = F.coalesce(F.array_join(F.transform("jobs", lambda j: F.concat(j["plan"], F.lit("/"), j["job"], F.lit("@"), j["line_index"])), ","), F.lit(""))
    return found.select("session_id", "cwd", F.unix_micros("ts").alias("first_us"), jobs.alias("jobs"))


@query(
    f"WITH {TURN_SQL}, r AS (SELECT s, t - 1 AS t, n > 300 AS bad FROM v WHERE role = 'user') "
    "SELECT s AS session_id, 4 * t AS seq, 0::BIGINT AS sub_seq, 1 AS level, 'prompt' AS kind, 'Ask ' || n AS title, NULL AS status FROM v WHERE role = 'user' AND (n > 100 OR NOT EXISTS (SELECT 1 FROM v c WHERE c.s = v.s AND c.t = v.t - 1 AND c.role = 'assistant')) "
    "UNION ALL SELECT s, 4 * t, 0, 1, 'assistant', CASE WHEN n < 1000 THEN 'We look at ' || n || '.' ELSE 'Plan' END, NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t, 1, 2, 'heading', 'Plan', NULL FROM v WHERE role = 'assistant' UNION ALL SELECT s, 4 * t, 2, 3, 'heading', 'Step', NULL FROM v WHERE role = 'assistant' "
    "UNION ALL SELECT v.s, 4 * v.t, 1000002, 1, 'tool', 'Run(make ' || n || ')', CASE WHEN bad THEN 'failed' WHEN bad IS NULL THEN 'running' ELSE 'completed' END FROM v LEFT JOIN r USING (s, t) WHERE role = 'assistant' "
    "UNION ALL SELECT s, 4 * t, 2000000, 1, 'reasoning', 'hm', NULL FROM v WHERE role = 'assistant'"
)
def outline_items(spark, sf):
    """Outlines of logged turns: prose before headings, headings outside code fences, calls with the state of their later results. A
    short user turn after an assistant's brings its call's result only and has no row."""
    rows = turn_lines(spark, sf, "/logs/projects/p/c")
    kinds = {"type": "string", "text": "string", "thinking": "string", "id": "string", "name": "string", "input": "struct<command: string>", "tool_use_id": "string", "content": "string", "is_error": "boolean"}
    block = lambda **f: F.struct(*[f.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    prose = F.when(F.col("n") < 1000, F.concat(F.lit("We look at "), F.col("n"), F.lit(".\n"))).otherwise("")
    text = F.concat(F.lit("# Plan\n```\nno prose\n# no heading\n```\n"), prose, F.lit("## Step"))
    own = F.array(block(type=F.lit("thinking"), thinking=F.lit("hm")), block(type=F.lit("text"), text=text), block(type=F.lit("tool_use"), id=F.concat(F.lit("c"), "t"), name=F.lit("run"), input=F.struct(F.concat(F.lit("make "), F.col("n")).alias("command"))))
    before = F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("t")) == "assistant", F.lit(False))
    result = block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("c"), F.col("t") - 1), content=F.lit("x"), is_error=F.col("n") > 300)
    ask = block(type=F.lit("text"), text=F.concat(F.lit("Ask "), F.col("n")))
    rows = rows.withColumn("after", before)
    content = F.when(F.col("role") == "assistant", own).when(F.col("after") & (F.col("n") <= 100), F.array(result)).when(F.col("after"), F.array(result, ask)).otherwise(F.array(ask))
    record = F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.struct("role", content.alias("content")).alias("message"))
    return outline.outline(claude.entries(logged(rows, record)))


@query(
    "WITH s AS (SELECT 's' || o_orderkey AS session_id, CASE WHEN o_orderstatus = 'F' THEN '/p/' || o_orderkey END AS path, o_orderdate AS began, 'plan' || o_custkey AS plan FROM orders), "
    "w AS (SELECT path AS spec, 0 AS way, * FROM s WHERE path IS NOT NULL UNION ALL SELECT session_id, 1, * FROM s UNION ALL SELECT plan || '/j.md', 2, * FROM s UNION ALL SELECT '/w/plans/' || plan || '/j.md', 3, * FROM s) "
    "SELECT spec, session_id, way FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY way, path IS NULL, began DESC, session_id) AS n FROM w) WHERE n = 1"
)
def resolved_specs(spark, sf):
    """Orders as sessions of their customer's job: every path, id, plan/job and job file resolved to one, those with a path first, then the newest."""
    job = F.concat(F.lit("plan"), "o_custkey")
    sessions = table(spark, sf, "orders").select(
        F.concat(F.lit("s"), "o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/p/"), "o_orderkey")).alias("path"), F.col("o_orderdate").alias("started_at"),
        F.array(F.struct(job.alias("plan"), F.lit("j.md").alias("job"), F.lit(0).cast("long").alias("line_index"))).alias("jobs"),
    )
    plan = F.col("jobs")[0]["plan"]
    specs = sessions.select(F.explode(F.array("path", "session_id", F.concat(plan, F.lit("/j.md")), F.concat(F.lit("/w/plans/"), plan, F.lit("/j.md")))).alias("spec")).where("spec is not null")
    return catalog.resolve(specs, sessions).select("spec", "session_id", "way")


@query("SELECT c_custkey AS session_id FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), 'build') OR contains(lower('plan' || c_nationkey || ' job-' || c_custkey), 'n1 job-1')")
def session_search(spark, sf):
    """Customers as sessions: two searches whatever the case, over project, worktree and jobs."""
    jobs = F.array(F.struct(F.concat(F.lit("PLAN"), "c_nationkey", F.lit(" job-"), "c_custkey").alias("plan"), F.lit("x.md").alias("job"), F.lit(0).cast("long").alias("line_index")))
    sessions = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("project"), F.col("c_name").alias("worktree"), jobs.alias("jobs"))
    return catalog.search(sessions, "Build").union(catalog.search(sessions, "N1 Job-1")).select("session_id").distinct()


@query(f"WITH {ENTRIES_SQL} SELECT '/logs/' || session_id || '.jsonl' AS file_path, count(*) AS messages, sum(input)::BIGINT AS input, sum(cache_read)::BIGINT AS cache_read, sum(output)::BIGINT AS output, arg_max(input, arrival) AS last_input, arg_max(output, arrival) AS last_output FROM e GROUP BY session_id")
def rollout_stats(spark, sf):
    """Every session as a log of cumulative counts: the last totals of each file, and the last turn's own figures."""
    so_far = Window.partitionBy("session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entries(spark, sf).withColumns({"file_path": F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")), "line_no": F.col("arrival"), **{f"all_{c}": F.sum(c).over(so_far) for c in ("input", "output", "cache_read")}})
    counts = lambda i, o, c: F.struct((F.col(i) + F.col(c)).alias("input_tokens"), F.col(c).alias("cached_input_tokens"), F.col(o).alias("output_tokens"))
    info = F.struct(counts("all_input", "all_output", "all_cache_read").alias("total_token_usage"), counts("input", "output", "cache_read").alias("last_token_usage"))
    lines = logged(rows, F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    found = rollup.cumulative_stats(codex_log.token_counts(lines))
    return found.select("file_path", "messages", "total.input", "total.cache_read", "total.output", F.col("latest.input").alias("last_input"), F.col("latest.output").alias("last_output"))


@query(
    f"WITH RECURSIVE {ARM_SQL} SELECT session_id, leaf_id, CASE WHEN n > 280 THEN turn END::INT AS replicate, CASE WHEN n > 280 THEN 'p' || (n // 100) END AS plan, CASE WHEN n IS NULL THEN 'unattributed' WHEN n <= 280 THEN 'no replicate' END AS reason "
    "FROM arm LEFT JOIN stamp USING (session_id, leaf_id)"
)
def arm_records(spark, sf):
    """The record of each attributed arm with a replicate, and the others with the reason why they have none."""
    found, _ = arm_plans.lift_arms(experiment_lines(spark, sf), all_branches=True)
    good, skipped = arms.arm_partials(found)
    good = good.select("key.session_id", "key.leaf_id", "key.replicate", F.col("config.components")["plan"].alias("plan"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(skipped.select("session_id", "leaf_id", F.lit(None).cast("int").alias("replicate"), F.lit(None).cast("string").alias("plan"), "reason"))
