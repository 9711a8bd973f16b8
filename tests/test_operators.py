"""Usage, blocks, trees, arms, expressions and streams on small inputs with known results."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from transcript_lake.functions import text, usage
from transcript_lake.operators import arms, blocks, catalog, metrics, outline, pricing, rollup, tree
from transcript_lake.operators.dedup import dedup
from transcript_lake.plans.queries import ORACLES, QUERIES
from transcript_lake.sources.jsonl import PART

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    if name in ORACLES:
        assert rows == sorted(duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall(), key=repr)
    else:
        assert rows


def fold(rows):
    """Dedup as a fold over rows in order."""
    out, at, first = [], {}, {}
    for r in rows:
        m, q, side, total = r[:4]
        if not m:
            out.append(r)
            continue
        k = at.get((m, q))
        if k is None:
            k = first.get(m) if (side and m in first) else next((at[x] for x in at if x[0] == m and out[at[x]][2]), None)
        if k is None:
            at[(m, q)] = len(out)
            first.setdefault(m, len(out))
            out.append(r)
        else:
            old = out[k]
            if (side, -total) < (old[2], -old[3]):
                out[k] = r
            at.setdefault((m, q), k)
    return out


def test_dedup_cases(spark):
    schema = "message_id string, request_id string, is_sidechain boolean, input long, output long, cache_read long, cache_write_5m long, cache_write_1h long, reasoning long, arrival long"
    make = lambda rows: spark.createDataFrame([(m, q, s, n, 0, 0, 0, 0, 0, i) for i, (m, q, s, n) in enumerate(rows)], schema)
    kept = lambda rows: sorted(r.arrival for r in dedup(make(rows).repartition(3)).collect())
    assert kept([("m1", "r1", False, 1), ("m1", "r1", False, 1), ("m2", "r2", False, 1)]) == [0, 2]
    assert kept([("m1", "r1", False, 1), ("m1", "r2", False, 1)]) == [0, 1]
    assert kept([("m1", "r1", False, 1), ("m1", "r2", True, 9)]) == [0]
    assert kept([("m1", "r1", True, 9), ("m1", "r2", False, 1)]) == [1]
    assert kept([("m1", "r1", False, 1), ("m1", "r1", False, 5), ("", "r", False, 1), ("", "r", False, 1)]) == [1, 2, 3]


@pytest.mark.parametrize(("stamps", "want"), [(["01:10", "02:30", "03:00"], [(1, 3, False)]), (["01:00", "03:00", "06:01"], [(1, 2, False), (6, 1, False)]), (["01:00", "07:00"], [(1, 1, False), (6, 0, True), (7, 1, False)])])
def test_blocks(spark, stamps, want):
    rows = [(datetime.fromisoformat(f"2025-01-01T{s}:00"), 10) for s in stamps]
    df = spark.createDataFrame(rows, "ts timestamp, input long").selectExpr("ts", "input", *[f"0L as {c}" for c in usage.CLASSES if c != "input"], "'m' as model")
    got = sorted((r.start_ts.hour, r.entries, r.is_gap) for r in blocks.usage_blocks(df).collect())
    assert got == want


def test_blocks_follow_the_fold(spark):
    rng = random.Random(1)
    rows, at = [], {k: datetime(2025, 1, 1) for k in "abcd"}
    for _ in range(600):
        k = rng.choice("abcd")
        at[k] += timedelta(minutes=rng.choice([1, 20, 60, 120, 300, 301, 500]))
        rows.append((k, at[k], rng.randrange(100)))
    df = spark.createDataFrame(rows, "k string, ts timestamp, input long").selectExpr("*", *[f"0L as {c}" for c in usage.CLASSES if c != "input"], "'m' as model")
    for minutes in (20, 59, 60, 90, 150, 300):
        got = blocks.usage_blocks(df, ["k"], minutes / 60).collect()
        assert sorted((r.k, r.start_ts, r.end_ts, r.first_ts, r.last_ts, r.entries, r.total_tokens, r.is_gap) for r in got if not r.is_gap) == folded(rows, timedelta(minutes=minutes))[0]
        assert sorted((r.k, r.start_ts, r.end_ts) for r in got if r.is_gap) == folded(rows, timedelta(minutes=minutes))[1]


def folded(rows, span):
    """Blocks and gaps by a walk over all rows; those of one instant stay together."""
    found, gaps = [], []
    for k in sorted({r[0] for r in rows}):
        start = None
        for _, ts, tokens in sorted(r for r in rows if r[0] == k):
            gap = start is not None and ts - last > span
            if start is None or gap or (ts - start > span and ts != last):
                if gap:
                    gaps.append((k, last + span, ts))
                start = ts.replace(minute=0, second=0, microsecond=0)
                found.append([k, start, start + span, ts, ts, 0, 0, False])
            last = ts
            found[-1][4] = ts
            found[-1][5] += 1
            found[-1][6] += tokens
    return sorted(map(tuple, found)), sorted(gaps)


def test_blocks_at_the_edges(spark):
    """Times at full hours and at the very end of a span, with a null scope, and none at all."""
    base, rng = datetime(2025, 3, 1), random.Random(7)
    times = [base + timedelta(hours=rng.randrange(60), minutes=rng.choice([0, 0, 29, 30, 31]), microseconds=rng.choice([0, 0, 1])) for _ in range(120)]
    rows = [("x", t, 1) for t in times]
    df = spark.createDataFrame([(None, t, n) for _, t, n in rows], "k string, ts timestamp, input long").selectExpr("*", *[f"0L as {c}" for c in usage.CLASSES if c != "input"], "'m' as model")
    for minutes in (30, 60, 90, 300):
        for scope in ([], ["k"]):
            got = blocks.usage_blocks(df, scope, minutes / 60).where("not is_gap").collect()
            assert sorted(("x", r.start_ts, r.end_ts, r.first_ts, r.last_ts, r.entries, r.total_tokens, False) for r in got) == folded(rows, timedelta(minutes=minutes))[0]
    assert blocks.usage_blocks(df.limit(0), ["k"]).count() == blocks.usage_blocks(df.limit(0), hours=0.5).count() == 0


def test_burn_and_projection(spark):
    t = datetime(2025, 1, 1, 1)
    df = spark.createDataFrame([(t, 600, 0.1), (t + timedelta(minutes=10), 600, 0.1)], "ts timestamp, input long, cost double").selectExpr("*", *[f"0L as {c}" for c in usage.CLASSES if c != "input"], "'m' as model")
    r = blocks.block_report(df, now=t + timedelta(minutes=10), limit=30_000).first()
    assert (r.tokens_per_minute, round(r.cost_per_hour, 9), r.projected_tokens, r.remaining_minutes, r.limit_status) == (120.0, 1.2, 36_000, 290, "exceeds")
    status = lambda c, p, n: spark.range(1).select(usage.limit_status(F.lit(c), F.lit(p), n)).first()[0]
    assert [status(0, 500, 1000), status(0, 850, 1000), status(0, 1200, 1000), status(900, 0, 1000), status(9, 9, 0)] == ["ok", "warning", "exceeds", "warning", "ok"]


def test_pricing(spark):
    keys = ["claude-opus-4-5", "claude-opus-4", "claude-haiku-4-5-20251001", "claude-opus-4-1-20250805", "claude-sonnet-4-5", "claude-opus-5"]
    table = pricing.pricing_table(spark.createDataFrame([(k, "", 5.0, 25.0, None, None) for k in keys] + [("zz", "claude-opus-4", 9.0, 9.0, None, None), ("none", None, None, 1.0, None, None)], "map_key string, id string, input double, output double, cache_write double, cache_read double"))
    rate = table.where("model_key = 'claude-opus-4'").first()
    assert (rate.input, round(rate.cache_write, 12), round(rate.cache_read, 12), table.count()) == (5e-6, 6.25e-6, 5e-7, 6)
    models = ["claude-opus-4-5-20251101", "claude-opus-4-8", "claude-opus-4", "claude-haiku-4-5-20251001", "claude-opus-5[1m]", "anthropic/claude-sonnet-4.5", "claude-opus-4@20250101", "nothing", "xclaude-opus-5"]
    got = dict(map(tuple, pricing.resolve_models(spark.createDataFrame([(m,) for m in models], "model string"), table).collect()))
    assert got == {"claude-opus-4-5-20251101": "claude-opus-4-5", "claude-opus-4": "claude-opus-4", "claude-haiku-4-5-20251001": "claude-haiku-4-5-20251001", "claude-opus-5[1m]": "claude-opus-5", "anthropic/claude-sonnet-4.5": "claude-sonnet-4-5", "claude-opus-4@20250101": "claude-opus-4"}
    entries = spark.createDataFrame([("claude-opus-4", 10, None), ("claude-opus-4", 10, 0.0), ("nothing", 10, None), ("nothing", 0, None)], "model string, input long, native_cost double").selectExpr("*", *[f"0L as {c}" for c in usage.CLASSES if c != "input"])
    assert sorted((r.cost, r.missing_model) for r in pricing.with_cost(entries, table).where("input > 0").fillna("").collect()) == [(0.0, ""), (0.0, "nothing"), (5e-5, "")]
    assert pricing.with_cost(entries, table, "display").agg(F.sum("cost")).first()[0] == 0
    with pytest.raises(ValueError):
        pricing.with_cost(entries, table, "other")
    with pytest.raises(ValueError):
        rollup.only_providers(entries, ["nobody"])


def test_churn(spark):
    cases = [("a\nb\nc", "a\nx\nc", (1, 1)), ("keep", "keep\none\ntwo", (2, 0)), ("keep\none\ntwo", "keep", (0, 2)), ("", "", (0, 0)), ("x", "x", (0, 0)), (None, "a\n", (1, 0)), ("a\na", "a", (0, 1)), ("two\nthree", "dos", (1, 2))]
    df = spark.createDataFrame([(o, n) for o, n, _ in cases], "o string, n string").coalesce(1)
    assert [tuple(r[0]) for r in df.select(text.line_churn(F.col("o"), F.col("n"))).collect()] == [w for _, _, w in cases]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.clean_path(F.lit("/a//b/./c/../d"))) == "/a/b/d"
    assert one(text.bundle_path(F.lit("/repo/x/../y.md"), F.lit("/repo/"))) == "y.md"
    assert one(text.same_model(F.lit("a/m"), F.lit("m")))
    assert tuple(one(text.plan_job(F.lit("Read the file /w/plans/p1/02-go.md and execute the agent job now")))) == ("p1", "02-go.md")
    none = F.array().cast("array<string>")
    assert one(text.prose_summary(F.lit("# Top\n```\ncode here\n```\nfunc main\n/path\n---\nProse comes.\nmore"), none)) == "Prose comes."
    assert one(text.prose_summary(F.lit("## Only a heading"), F.array(F.lit("Only a heading")))) == "Only a heading"
    assert one(text.first_line(F.lit("\n  ## Title\nx"))) == "Title"
    assert tuple(one(text.briefing(F.lit("see '/w/plans/p1/.artifacts/job-1/briefing-12.xml'")))) == ("/w/plans/p1", "p1", "job-1")
    assert [tuple(one(text.session_parts(F.lit(p)))) for p in ("/h/projects/a/s.jsonl", "/h/projects/a/s/subagents/x.jsonl", "/h/projects/a/s/subagents/workflows/wf_1/x.jsonl")] == [("s", "a"), ("s", "a"), ("wf_1", "a/s/subagents/workflows")]
    assert [one(text.tool_summary(F.lit("bash"), F.parse_json(F.lit(j)))) for j in ('{"command": " ls  -l "}', '{"command": ["bash", "-lc", "make"]}', '{"query": "%s"}' % ("q" * 50), "{}")] == ["Bash(ls -l)", "Bash(make)", "Bash(%s...)" % ("q" * 37), "Bash"]
    assert one(text.folder_for_tree(F.lit("/Users/foo/bar"))) == "--Users-foo-bar--" and one(text.folder_for_chat(F.lit("/a/.b"))) == "-a--b"
    assert one(text.tree_session_id(F.lit("/x/2025_a_b.jsonl"))) == "a_b"
    assert one(text.rollout_session_id(F.lit("/x/rollout-1-0a0a0a0a-0a0a-0a0a-0a0a-0a0a0a0a0a0a.jsonl"))) == "0a0a0a0a-0a0a-0a0a-0a0a-0a0a0a0a0a0a"
    assert one(text.provider_of(F.lit("/home/x/.codex/sessions/a.jsonl"))) == "codex"
    assert one(text.config_hash(F.lit("m"), F.lit(""), F.lit(None).cast("string"), F.create_map(F.lit("b"), F.lit("<1>"), F.lit("a"), F.lit("2")))) == one(F.sha2(F.lit('{"model":"m","components":{"a":"2","b":"\\u003c1\\u003e"}}'), 256))


def nodes(spark, *edges):
    return tree.tree_nodes(spark.createDataFrame([("s", i, "message", a, b) for i, (a, b) in enumerate(edges)], "session_id string, seq long, type string, id string, parent_id string"))


def test_trees(spark):
    n = nodes(spark, ("a1", None), ("a2", "a1"), ("b3", "a2"), ("b4", "b3"), ("c3", "a2"), ("c4", "c3"))
    b = tree.branches(n)
    paths = {(r.leaf_id, r.is_active): [] for r in b.collect()}
    for r in b.orderBy("pos").collect():
        paths[r.leaf_id, r.is_active].append(r.id)
    assert paths == {("b4", False): ["a1", "a2", "b3", "b4"], ("c4", True): ["a1", "a2", "c3", "c4"]}
    assert {r.fork_id for r in tree.forks(b, n).collect()} == {"a2"}
    cycle = nodes(spark, ("e1", "e2"), ("e2", "e1"))
    assert [r.id for r in tree.branches(cycle).orderBy("pos").collect()] == ["e1", "e2"]
    orphan = tree.with_roots(nodes(spark, ("a", "gone"), ("b", "a")))
    assert {(r.id, r.is_root, r.is_orphan) for r in orphan.collect()} == {("a", True, True), ("b", False, False)}
    deep = nodes(spark, *[(f"n{i}", f"n{i - 1}" if i else None) for i in range(400)])
    assert tree.branches(deep).count() == 400


def test_arms(spark):
    stamp = lambda kind, data, pos: ("s", "leaf", pos, f"e{pos}", kind, data)
    rows = [
        stamp("experiment_config", '{"config": {"model": "p/m", "components": {"context": "c0"}}}', 0),
        stamp("experiment_config", '{"config": {"model": "p/m", "provider": "p", "components": {"context": "c1", "plan": ""}}, "config_hash": "bad", "replicate": 0, "bundle_files": []}', 1),
        stamp("experiment_metric", '{"metrics": {"context.off_bundle_reads": 2, "Bad": 1, "a.b.c": 1}, "turns": 4}', 2),
        stamp("experiment_metric", '{"metrics": {"context.off_bundle_reads": 3}}', 3),
        stamp("experiment_metric", "{torn", 4),
        ("s2", "leaf", 0, "e0", "experiment_config", '{"context": "old", "job_id": "j", "x_version": "1", "plan": "", "replicate": 1}'),
    ]
    custom = spark.createDataFrame(rows, "session_id string, leaf_id string, pos long, id string, custom_type string, data_json string")
    stamps = arms.config_stamps(custom)
    got = {r.session_id: r for r in stamps.collect()}
    assert (got["s"].components, got["s"].replicate, got["s"].bundle_files, got["s"].is_legacy) == ({"context": "c1", "plan": ""}, 0, [], False)
    assert (got["s2"].components, got["s2"].is_legacy, got["s2"].job_id, got["s2"].bundle_files) == ({"context": "old"}, True, "j", None)
    marks = arms.metric_stamps(custom).first()
    assert (marks.component_metrics, marks.turns) == ({"context.off_bundle_reads": 3.0}, 4)
    models = spark.createDataFrame([("s", "leaf", ["m", "other"]), ("s2", "leaf", ["x/m"])], "session_id string, leaf_id string, models array<string>")
    squeezed = spark.createDataFrame([("s2", "leaf", True)], "session_id string, leaf_id string, compacted boolean")
    codes = sorted((r.session_id, r.code) for r in arms.arm_warnings(custom, stamps, models, squeezed).collect())
    assert codes == [("s", "bad_metric_key"), ("s", "bad_metric_key"), ("s", "config_hash_mismatch"), ("s", "malformed_entry"), ("s", "model_disagreement"), ("s2", "compacted_arm"), ("s2", "legacy_config_shape")]
    branches = spark.createDataFrame([("s", "leaf", True), ("s2", "leaf", True), ("s3", "leaf", True)], "session_id string, leaf_id string, is_active boolean")
    cost = spark.createDataFrame([("s", "leaf", 5)], "session_id string, leaf_id string, input long")
    process = spark.createDataFrame([("s", "leaf", 7, 2), ("s2", "leaf", 1, 3)], "session_id string, leaf_id string, tool_calls long, turns long")
    table = arms.arm_table(branches, stamps, arms.metric_stamps(custom), cost, process, squeezed, arms.arm_warnings(custom, stamps, models, squeezed))
    groups = {r.value: r for r in arms.by_component(table, "context").collect()}
    assert set(groups) == {"c1", "old"} and groups["c1"].turns.mean == 4 and groups["old"].compacted == 1
    assert tuple(arms.counted_out(table, "plan").first()) == (1, 1)
    assert arms.component_metrics(table, "context").first().summary.mean == 3
    good, skipped = arms.arm_partials(table)
    assert good.count() == 1 and {r.reason for r in skipped.collect()} == {"unattributed", "no replicate"}
    with pytest.raises(ValueError):
        arms.by_component(table, "weather")


def test_off_bundle(spark):
    reads = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "session_id string, path string")
    manifests = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None)], "session_id string, manifest array<string>")
    assert {r.session_id: r.off_bundle_reads for r in metrics.off_bundle_reads(reads, manifests).collect()} == {"a": 1.0, "b": 1.0, "c": None}


def test_outline(spark):
    p = lambda t, **k: (t, k.get("text"), k.get("call"), k.get("name"), None, None, k.get("out"), None, None, k.get("err"))
    schema = f"session_id string, seq long, role string, custom_type string, parts array<{PART.replace('input: variant', 'input: string')}>"
    rows = [("s", 0, "user", None, [p("text", text="Do it")]), ("s", 1, "assistant", None, [p("reasoning", text="hm"), p("text", text="# Plan\nFirst we look.\n## Step"), p("tool_call", call="t", name="Read")]), ("s", 2, "user", None, [p("tool_result", call="t", out="x", err=True)]), ("s", 3, "user", "note", [p("text", text="fyi")])]
    entries = spark.createDataFrame(rows, schema).withColumn("parts", F.transform("parts", lambda x: x.withField("input", F.try_parse_json(x["input"]))))
    items = outline.with_folds(outline.outline(entries)).orderBy("seq", "sub_seq").collect()
    assert [(i.kind, i.title, i.level, i.status) for i in items] == [("prompt", "Do it", 1, None), ("assistant", "First we look.", 1, None), ("heading", "Plan", 2, None), ("heading", "Step", 3, None), ("tool", "Read", 1, "failed"), ("reasoning", "hm", 1, None), ("notice", "fyi", 1, None)]
    assert [i.descendants for i in items] == [0, 2, 1, 0, 0, 0, 0] and [i.has_kids for i in items][1]
    assert [r.activity for r in outline.activity_label(entries).orderBy("seq").collect()] == ["reading input", "tool: Read", "processing tool result", "reading input"]


def test_catalogue(spark):
    jobs = "array<struct<plan: string, job: string, line_index: long>>"
    sessions = spark.createDataFrame([("s1", "/p/one", datetime(2025, 1, 1), [("plan", "a.md", 0)], "proj", None), ("s2", None, datetime(2025, 1, 3), [("plan", "a.md", 0)], "Other", None), ("s3", "/p/three", datetime(2025, 1, 2), [("plan", "a.md", 5)], "x", "tree")], f"session_id string, path string, started_at timestamp, jobs {jobs}, project string, worktree string")
    specs = spark.createDataFrame([("/p/one",), ("s2",), ("plan/a.md",), ("/w/plans/plan/a.md",), ("nothing",)], "spec string")
    assert {r.spec: r.session_id for r in catalog.resolve(specs, sessions).collect()} == {"/p/one": "s1", "s2": "s2", "plan/a.md": "s3", "/w/plans/plan/a.md": "s3"}
    assert {r.session_id for r in catalog.search(sessions, "OTHER").collect()} == {"s2"} and catalog.search(sessions, "A.MD").count() == 3
    lines = spark.createDataFrame([("f", 0, None, None, None, "x"), ("f", 1, "/w", "s", datetime(2025, 1, 1), "Read the file /w/plans/p/j.md and execute the agent job"), ("f", 150, "/z", "t", None, "y")], "file_path string, line_no long, cwd string, session_id string, ts timestamp, text string")
    r = catalog.header_facts(lines).first()
    assert (r.cwd, r.session_id, [tuple(j) for j in r.jobs]) == ("/w", "s", [("p", "j.md", 1)])
    assert catalog.job_files(spark.createDataFrame([("/d/a.md", "---\nid: j1\n---"), ("/d/b.md", "x")], "file_path string, text string")).first().job_id == "j1"
