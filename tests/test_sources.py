"""Small logs of each runtime."""

import json

from pyspark.sql import functions as F

from transcript_lake.operators import arms, catalog, metrics, rollup, tree
from transcript_lake.operators.dedup import dedup
from transcript_lake.plans import arms as plan
from transcript_lake.sources import claude, codex, jsonl, opencode, pi, registry, workflow


def said(i, role="assistant", usage=None, content="hi", **more):
    message = {"id": f"m{i}", "role": role, "model": "claude-opus-4-5", "content": content}
    if usage:
        message["usage"] = {"input_tokens": usage[0], "output_tokens": usage[1], **(usage[2] if len(usage) > 2 else {})}
    return {"type": role, "sessionId": "S", "uuid": f"u{i}", "requestId": f"r{i}", "timestamp": f"2025-01-01T00:00:{i:02d}Z", "message": message, **more}


def test_claude_usage(spark, put, tmp_path):
    put("projects/-repo/S.jsonl", said(1, usage=(1000, 100)), "", "{torn", said(1, usage=(1000, 100)), "[1]")
    put("projects/-repo/agent-a1.jsonl", said(2, usage=(2000, 200)))
    put("projects/-repo/S/subagents/workflows/wf_1/agent-w.jsonl", said(3, usage=(3000, 300, {"cache_creation_input_tokens": 7, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 3}})))
    put("projects/-repo/S/subagents/workflows/wf_1/journal.jsonl", said(9, usage=(1, 1)))
    lines = jsonl.chat_lines(spark, str(tmp_path))
    rows = dedup(jsonl.arrival(claude.usage_entries(lines)))
    total = rollup.usage_totals(rows).first()
    assert (total.input, total.output, total.messages, total.cache_write_5m, total.cache_write_1h) == (6000, 600, 3, 4, 3)
    assert {(r.session_id, r.project, r.agent_id) for r in rows.collect()} == {("S", "-repo", None), ("agent-a1", "-repo", "a1"), ("wf_1", "-repo/S/subagents/workflows", "w")}
    assert [tuple(r)[1] for r in jsonl.rejected_lines(lines).collect()] == [2]
    inner = catalog.inner_session_ids(lines.withColumn("session_id", F.get_json_object("line", "$.sessionId")))
    assert {r.parent_session_id for r in inner.collect()} == {"S"}
    whole = rollup.by_inner_session(rows, inner)
    assert [(r.session_id, r.project, r.input, r.messages) for r in rollup.session_usage(whole).collect()] == [("S", "-repo", 6000, 3)]
    per_file = rollup.transcript_totals(jsonl.arrival(claude.usage_entries(lines)))
    assert sorted(r.input for r in per_file.collect()) == [1000, 2000, 3000]
    stats = rollup.token_stats(claude.usage_entries(lines)).where("messages = 2").first()
    assert (stats.input_tokens, stats.output_tokens) == (2000, 200)


def test_claude_process_metrics(spark, put, tmp_path):
    use = lambda i, name, given: {"type": "tool_use", "id": f"t{i}", "name": name, "input": given}
    put(
        "projects/-repo/S.jsonl",
        said(0, "user", content="please"),
        said(1, content=[{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, use(1, "Edit", {"file_path": "/repo/a.go", "old_string": "a\nb\nc", "new_string": "a\nx\nc"})]),
        said(2, "user", content=[{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]),
        said(3, content=[use(2, "Read", {"file_path": "/repo/b.go"}), use(3, "MultiEdit", {"file_path": "/repo/c.go", "edits": [{"old_string": "one", "new_string": "uno"}, {"old_string": "two\nthree", "new_string": "dos"}]})]),
        said(4, content=[use(4, "Read", {"file_path": "/elsewhere"})], isSidechain=True),
        said(20, "user", content="  "),
    )
    entries = claude.entries(jsonl.raw_lines(spark, str(tmp_path)))
    m = metrics.process_metrics(entries).first()
    assert (m.tool_calls, m.distinct_tools, m.turns, m.wall_seconds) == (3, 3, 1, 20.0)
    assert (m.touched, m.edited, m.added, m.removed) == (["/repo/a.go", "/repo/b.go", "/repo/c.go"], ["/repo/a.go", "/repo/c.go"], 3, 4)
    merged = claude.merged_results(entries)
    call = merged.where("seq = 1").first().parts[2]
    assert (call.output, call.status, merged.where("seq = 2").count()) == ("done", "completed", 0)


def counts(total, cached, out, last=None):
    x = {"total_token_usage": {"input_tokens": total, "cached_input_tokens": cached, "output_tokens": out}}
    return {"timestamp": "2025-01-01T00:00:05Z", "type": "event_msg", "payload": {"type": "token_count", "info": {**x, "last_token_usage": last or {"input_tokens": 1, "cached_input_tokens": 0, "output_tokens": 1}}}}


def test_codex(spark, put, tmp_path):
    put(
        "sessions/2025/01/01/rollout-x.jsonl",
        {"timestamp": "2025-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "C", "cwd": "/repo"}},
        {"type": "turn_context", "payload": {"model": "gpt"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": "{\"command\": [\"ls\"]}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "{\"output\": \"no\", \"metadata\": {\"exit_code\": 2}}"}},
        counts(1200, 1000, 150),
        counts(3200, 2600, 450),
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "bye"}},
        counts(100, 0, 10, {"input_tokens": 60, "cached_input_tokens": 20, "output_tokens": 5}),
    )
    lines = jsonl.raw_lines(spark, str(tmp_path))
    rows = codex.usage_entries(lines).orderBy("line_no").collect()
    assert [(r.input, r.cache_read, r.output) for r in rows] == [(200, 1000, 150), (400, 1600, 300), (40, 20, 5)]
    assert {(r.session_id, r.project, r.model, r.message_id) for r in rows} == {("C", "/repo", "gpt", "")}
    entries = codex.entries(lines).orderBy("seq").collect()
    assert [(e.role, [p.type for p in e.parts]) for e in entries] == [("user", ["text"]), ("assistant", ["tool_call"]), ("assistant", ["tool_result"]), ("assistant", []), ("assistant", []), ("assistant", ["text"]), ("assistant", [])]
    assert entries[2].parts[0].is_error and entries[2].parts[0].output == "no"
    m = metrics.process_metrics(codex.entries(lines)).first()
    assert (m.tool_calls, m.turns, m.files_touched, m.unsupported) == (1, 1, None, ["files_touched", "files_edited"])


def test_pi(spark, put, tmp_path):
    usage = lambda n, cost: {"input": n, "output": 1, "cacheRead": 2, "cacheWrite": 3, "cost": {"total": cost}}
    put(
        "2025_P.jsonl",
        {"type": "session", "id": "P", "cwd": "/repo"},
        {"type": "message", "id": "a", "parentId": None, "message": {"role": "user", "content": "go"}},
        {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "model": "m", "content": [{"type": "toolCall", "id": "t", "name": "read", "arguments": {"path": "/repo/x"}}], "usage": usage(10, 0.5)}},
        {"type": "message", "id": "c", "parentId": "b", "message": {"role": "toolResult", "toolCallId": "t", "toolName": "read", "content": [{"type": "text", "text": "x"}]}},
        {"type": "custom_message", "id": "d", "parentId": "c", "customType": "note", "content": "shown"},
        {"type": "custom_message", "id": "e", "parentId": "c", "customType": "note", "content": "hidden", "display": False},
        "{torn",
        {"type": "message", "id": "f", "parentId": "a", "message": {"role": "assistant", "model": "m", "content": "other", "usage": usage(20, 0)}},
    )
    lines = jsonl.raw_lines(spark, str(tmp_path))
    rows = pi.usage_entries(lines).orderBy("line_no").collect()
    assert [(r.input, r.native_cost, r.session_id, r.project) for r in rows] == [(10, 0.5, "P", "/repo"), (20, 0.0, "P", "/repo")]
    entries = pi.entries(lines).orderBy("seq").collect()
    assert [(e.role, e.custom_type, [p.type for p in e.parts]) for e in entries] == [("user", None, ["text"]), ("assistant", None, ["tool_call"]), ("user", None, ["tool_result"]), ("user", "note", ["text"]), ("assistant", None, ["text"])]
    m = metrics.process_metrics(pi.entries(lines)).first()
    assert (m.files_touched, m.files_edited) == (1, 0)


def test_opencode(spark, tmp_path):
    def put(path, x):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(x if isinstance(x, str) else json.dumps(x))

    put("session/p/s.json", {"id": "O", "projectID": "proj", "directory": "", "title": "t", "time": {"created": 1000, "updated": 2000}})
    put("message/O/msg_1.json", {"id": "m1", "sessionID": "O", "role": "user", "time": {"created": 10}})
    put("message/O/msg_2.json", {"id": "m2", "sessionID": "O", "role": "assistant", "providerID": "a", "modelID": "b", "cost": 0, "time": {"created": 20}, "tokens": {"input": 130, "output": 100, "reasoning": 0, "cache": {"read": 550, "write": 70}}})
    put("message/O/msg_3.json", "{broken")
    put("part/m2/prt_2.json", {"id": "p2", "sessionID": "O", "messageID": "m2", "type": "tool", "callID": "c", "tool": "read", "state": {"status": "completed", "output": "x", "input": {"filePath": "/r"}}})
    put("part/m2/prt_1.json", {"id": "p1", "sessionID": "O", "messageID": "m2", "type": "text", "text": "hi"})
    put("part/m2/prt_3.json", {"id": "p3", "sessionID": "O", "messageID": "m2", "type": "patch", "hash": "0123456789", "files": ["a"]})
    put("part/m2/prt_4.json", {"id": "p4", "sessionID": "O", "messageID": "m2", "type": "step-start"})
    sessions, messages, parts = opencode.store(spark, str(tmp_path))
    r = opencode.usage_entries(sessions, messages).collect()
    assert [(x.model, x.input, x.output, x.cache_read, x.cache_write_5m, x.native_cost, x.project) for x in r] == [("a/b", 130, 100, 550, 70, None, "proj")]
    e = opencode.entries(messages, parts).collect()
    assert len(e) == 1 and [p.name or p.text for p in e[0].parts] == ["hi", "read", "patch"]
    m = metrics.process_metrics(opencode.entries(messages, parts)).first()
    assert (m.tool_calls, m.touched, m.unsupported) == (2, None, ["files_touched", "files_edited"])
    assert e[0].parts[2].title == "patch 01234567 (1 file)"


def test_workflow(spark, put, tmp_path):
    put("S/workflows/wf_7/journal.jsonl", {"type": "started", "agentId": "x"}, {"type": "result", "agentId": "x", "result": {"a": 1}}, {"type": "result", "agentId": "x", "result": "z" * 2_000_000}, {"type": "other"}, {"type": "started", "agentId": "y"})
    put("S/workflows/wf_7/agent-x.jsonl", said(1))
    put("S/workflows/wf_7/agent-z.jsonl", said(2))
    got = {r.agent_id: r for r in workflow.runs(jsonl.raw_lines(spark, str(tmp_path))).collect()}
    assert {k: (r.started, r.result is not None, r.transcript is not None) for k, r in got.items()} == {"x": (True, True, True), "y": (True, False, False), "z": (False, False, True)}
    assert len(json.loads(got["x"].result)) == 2_000_000
    assert workflow.entries(jsonl.raw_lines(spark, str(tmp_path))).count() == 4


def test_registry(spark, put, tmp_path):
    put("a/metadata.json", {"session_id": "s1", "claude_session_id": "n1", "attempt_id": "1", "started_at": "2025-01-01T00:00:00Z"})
    put("b/metadata.json", {"session_id": "s2", "claude_session_id": "n1", "attempt_id": "2", "started_at": "2025-01-01T00:00:00Z"})
    put("c/metadata.json", "{broken")
    put("b/t.jsonl", {"x": 1})
    rows = registry.registry(spark, str(tmp_path))
    assert [r.session_id for r in catalog.latest_attempts(rows).collect()] == ["s2"]
    assert [r.session_id for r in registry.archived(spark, str(tmp_path)).collect()] == ["s2"]


def test_arms_of_a_corpus(spark, put, tmp_path):
    usage = {"input": 10, "output": 1, "cacheRead": 0, "cacheWrite": 0, "cost": {"total": 0.25}}
    say = lambda i, p, **m: {"type": "message", "id": i, "parentId": p, "message": {"role": "assistant", "model": "m", "usage": usage, **m}}
    put(
        "x_P.jsonl",
        {"type": "session", "id": "P", "cwd": "/repo"},
        {"type": "custom", "id": "k", "parentId": None, "customType": "experiment_config", "data": {"config": {"model": "p/m", "components": {"context": "c1"}}, "replicate": 0, "bundle_files": ["a.md"]}},
        {"type": "message", "id": "u", "parentId": "k", "message": {"role": "user", "content": "go"}},
        say("b", "u", content=[{"type": "toolCall", "id": "t", "name": "read", "arguments": {"path": "/repo/b.md"}}, {"type": "toolCall", "id": "t2", "name": "read", "arguments": {"path": "/repo/x/../a.md"}}]),
        say("c", "u", content="other"),
        {"type": "custom", "id": "z", "parentId": "c", "customType": "experiment_metric", "data": {"metrics": {"context.hits": 2}}},
    )
    lines = jsonl.raw_lines(spark, str(tmp_path))
    table, warnings = plan.lift_arms(lines)
    arm = table.collect()
    assert [(r.leaf_id, r.input, r.cost, r.turns, r.tool_calls, r.component_metrics, r.models, r.replicate) for r in arm] == [("z", 10, 0.25, 1, 0, {"context.hits": 2.0}, ["m"], 0)]
    assert warnings.count() == 0
    both, _ = plan.lift_arms(lines, all_branches=True)
    assert {r.leaf_id: (r.tool_calls, r.component_metrics) for r in both.collect()} == {"b": (2, None), "z": (0, {"context.hits": 2.0})}
    group = arms.by_component(both, "context").first()
    assert (group.value, group.n, group.tool_calls.mean) == ("c1", 2, 1.0)
    nodes = tree.tree_nodes(pi.tree_rows(lines))
    found = tree.branches(nodes)
    custom = tree.custom_entries(found, nodes)
    reads = plan.bundle_reads(found, pi.entries(lines), arms.config_stamps(custom), spark.createDataFrame([("P", "/repo")], "session_id string, cwd string"))
    assert {r.leaf_id: r.off_bundle_reads for r in reads.collect()} == {"b": 1.0, "z": 0.0}
