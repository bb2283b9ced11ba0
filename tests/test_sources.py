import json

from pyspark.sql import functions as F

from spanforge.plans.rules import Condition, Match, Rule
from spanforge.sources import claude, codex, cursor, decision_log, jsonl
from spanforge.streaming import decisions


def write(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


def test_claude(spark, tmp_path):
    user = lambda u, c, **k: {"type": "user", "uuid": u, "sessionId": "S", "cwd": "/w", "timestamp": k.pop("ts", "t1"), "message": {"role": "user", "content": c}, **k}
    said = lambda u, c, **k: {"type": "assistant", "uuid": u, "timestamp": "t2", "message": {"role": "assistant", "model": "m", "content": c, "usage": {"input_tokens": 5.9, "output_tokens": -1, "cache_creation": {"ephemeral_5m_input_tokens": 2}}}, **k}
    use = lambda i: {"type": "tool_use", "id": i, "name": "Bash", "input": {"command": "ls"}}
    result = lambda i, c, **k: {"type": "tool_result", "tool_use_id": i, "content": c, **k}
    write(tmp_path / "p" / "one.jsonl", [
        said("a0", [{"type": "text", "text": "before"}]), "", user("u1", "do it"), "{bad", said("a1", [{"type": "text", "text": "x"}, use("T1"), {"type": "tool_use", "id": "", "name": "Bash"}]),
        user("u2", [result("T1", "first")]), user("u3", [result("T1", "second", is_error=True)]), user("side", "aside", isSidechain=True), said("a2", "plain"), said("", "n1"), said("", "n2"),
    ])
    write(tmp_path / "p" / "one" / "subagents" / "s.jsonl", [said("a1", [use("T9")]), user("u9", [result("T1", "sub"), result("T9", [{"type": "text", "text": "y"}], is_error="true")])])
    write(tmp_path / "p" / "empty.jsonl", [{"type": "summary", "sessionId": "E"}])
    s = claude.read(spark, str(tmp_path))
    assert [r["session_id"] for r in s.sessions.collect()] == ["S"] and s.quarantined.count() == 1
    one = s.sessions.first()
    assert (one["cwd"], one["skipped_lines"], one["messages"], one["first_timestamp"]) == ("/w", 1, 10, "t2")
    turns = {(r["uuid"], r["text"]): r for r in s.turns.collect()}
    assert sorted(k[0] for k in turns) == ["", "", "a0", "a1", "a2"]
    assert turns["a0", "before"]["prompt_uuid"] is None and turns["a2", "plain"]["prompt_uuid"] == "u1"
    assert turns["a2", "plain"]["input_tokens"] == 5 and turns["a2", "plain"]["output_tokens"] == 0 and turns["a2", "plain"]["cache_5m_tokens"] == 2
    assert sorted(r["text"] for r in s.prompts.collect()) == ["aside", "do it"]
    results = {r["tool_use_id"]: (r["content"], r["is_error"]) for r in s.tool_results.collect()}
    assert results["T1"] == ("second", True) and results["T9"][1] is False
    assert sorted(r["tool_use_id"] for r in s.tool_uses.collect()) == ["T1", "T9"]
    assert [r["in_project"] for r in claude.in_project(s.sessions, "/w/").collect()] == [True]


def test_cursor(spark, tmp_path):
    f = tmp_path / "proj" / "agent-transcripts" / "id1" / "id1.jsonl"
    write(f, [
        {"role": "user", "message": {"content": "hi"}}, {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "Shell", "input": {"command": "ls"}}, {"type": "tool_use", "name": "TodoWrite", "input": {}}, {"type": "tool_use"}, {"type": "tool_use", "name": "CallMcpTool", "input": {"server": "a", "toolName": "b"}}]}},
        "{bad", {"type": "turn_ended", "error": "e"}, {"what": 1}, '{"cut',
    ], end="")
    got = cursor.parse(jsonl.lines(spark, str(tmp_path)))
    assert [(r["tool_use_id"], r["kind"], r["tool"]) for r in got["tool_uses"].orderBy("i").collect()] == [("id1:1:0", "action", "Bash"), ("id1:1:1", "not-action", "TodoWrite"), ("id1:1:2", "unmapped", None), ("id1:1:3", "action", "mcp__a__b")]
    skips = got["skips"].first()
    assert (skips["unparseable_lines"], skips["truncated_last_lines"], skips["unknown_records"]) == (1, 1, 1) and got["errors"].first()["errors"] == 1


def test_codex(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "timestamp": "t", "payload": p}
    usage = {"type": "token_usage_record", "payload": {"usage": {"input_tokens": 10, "output_tokens": 3, "cached_input_tokens": 4, "cache_write_input_tokens": 1}}}
    call = lambda i, src: item(type="custom_tool_call", call_id=i, name="exec", input=src)
    out = lambda i, o: item(type="custom_tool_call_output", call_id=i, output=o)
    write(tmp_path / "2026" / "09" / "21" / "rollout-a.jsonl", [
        {"type": "session_meta", "payload": {"session_id": "S", "cwd": "/w"}}, {"type": "turn_context", "payload": {"model": "m1"}}, out("c1", "early"),
        call("c1", 'const r = await tools.exec_command({cmd: "ls \\"x\\"", workdir: \'/w\', n: 3}); tools.apply_patch("*** Begin Patch\\n*** Add File: a.py\\n+x")'), out("c1", "ok"), usage,
        call("c2", "tools.exec_command({cmd: `ls`})"),
    ])
    got = codex.parse(jsonl.lines(spark, str(tmp_path)))
    turns = got["turns"].orderBy("turn").collect()
    assert [(r["turn"], r["model"], r["input_tokens"], r["output_tokens"]) for r in turns] == [(0, "m1", 5, 3), (1, "m1", 0, 0)]
    calls = {r["call_id"]: r for r in got["calls"].collect()}
    assert calls["c1"]["output"] == "ok" and calls["c2"]["shim"] is None and calls["c2"]["output"] is None
    acts = codex.shim_actions(got["calls"]).orderBy("i").collect()
    assert [(r["tool"], r["full_command"], r["files"]) for r in acts] == [("Bash", 'ls "x"', None), ("apply_patch", None, ["a.py"])]


def test_decision_log(spark, tmp_path):
    ok = {"ts": "2026-01-01T00:00:00Z", "tool": "Bash", "decision": "ask", "ruleId": "r", "command": "c", "agent": "a"}
    write(tmp_path / "log" / "d.jsonl", [ok, {"ruleId": "r", "decision": "ask"}, "", '{"cut', {**ok, "decision": "what"}, ok])
    assert decision_log.read(spark, str(tmp_path / "log")).count() == 2
    assert decision_log.read(spark, str(tmp_path / "log"), last=3).count() == 1


def test_streams(spark, tmp_path):
    rows = [("l", "a", "2026-01-01 00:00:00"), ("l", "a", "2026-01-01 00:00:03"), ("l", "b", "2026-01-01 00:00:04"), ("l", "a", "2026-01-01 00:00:05"), ("m", "a", "2026-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "log string, key string, ts string").select("log", "key", F.to_timestamp("ts").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert run(decisions.dedupe_stream(src(), "log", "key", "ts"), "dedupe").count() == 4
    hours = [("p", "2026-01-01 10:59:00"), ("p", "2026-01-01 11:01:00"), ("p", "2026-01-01 11:59:00"), ("p", "2026-01-01 12:58:59"), ("q", "2026-01-01 11:01:00")]
    spark.createDataFrame(hours, "project string, ts string").select("project", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "hours"))
    late = decisions.once_an_hour(spark.readStream.schema("project string, ts timestamp").parquet(str(tmp_path / "hours")), "project", "ts")
    assert sorted((r["project"], str(r["ts"])[11:16]) for r in run(late, "hourly").collect()) == [("p", "10:59"), ("p", "11:59"), ("q", "11:01")]
    logged = decisions.append_log(src().withColumn("command", F.concat(F.lit("mail a.b@c.org "), "key")), str(tmp_path / "log-out"), str(tmp_path / "log-cp")).trigger(availableNow=True).start()
    logged.awaitTermination(60)
    assert {r["command"] for r in spark.read.json(str(tmp_path / "log-out")).collect()} == {"mail <email> a", "mail <email> b"}
    from spanforge.plans.rules import Spans

    spans = Spans(kind="'execute_tool'", label="key", detail="log", mcp_input=None, file_path=None, agent=None, project=None, tokens=None, cached_tokens=None, duration_ms=None)
    out = decisions.evaluate_stream(src(), [Rule("r", Match(any_of=(Condition(label="a"),)), action="block")], columns=spans)
    assert run(out.select("decision"), "evaluated").where("decision = 'deny'").count() == 4
    assert run(decisions.windowed_counts(src(), "ts", "key"), "counts", "complete").where("key = 'a'").first()["n"] == 4


def test_report_sinks_and_scrubbed_copies(spark, tmp_path):
    from spanforge.operators import rule_admin
    from spanforge.sources import report

    rows = spark.range(3).withColumn("name", F.lit("x"))
    report.write_tables({"a": rows, "b": rows.limit(0)}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "a")).count() == 3 and spark.read.parquet(str(tmp_path / "tables" / "b")).count() == 0
    assert json.loads(report.document({"a": rows.limit(1)})) == {"a": [{"id": 0, "name": "x"}]}
    lines = spark.createDataFrame([("f1", 0, '{"k":"old"}'), ("f1", 1, "old text"), ("f2", 0, "none")], "file string, line int, text string")
    plan = rule_admin.scrub_plan(lines, spark.createDataFrame([("old",)], "value string"))
    counts = {r["file"]: (r["lines"], r["changed"], r["lines_left"], r["lines_invalid"]) for r in rule_admin.scrub_write(plan, str(tmp_path / "copy")).collect()}
    assert counts == {"f1": (2, 2, 0, 0), "f2": (1, 0, 0, 0)}
    assert [r["value"] for r in spark.read.text(str(tmp_path / "copy" / "file=f1")).collect()] == ['{"k":"<removed>"}', "<removed> text"]


def test_a_corrupted_copy_is_not_committed(spark, tmp_path):
    """Changed, lost, exchanged and added lines, a file too many, a value that is left, and a taken name."""
    import pytest

    from spanforge.operators import rule_admin

    rows = [(f, i, json.dumps({"k": f"old {f} {i}"})) for f in ("a b%", "c+d") for i in range(40)]
    lines = spark.createDataFrame(rows, "file string, line int, text string")
    values = spark.createDataFrame([("old",)], "value string")
    plan = rule_admin.scrub_plan(lines, values)
    folder = f"file://{tmp_path}/copy"

    def part(staged, k=0):
        return sorted(p for p in __import__("pathlib").Path(staged.removeprefix("file://")).glob("file=*/part-*"))[k]

    def change(text):
        own = text.split("\n")
        return {"changed": [own[0] + " ", *own[1:]], "lost": own[1:], "exchanged": [own[1], own[0], *own[2:]], "added": [*own[:-1], "x", ""]}

    for kind in ("changed", "lost", "exchanged", "added", "gone"):
        staged = rule_admin.scrub_stage(plan, folder)
        p = part(staged)
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
        if kind == "gone":
            p.unlink()
        else:
            p.write_text("\n".join(change(p.read_text())[kind]))
        with pytest.raises(rule_admin.ScrubError, match="a b%"):
            rule_admin.scrub_commit(plan, staged, folder, values)
        assert not (tmp_path / "copy").exists() and not list(tmp_path.iterdir())
    with pytest.raises(rule_admin.ScrubError):
        rule_admin.scrub_write(plan, folder, spark.createDataFrame([("a b%",)], "value string"))
    done = rule_admin.scrub_write(plan, folder, values)
    assert sorted((r["file"], r["lines"], r["changed"]) for r in done.collect()) == [("a b%", 40, 40), ("c+d", 40, 40)]
    with pytest.raises(rule_admin.ScrubError, match="already"):
        rule_admin.scrub_write(plan, folder, values)


def test_lines_of_split_files(spark, tmp_path):
    """Files cut into blocks of some bytes give the numbers that whole ones give; the numbers of blocks may be joined by a shuffle."""
    import random

    rnd, want = random.Random(1), {}
    for i in range(5):
        rows = ["é" * rnd.randint(0, 150) + str(k) if rnd.random() < 0.9 else "" for k in range(rnd.randint(1, 60))]
        (tmp_path / f"f{i}.jsonl").write_bytes("\r\n".join(rows).encode() + b"\n" * (i % 2))
        want |= {(f"f{i}.jsonl", k): r for k, r in enumerate(rows)}
    (tmp_path / "empty.jsonl").write_bytes(b"")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("97", "10"), strict=True):
            spark.conf.set(k, v)
        for most in (jsonl.BLOCKS, 3):
            df = jsonl.lines(spark, str(tmp_path), most=most)
            got = {(r["file"].split("/")[-1], r["line"]): r["text"] for r in df.collect()}
            assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert jsonl.lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 50
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
