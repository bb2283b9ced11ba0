"""Queries on transcripts and logs: the driver's tables written as records of each format, read back, and held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import aggregate, evaluate, rule_admin
from .plans.rules import RuleError, rule_of
from .queries import CATALOG, _t, query, rule
from .sources import claude, codex, cursor, decision_log, jsonl, shared


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, (str, int, bool)) else v).alias(k) for k, v in fields.items()]))


def _raw(template: str, **values: Column) -> Column:
    """A JSON text with values, which are JSON themselves, put for <name>."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations with a line number: the turns in order, which may repeat."""
    return _t(spark, d, "conversations").withColumn("line", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1)


_T = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS line FROM conversations)"


def claude_lines(spark: SparkSession, d: str) -> DataFrame:
    """A transcript for each conversation; every third user turn carries the result of the call before it, and some lines are cut."""
    t = turns(spark, d)
    text, line = _quoted(F.col("text")), F.col("line").cast("string")
    carrier = (F.col("role") == "user") & (F.col("line") % 3 == 2)
    record = (
        F.when(F.col("role") == "assistant", _raw('{"type":"assistant","uuid":"a<line>","sessionId":"s<conv>","cwd":"/w/<conv>","timestamp":"t<line>","message":{"role":"assistant","model":"m","content":[{"type":"text","text":<text>},{"type":"tool_use","id":"T<line>","name":"Bash","input":{"command":"ls <line>"}}],"usage":{"input_tokens":<n>,"output_tokens":2.9}}}', text=text, n=F.length("text").cast("string")))
        .when(carrier, _raw('{"type":"user","uuid":"u<line>","timestamp":"t<line>","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"T<before>","content":<text>,"is_error":<odd>}]}}', text=text, before=(F.col("line") - 1).cast("string"), odd=(F.col("line") % 2 == 1).cast("string")))
        .when(F.col("role") != "user", F.lit('{"type":"system","uuid":"y<line>","timestamp":"t<line>"}'))
        .otherwise(_raw('{"type":"user","uuid":"u<line>","timestamp":"t<line>","isSidechain":<side>,"message":{"role":"user","content":<text>}}', text=text, side=(F.col("line") % 4 == 3).cast("string")))
    )
    record = F.replace(F.replace(record, F.lit("<line>"), line), F.lit("<conv>"), F.col("conv_id").cast("string"))
    file = F.concat(F.lit("/r/p"), F.col("conv_id") % 3, F.lit("/c"), F.col("conv_id"), F.lit(".jsonl"))
    return t.select(file.alias("file"), F.col("line").cast("int").alias("line"), record.alias("text"))


_KEY = "'p' || conv_id % 3 || '/c' || conv_id"


@query(f"""WITH {_T}, p AS (SELECT *, last_value(CASE WHEN role = 'user' AND line % 3 <> 2 AND line % 4 <> 3 THEN 'u' || line END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS prompt_uuid FROM t)
SELECT {_KEY} AS session_key, 'a' || line AS uuid, prompt_uuid, text, length(text)::BIGINT AS input_tokens, 2::BIGINT AS output_tokens FROM p WHERE role = 'assistant'""")
def claude_turns(spark, d):
    return claude.parse(claude_lines(spark, d)).turns.select("session_key", "uuid", "prompt_uuid", "text", "input_tokens", "output_tokens")


@query(f"WITH {_T} SELECT {_KEY} AS session_key, 'u' || line AS uuid, text, line % 4 = 3 AS sidechain FROM t WHERE role = 'user' AND line % 3 <> 2")
def claude_prompts(spark, d):
    return claude.parse(claude_lines(spark, d)).prompts.select("session_key", "uuid", "text", "sidechain")


@query(f"""WITH {_T}, r AS (SELECT conv_id, line - 1 AS line, text, line % 2 = 1 AS is_error FROM t WHERE role = 'user' AND line % 3 = 2)
SELECT {_KEY.replace('conv_id', 't.conv_id')} AS session_key, 'T' || t.line AS tool_use_id, 'ls ' || t.line AS command, r.text AS result, r.is_error FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.line = t.line WHERE role = 'assistant'""")
def claude_calls(spark, d):
    s = claude.parse(claude_lines(spark, d))
    rows = s.tool_uses.join(s.tool_results.select("session_key", "tool_use_id", "content", "is_error"), ["session_key", "tool_use_id"], "left")
    return rows.select("session_key", "tool_use_id", F.get_json_object("input", "$.command").alias("command"), F.col("content").alias("result"), "is_error")


@query(f"""WITH {_T}, f AS (SELECT conv_id, min(CASE WHEN role = 'assistant' THEN line END) AS a, count(*) AS messages, min(line) FILTER (role IN ('user', 'assistant')) AS lo, max(line) FILTER (role IN ('user', 'assistant')) AS hi, bool_or(role = 'assistant' OR (role = 'user' AND line % 3 <> 2)) AS spine FROM t GROUP BY 1)
SELECT {_KEY} AS session_key, CASE WHEN a IS NOT NULL THEN 's' || conv_id END AS session_id, CASE WHEN a IS NOT NULL THEN '/w/' || conv_id END AS cwd, 't' || lo AS first_timestamp, 't' || hi AS last_timestamp, messages FROM f WHERE spine""")
def claude_sessions(spark, d):
    return claude.parse(claude_lines(spark, d)).sessions.select("session_key", "session_id", "cwd", "first_timestamp", "last_timestamp", "messages")


@query(f"""WITH {_T}, f AS (SELECT conv_id, min(CASE WHEN role = 'assistant' AND line < 40 THEN line END) AS a, count(*) AS messages FROM t GROUP BY 1) SELECT {_KEY} AS session_key, CASE WHEN a IS NOT NULL THEN 's' || conv_id END AS session_id, messages FROM f""")
def claude_inventory(spark, d):
    return claude.inventory(claude_lines(spark, d)).select("session_key", "session_id", "messages")


@query(f"""WITH {_T}, f AS (SELECT conv_id, bool_or(role = 'assistant') AS a FROM t GROUP BY 1)
SELECT count(*) FILTER (a AND conv_id = 7) AS in_scope, count(*) FILTER (a AND conv_id <> 7) AS excluded_other_project, count(*) FILTER (NOT a) AS excluded_unknown_cwd FROM f""")
def claude_scope(spark, d):
    return claude.scope_counts(claude.inventory(claude_lines(spark, d)), "/w/7/")


@query("SELECT count(DISTINCT conv_id % 3) AS projects FROM conversations")
def project_count(spark, d):
    return aggregate.project_count(claude.inventory(claude_lines(spark, d)), "claude")


@query(f"""WITH {_T}, s AS (SELECT DISTINCT conv_id FROM t), m AS (SELECT conv_id, line, text, 'main' AS w FROM t WHERE role = 'assistant' UNION ALL SELECT conv_id, 10000 + line, 'sub ' || text, 'sub' FROM t WHERE role = 'assistant' AND line % 2 = 0)
SELECT {_KEY} AS session_key, count(*) AS turns, count(*) FILTER (w = 'sub') AS of_subagents FROM m GROUP BY conv_id""")
def claude_subagents(spark, d):
    """Turns of a session's sub-agents join those of its main file; ones that repeat an id are left out."""
    main = claude_lines(spark, d)
    name = F.regexp_replace("file", r"\.jsonl$", "/subagents/x.jsonl")
    again = main.where(F.contains("text", F.lit('"type":"assistant"'))).select(name.alias("file"), "line", "text")
    own = again.where("line % 2 = 0").select("file", (F.col("line") + 10000).alias("line"), F.regexp_replace(F.regexp_replace("text", r'"uuid":"a(\d+)"', '"uuid":"sub$1"'), r'"text":"', '"text":"sub ').alias("text"))
    t = claude.parse(main.union(again).union(own)).turns
    return t.groupBy("session_key").agg(F.count("*").alias("turns"), F.count_if(F.startswith("uuid", F.lit("sub"))).alias("of_subagents"))


@query(f"""WITH {_T}, e AS (SELECT conv_id, max(line) AS hi FROM t GROUP BY 1)
SELECT '/r/p' || conv_id % 3 || '/c' || conv_id || '.jsonl' AS file, (CASE WHEN conv_id % 4 = 1 AND hi > 0 THEN 1 ELSE 0 END)::BIGINT AS unparseable_lines, (CASE WHEN conv_id % 4 = 0 OR (conv_id % 4 = 1 AND hi = 0) THEN 1 ELSE 0 END)::BIGINT AS truncated_last_lines, (CASE WHEN conv_id % 4 = 2 THEN 1 ELSE 0 END)::BIGINT AS unknown_records FROM e""")
def malformed_lines(spark, d):
    rows = claude_lines(spark, d)
    conv = F.regexp_extract("file", r"/c(\d+)\.jsonl$", 1).cast("long")
    last = F.max("line").over(Window.partitionBy("file"))
    cut = ((conv % 4 == 0) & (F.col("line") == last)) | ((conv % 4 == 1) & (F.col("line") == 0))
    text = F.when(cut, F.substring("text", 1, 9)).when((conv % 4 == 2) & (F.col("line") == 0), F.lit('{"type":"what"}')).otherwise(F.col("text"))
    r = jsonl.records(rows.withColumn("text", text).union(rows.where("line = 0").select("file", F.lit(99_999).alias("line"), F.lit("  ").alias("text"))))
    return jsonl.malformed(r, jsonl.text_at("$.type").isin("user", "assistant", "system"))


@query("""SELECT conv_id % 5 AS part, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS line, conv_id, turn, text FROM conversations""")
def jsonl_lines(spark, d):
    """conversations written as JSON lines, in five files, and read again with the number of each line in its file."""
    rows = _t(spark, d, "conversations").select(F.col("conv_id") % 5, "conv_id", "turn", "role", "text").toDF("part", "conv_id", "turn", "role", "text")
    path = shared.new_path(spark, "lines")
    order = ["part", "conv_id", "turn", "role", "text"]
    rows.repartition("part").sortWithinPartitions(*order).select("part", F.to_json(F.struct("conv_id", "turn", "text")).alias("value")).write.partitionBy("part").text(path)
    out = jsonl.lines(spark, path, "*.txt")
    field = lambda n, kind: jsonl.get(f"$.{n}", kind).alias(n)
    own = out.withColumn("record", F.try_parse_json("text")).select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part"), "line", "record")
    return own.select("part", "line", field("conv_id", "bigint"), field("turn", "bigint"), field("text", "string"))


@query("SELECT count(*) AS not_read FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 1")
def not_read_files(spark, d):
    rows = claude_lines(spark, d)
    return jsonl.not_read(rows.select("file"), rows.where(~F.contains("file", F.lit("/p1/"))))


@query("""SELECT user_id || ':' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) || ':0' AS tool_use_id, CASE event_type WHEN 'signup' THEN 'not-action' WHEN 'error' THEN 'unmapped' ELSE 'action' END AS kind,
CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Edit' WHEN 'purchase' THEN 'mcp__pay__buy' WHEN 'signup' THEN 'WebFetch' ELSE 'Weird' END AS tool, CASE event_type WHEN 'click' THEN 'ls ' || event_id WHEN 'purchase' THEN '{"n":' || event_id || '}' END AS full_command, CASE event_type WHEN 'view' THEN '/f' || event_id END AS file_path FROM events""")
def cursor_calls(spark, d):
    """A session for each user, whose events are tool calls."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    block = (
        F.when(kind == "click", _raw('{"type":"tool_use","name":"Shell","input":{"command":"ls <n>"}}', n=n)).when(kind == "view", _raw('{"type":"tool_use","name":"StrReplace","input":{"path":"/f<n>","old_string":"a"}}', n=n))
        .when(kind == "purchase", _raw('{"type":"tool_use","name":"CallMcpTool","input":{"server":"pay","toolName":"buy","arguments":{"n":<n>}}}', n=n)).when(kind == "signup", F.lit('{"type":"tool_use","name":"WebFetch","input":{}}')).otherwise(F.lit('{"type":"tool_use","name":"Weird","input":{}}'))
    )
    rows = _t(spark, d, "events").select(F.concat(F.lit("/c/p/agent-transcripts/"), F.col("user_id"), F.lit("/"), F.col("user_id"), F.lit(".jsonl")).alias("file"), line.alias("line"), F.concat(F.lit('{"role":"assistant","message":{"content":['), block, F.lit("]}}")).alias("text"), F.lit(None).cast("timestamp").alias("mtime"))
    return cursor.parse(rows)["tool_uses"].select("tool_use_id", "kind", "tool", "full_command", "file_path")


def codex_lines(spark: SparkSession, d: str) -> DataFrame:
    """A rollout for each user: purchases close a turn with their usage, views set the model, clicks call a shell and errors are its output."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    record = (
        F.when(kind == "purchase", _raw('{"type":"token_usage_record","payload":{"usage":{"input_tokens":<n>,"output_tokens":3,"cached_input_tokens":4,"cache_write_input_tokens":1}}}', n=n)).when(kind == "view", _raw('{"type":"turn_context","payload":{"model":"m<k>"}}', k=(F.col("event_id") % 3).cast("string")))
        .when(kind == "click", _raw("""{"type":"response_item","payload":{"type":"custom_tool_call","call_id":"c","name":"exec","input":"await tools.exec_command({cmd: 'ls <n>', workdir: '/w'})"}}""", n=n))
        .when(kind == "error", _raw('{"type":"response_item","payload":{"type":"custom_tool_call_output","call_id":"c","output":"out <n>"}}', n=n)).otherwise(F.lit('{"type":"event_msg"}'))
    )
    return _t(spark, d, "events").select(F.concat(F.lit("/x/2026/01/02/rollout-"), F.col("user_id"), F.lit(".jsonl")).alias("file"), line.alias("line"), record.alias("text"))


_X = """x AS (SELECT *, row_number() OVER w - 1 AS line, coalesce(sum((event_type = 'purchase')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn,
  last_value(CASE WHEN event_type = 'view' THEN 'm' || event_id % 3 END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS model FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, '/x/2026/01/02/rollout-' || user_id || '.jsonl' AS file FROM x)"""


@query(f"""WITH {_X}, u AS (SELECT file, turn, model, greatest(0, event_id - 5)::BIGINT AS input_tokens FROM f WHERE event_type = 'purchase'),
b AS (SELECT file, turn, last(model ORDER BY line) AS model FROM f WHERE event_type IN ('click', 'error') GROUP BY 1, 2)
SELECT coalesce(u.file, b.file) AS file, coalesce(u.turn, b.turn)::BIGINT AS turn, coalesce(u.model, b.model) AS model, coalesce(input_tokens, 0) AS input_tokens, (CASE WHEN u.file IS NULL THEN 0 ELSE 3 END)::BIGINT AS output_tokens FROM u FULL JOIN b ON u.file = b.file AND u.turn = b.turn""")
def codex_turns(spark, d):
    return codex.parse(codex_lines(spark, d))["turns"].select("file", F.col("turn").cast("long").alias("turn"), "model", "input_tokens", "output_tokens")


@query(f"""WITH {_X}, c AS (SELECT file, line, event_id FROM f WHERE event_type = 'click'), o AS (SELECT e.file, e.line AS out_line, e.event_id, max(c.line) AS line FROM f e JOIN c ON c.file = e.file AND c.line < e.line WHERE e.event_type = 'error' GROUP BY 1, 2, 3),
l AS (SELECT file, line, arg_max(event_id, out_line) AS event_id FROM o GROUP BY 1, 2)
SELECT c.file, c.line::BIGINT AS line, 'ls ' || c.event_id AS command, 'out ' || l.event_id AS output FROM c LEFT JOIN l ON l.file = c.file AND l.line = c.line""")
def codex_calls(spark, d):
    calls = codex.parse(codex_lines(spark, d))["calls"]
    acts = codex.shim_actions(calls).select("file", "line", "full_command")
    return calls.join(acts, ["file", "line"]).select("file", F.col("line").cast("long").alias("line"), F.col("full_command").alias("command"), "output")


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS line FROM events), t AS (SELECT * FROM e ORDER BY line DESC LIMIT 500)
SELECT event_id, CASE event_type WHEN 'click' THEN 'ask' ELSE 'deny' END AS decision, 'r' || user_id % 5 AS rule_id FROM t WHERE event_type IN ('click', 'purchase')""")
def decision_log_tail(spark, d):
    """The last 500 lines of a log; of these, views lack an agent, errors are cut, and signups have no known decision."""
    kind = F.col("event_type")
    good = _json(ts=F.col("ts").cast("string"), tool="Bash", decision=F.when(kind == "click", "ask").when(kind == "signup", "what").otherwise("deny"), ruleId=F.concat(F.lit("r"), F.col("user_id") % 5), command=F.col("event_id").cast("string"), agent=F.when(kind != "view", "a"))
    text = F.when(kind == "error", F.substring(good, 1, 20)).otherwise(good)
    rows = _t(spark, d, "events").select(F.col("event_id").alias("line"), text.alias("text"))
    return decision_log.parse(rows).select(F.col("command").cast("long").alias("event_id"), "decision", "rule_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\":\"<removed> x\"}' ELSE '{\"k\":\"a/b\"}' END AS scrubbed, event_id % 2 = 0 AS changed FROM events")
def transcript_scrub_plan(spark, d):
    values = spark.createDataFrame([('se"cret/1',), ("",), (None,)], "value string")
    text = F.when(F.col("event_id") % 4 == 0, F.lit('{"k":"se\\"cret/1 x"}')).when(F.col("event_id") % 4 == 2, F.lit('{"k":"se\\"cret\\/1 x"}')).otherwise(F.lit('{"k":"a/b"}'))
    rows = _t(spark, d, "events").select("event_id", F.lit("f").alias("file"), F.col("event_id").alias("line"), text.alias("text"))
    return rule_admin.scrub_plan(rows, values).select("event_id", "scrubbed", "changed")


# -- rules as data -----------------------------------------------------------------------------------------------------


def _part_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule of a user's own for each part, as JSON text: one with an odd match by what its number leaves, and every seventh is none."""
    number = F.col("p_partkey").cast("string")
    match = (
        F.when(F.col("p_partkey") % 5 == 0, '{"any_of":[{"label":"{Bash}","detail_contains":["<name>"]}]}').when(F.col("p_partkey") % 5 == 1, '{"any_of":[{"label":"*"}]}')
        .when(F.col("p_partkey") % 5 == 2, '{"all_of":[{"label":"Bash","numeric":[{"field":"tokens","op":"gt","value":1}]}]}').otherwise('{"any_of":[{"label":"Bash","detail_contains":["<name>"]}],"none_of":[{"detail_matches":["^x+$"]}]}')
    )
    text = _raw('{"id":"part-<n>","category":<brand>,"severity":"<grave>","defaultAction":"<act>","title":<name2>,"match":', n=number, brand=_quoted(F.col("p_brand")), grave=F.when(F.col("p_size") > 25, "high").otherwise("low"), act=F.when(F.col("p_size") % 2 == 0, "block").otherwise("warn"), name2=_quoted(F.col("p_name")))
    text = F.concat(text, F.replace(match, F.lit('"<name>"'), _quoted(F.col("p_name"))), F.lit(',"owasp":["ASI0'), F.col("p_partkey") % 4, F.lit('"]}'))
    return _t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 6, F.substring(text, 1, 40)).otherwise(text).alias("rule"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 0 WHEN p_partkey % 5 < 3 THEN 1 ELSE 0 END::BIGINT AS lints, p_partkey % 7 = 6 AS refused FROM part")
def rule_lints(spark, d):
    """A brace with one arm, a condition that every call meets, numbers that calls don't have; cut texts are no rules."""
    rows = rule_admin.read_rules(_part_rules(spark, d))
    return rows.select("p_partkey", F.size("read.lints").cast("long").alias("lints"), F.col("read.problem").isNotNull().alias("refused"))


@query("SELECT p_partkey, p_partkey % 6 IN (2, 3, 4) AS accepted FROM part")
def rule_pattern_lint(spark, d):
    """Patterns with nested unbounded quantifiers are refused."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    p = F.when(k == 0, F.concat(F.lit("("), n, F.lit("+)+"))).when(k == 1, "(?:x|y*)*z").when(k == 2, F.concat(F.lit("a+b*"), n)).when(k == 3, "(ab){2,5}").when(k == 4, "[a+]+(b)").otherwise(F.concat(F.lit("("), n, F.lit("{1,})+")))
    rows = _t(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.lit("r").alias("id"), F.struct(F.array(F.struct(F.array(p).alias("detail_matches"))).alias("any_of")).alias("match"))).alias("rule"))
    return rule_admin.read_rules(rows).select("p_partkey", F.col("read.problem").isNull().alias("accepted"))


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'empty' WHEN 2 THEN 'a placeholder' WHEN 3 THEN 'too broad: 2 of 9 everyday calls pass' WHEN 4 THEN 'too broad: 1 of 9 everyday calls pass' WHEN 5 THEN 'blinds the rule: 1 of 2 of its own examples would pass' WHEN 7 THEN 'holds redacted text' WHEN 8 THEN 'blinds the rule: 2 of 2 of its own examples would pass' END AS refusal FROM part""")
def allow_pattern_refusals(spark, d):
    """Why patterns that a user wants to let pass are refused; the rule exists to catch removals below /srv of each part's number."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 9
    texts = {0: F.concat(F.lit("rm -rf dist"), n, F.lit("*")), 1: F.lit("  "), 2: F.lit("<pattern>"), 3: F.lit("{pwd,date}"), 4: F.lit("npm *"), 5: F.concat(F.lit("rm -rf /srv/"), n), 6: F.lit("make clean"), 7: F.concat(F.lit("rm <path> "), n), 8: F.lit("rm -rf /srv/*")}
    pattern = F.coalesce(*[F.when(k == i, t) for i, t in texts.items()])
    rows = _t(spark, d, "part").select("p_partkey", pattern.alias("pattern"), F.array(F.concat(F.lit("rm -rf /srv/"), n), F.concat(F.lit("rm -rf /srv/x"), n)).alias("block"))
    return rule_admin.refusals(rows, "pattern", "block").select("p_partkey", "refusal")


@query("""SELECT 'part-' || p_partkey AS rule_id, p_brand AS category, 'ASI0' || p_partkey % 4 AS owasp FROM part WHERE p_partkey % 7 <> 6 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_partkey % 4 IN (1, 2) AND p_brand <> 'Brand#3' AND p_partkey <> 21""")
def catalog_listing(spark, d):
    """The enabled rules of three packs, of which one is off, that have one of two risk ids."""
    from .plans.rules import Config

    catalog = rule_admin.read_rules(_part_rules(spark, d)).where("read.problem is null").select("read.*").withColumnRenamed("id", "rule_id")
    rows = evaluate.listed(catalog, Config(frozenset({"Brand#3"}), frozenset({"part-21"})), packs=("Brand#1", "Brand#2", "Brand#3"), owasp=("ASI01", "ASI02"), only="enabled")
    return rows.select("rule_id", "category", F.col("owasp")[0].alias("owasp"))


@query("""SELECT 'part-' || p_partkey AS rule_id, p_name AS title, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS severity, CASE WHEN p_size % 2 = 0 THEN 'block' ELSE 'warn' END AS action, CASE WHEN p_partkey % 5 IN (0, 3, 4) THEN p_name END AS contains FROM part WHERE p_partkey % 7 <> 6""")
def rule_export(spark, d):
    """Rules written as data and read again are the same rules."""
    once = rule_admin.read_rules(_part_rules(spark, d)).where("read.problem is null").select("p_partkey", F.col("read.data").alias("rule"))
    again = rule_admin.read_rules(once).where("read.data = rule and read.problem is null").select("read.*")
    return again.select(F.col("id").alias("rule_id"), "title", "severity", "action", F.get_json_object("data", "$.match.any_of[0].detail_contains[0]").alias("contains"))
