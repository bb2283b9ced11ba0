"""Sessions of messages without ids, times, results or tokens: <project>/agent-transcripts/<id>/<id>.jsonl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import CHANNEL_CAP, cap_end, cap_middle, joined_glob
from .jsonl import get, kind_of, malformed, records, text_at

# How these tools are named in the two channels, and calls that do nothing.
RENAMED = {"Shell": "Bash", "Read": "Read", "Write": "Write", "StrReplace": "Edit", "Delete": "Delete", "Grep": "Grep", "Glob": "Glob", "WebSearch": "WebSearch"}
NOT_ACTIONS = ("AskQuestion", "Await", "CreatePlan", "GetDynamicTools", "ReadLints", "SemanticSearch", "SwitchMode", "Task", "TodoWrite", "UpdateCurrentStep", "WebFetch")
SERVERS = ("CallDynamicTool", "CallMcpTool")


def parse(rows: DataFrame) -> dict[str, DataFrame]:
    """turns, tool_uses (ids made of file, line and place) and counts of lines that could not be read, by file."""
    r = records(rows).withColumns({"role": text_at("$.role"), "type": text_at("$.type"), "content_kind": kind_of("$.message.content")})
    known = F.col("role").isin("user", "assistant") | (F.col("type") == "turn_ended")
    session = F.regexp_extract("file", r"agent-transcripts/([^/]+)/", 1)
    said = r.where(F.col("role").isin("user", "assistant")).withColumn("session_id", session)
    turns = said.select("session_id", "file", "line", "role", text_at("$.message.content").alias("text"), F.col("mtime").alias("timestamp"))
    blocks = said.where("role = 'assistant' and content_kind like 'ARRAY%'").select("session_id", "file", "line", F.posexplode(get("$.message.content", "array<variant>")).alias("i", "block"))
    uses = blocks.where(text_at("$.type", "block") == "tool_use").select("session_id", "file", "line", "i", F.concat_ws(":", "session_id", F.col("line").cast("string"), F.col("i").cast("string")).alias("tool_use_id"), text_at("$.name", "block").alias("name"), F.to_json(F.try_variant_get("block", "$.input", "variant")).alias("input"))
    mapped = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    server = F.col("name").isin(*SERVERS)
    tool = F.when(server, F.concat(F.lit("mcp__"), F.get_json_object("input", "$.server"), F.lit("__"), F.get_json_object("input", "$.toolName"))).otherwise(F.coalesce(mapped[F.col("name")], F.col("name")))
    kind = F.when(F.col("name").isin(*NOT_ACTIONS), "not-action").when(F.col("name").isin(*RENAMED, *SERVERS), "action").otherwise("unmapped")
    given = lambda *names: F.coalesce(*[F.get_json_object("input", f"$.{n}") for n in names])
    command = F.when(F.col("name") == "Shell", cap_end(given("command"))).when(F.col("name") == "WebSearch", cap_end(given("search_term", "query"))).when(server, cap_middle(F.coalesce(given("arguments"), F.col("input")), CHANNEL_CAP))
    path = F.when(F.col("name").isin("Read", "Write", "StrReplace", "Delete"), given("path", "file_path")).when(F.col("name") == "Grep", joined_glob(given("path"), given("glob"))).when(F.col("name") == "Glob", joined_glob(given("target_directory", "path"), given("glob_pattern", "pattern")))
    uses = uses.withColumns({"kind": kind, "tool": tool, "full_command": command, "file_path": path})
    errors = r.where("type = 'turn_ended'").groupBy("file").agg(F.count_if(text_at("$.error").isNotNull()).alias("errors"))
    return {"turns": turns, "tool_uses": uses, "skips": malformed(r, known), "errors": errors}
