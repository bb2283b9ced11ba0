"""Rollout files by day (<root>/Y/M/D/*.jsonl) whose turns end at usage records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.mapping import normalized_usage
from .jsonl import first_by_line, get, malformed, records, text_at

CALLS = "array<struct<fn:string,cmd:string,workdir:string,text:string>>"
MOST = 128 << 10


def _literal(source: str, i: int) -> tuple[str | None, int]:
    """The string literal at i, and where it ends; None for anything else (a template literal included)."""
    quote = source[i] if i < len(source) else ""
    if quote not in "'\"" or not quote:
        return None, i
    out, i = [], i + 1
    simple = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
    while i < len(source):
        c = source[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\n":
            return None, i
        if c == "\\":
            n = source[i + 1 : i + 2]
            if n == "u" and source[i + 2 : i + 3] == "{":
                end = source.find("}", i)
                out.append(chr(int(source[i + 3 : end], 16)))
                i = end + 1
            elif n in ("u", "x"):
                size = 4 if n == "u" else 2
                out.append(chr(int(source[i + 2 : i + 2 + size], 16)))
                i += 2 + size
            else:
                out.append("" if n == "\n" else simple.get(n, n))
                i += 2
            continue
        out.append(c)
        i += 1
    return None, i


def shim_calls(source: str | None) -> list[dict] | None:
    """The tools.<fn>(...) calls of a script whose arguments are literals; None when any is not, or the script is too long.

    One argument may be a string, or an object of strings of which cmd and workdir are read.
    """
    import re

    if source is None or len(source) > MOST or "`" in source:
        return None
    out = []
    for m in re.finditer(r"\btools\.([A-Za-z_]\w*)\s*\(", source):
        i = m.end()
        space = re.compile(r"\s*")
        i = space.match(source, i).end()
        call = {"fn": m[1], "cmd": None, "workdir": None, "text": None}
        if source[i : i + 1] == "{":
            i += 1
            while True:
                i = space.match(source, i).end()
                if source[i : i + 1] == "}":
                    i += 1
                    break
                key = re.compile(r"(?:([A-Za-z_$][\w$]*)|'([^'\\]*)'|\"([^\"\\]*)\")\s*:\s*").match(source, i)
                if not key:
                    return None
                name, i = key[1] or key[2] or key[3], key.end()
                try:
                    value, end = _literal(source, i)
                except ValueError:
                    return None
                if value is None:
                    plain = re.compile(r"-?\d+(?:\.\d+)?|true|false|null").match(source, i)
                    if not plain:
                        return None
                    end = plain.end()
                elif name in ("cmd", "workdir"):
                    call[name] = value
                i = space.match(source, end).end()
                if source[i : i + 1] == ",":
                    i += 1
                elif source[i : i + 1] != "}":
                    return None
        elif source[i : i + 1] != ")":
            try:
                call["text"], i = _literal(source, i)
            except ValueError:
                return None
            if call["text"] is None:
                return None
        i = space.match(source, i).end()
        if source[i : i + 1] == ",":
            i = space.match(source, i + 1).end()
        if source[i : i + 1] != ")":
            return None
        out.append(call)
    return out or None


def _shims(column):
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("fn", "cmd", "workdir", "text")]))
    return F.arrow_udf(lambda texts: pa.array([shim_calls(t) for t in texts.to_pylist()], kind), CALLS)(column)


def parse(rows: DataFrame) -> dict[str, DataFrame]:
    """sessions, turns with usage, calls with their output, and counts of lines that could not be read."""
    r = records(rows).withColumns({"type": text_at("$.type"), "item": text_at("$.payload.type"), "call_id": text_at("$.payload.call_id"), "timestamp": text_at("$.timestamp")})
    known = F.col("type").isin("session_meta", "turn_context", "response_item", "token_usage_record", "event_msg", "world_state", "compacted")
    sessions = r.groupBy("file").agg(*[first_by_line(F.when(F.col("type") == "session_meta", text_at(f"$.payload.{f}"))).alias(n) for f, n in (("session_id", "session_id"), ("cli_version", "version"), ("cwd", "cwd"))])
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    usage = F.col("type") == "token_usage_record"
    r = r.withColumns({"turn": F.coalesce(F.sum(usage.cast("int")).over(before), F.lit(0)), "model": F.last(F.when(F.col("type") == "turn_context", text_at("$.payload.model")), ignorenulls=True).over(upto)})
    n = lambda f: F.floor(F.greatest(F.lit(0.0), F.nanvl(F.coalesce(get(f"$.payload.usage.{f}", "double"), F.lit(0.0)), F.lit(0.0)))).cast("long")
    counts = r.where(usage).select("file", "turn", "model", n("output_tokens").alias("output_tokens"), n("cached_input_tokens").alias("cache_read_tokens"), n("cache_write_input_tokens").alias("cache_creation_tokens"), normalized_usage(n("input_tokens"), n("cached_input_tokens"), n("cache_write_input_tokens")).alias("input_tokens"))
    begun = r.where("type = 'response_item'").groupBy("file", "turn").agg(F.min("line").alias("first_line"), F.last("model").alias("last_model"))
    turns = begun.join(counts, ["file", "turn"], "full").select("file", "turn", F.coalesce("model", "last_model").alias("model"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    calls = r.where("item = 'custom_tool_call'").select("file", "turn", "line", "timestamp", "call_id", text_at("$.payload.name").alias("name"), get("$.payload.input").alias("input"))
    calls = calls.withColumn("shim", F.when(F.col("name") == "exec", _shims("input")))
    outputs = r.where("item = 'custom_tool_call_output'").select("file", "call_id", F.col("line").alias("out_line"), F.coalesce(text_at("$.payload.output"), F.to_json(F.try_variant_get("record", "$.payload.output", "variant"))).alias("output"))
    # an output belongs to the last call of its id before it; of several the last one counts
    pairs = outputs.join(calls.select("file", "call_id", "line"), ["file", "call_id"]).where("line < out_line").groupBy("file", "call_id", "out_line").agg(F.max("line").alias("line"), F.first("output").alias("output"))
    answered = pairs.groupBy("file", "call_id", "line").agg(F.max_by("output", "out_line").alias("output"))
    return {"sessions": sessions, "turns": turns, "calls": calls.join(answered, ["file", "call_id", "line"], "left"), "skips": malformed(r, known)}


def shim_actions(calls: DataFrame) -> DataFrame:
    """A row for each call in a shim: commands as Bash, patches with their files, others unmapped."""
    each = calls.where("shim is not null").select("file", "turn", "line", "call_id", F.posexplode("shim").alias("i", "c"))
    out = each.select("file", "turn", "line", "call_id", "i", "c.*")
    return out.withColumns({
        "kind": F.when(F.col("fn").isin("exec_command", "apply_patch"), "action").otherwise("unmapped"),
        "tool": F.when(F.col("fn") == "exec_command", "Bash").when(F.col("fn") == "apply_patch", "apply_patch").otherwise(F.col("fn")),
        "full_command": F.when(F.col("fn") == "exec_command", F.col("cmd")),
        "files": F.when(F.col("fn") == "apply_patch", F.regexp_extract_all("text", F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+?)\s*$"), 1)),
    })

