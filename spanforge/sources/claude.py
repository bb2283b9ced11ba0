"""Session transcripts with one record a line: user and assistant messages with tool calls and results.

<root>/<project>/<session>.jsonl, and <root>/<project>/<session>/subagents/*.jsonl which belong to the session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregate import counter
from .jsonl import first_by_line, get, kind_of, lines, records, text_at


@dataclass
class Sessions:
    sessions: DataFrame
    turns: DataFrame
    tool_uses: DataFrame
    tool_results: DataFrame
    prompts: DataFrame
    quarantined: DataFrame


def read(spark: SparkSession, root: str) -> Sessions:
    """The transcripts below root as tables."""
    return parse(lines(spark, root))


def parse(rows: DataFrame) -> Sessions:
    """Lines (file, line, text) as tables. Lines that are no object are skipped and counted."""
    parts = F.split("file", "/")
    sub = F.element_at(parts, -2) == "subagents"
    placed = records(rows).withColumns({
        "session_key": F.when(sub, F.concat_ws("/", F.element_at(parts, -4), F.element_at(parts, -3))).otherwise(F.concat_ws("/", F.element_at(parts, -2), F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))),
        "project": F.when(sub, F.element_at(parts, -4)).otherwise(F.element_at(parts, -2)),
        "is_sub": sub,
    })
    ranks = placed.select("session_key", "file", "is_sub").distinct().withColumn("file_rank", F.row_number().over(Window.partitionBy("session_key").orderBy("is_sub", "file")))
    r = placed.join(ranks.select("file", "file_rank"), "file").withColumns({
        "type": text_at("$.type"), "uuid": get("$.uuid"), "timestamp": text_at("$.timestamp"),
        "sidechain": F.coalesce((kind_of("$.isSidechain") == "BOOLEAN") & get("$.isSidechain", "boolean"), F.lit(False)),
        "content_kind": kind_of("$.message.content"),
    })

    said = r.where(F.col("type").isin("user", "assistant"))
    blocks = said.where(F.col("content_kind").startswith("ARRAY")).select("session_key", "file", "file_rank", "line", "uuid", "timestamp", "type", "sidechain", F.posexplode(get("$.message.content", "array<variant>")).alias("i", "block"))
    blocks = blocks.withColumn("block_type", text_at("$.type", "block"))

    # one result carrier or prompt, never both
    carriers = blocks.where("type = 'user' and block_type = 'tool_result'").select("file", "line").distinct().withColumn("carries", F.lit(True))
    texts = blocks.where("block_type = 'text'").groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text_at("$.text", "block").alias("t")))), lambda x: x["t"]), "\n").alias("block_text"))
    spoken = said.join(carriers, ["file", "line"], "left").join(texts, ["file", "line"], "left").withColumn("text", F.coalesce(text_at("$.message.content"), F.col("block_text"), F.lit("")))
    prompts = spoken.where("type = 'user' and carries is null").select("session_key", "file_rank", "line", "uuid", "timestamp", "sidechain", "text")

    window = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    stamped = spoken.withColumn("prompt_uuid", F.last(F.when((F.col("type") == "user") & F.col("carries").isNull() & ~F.col("sidechain"), F.col("uuid")), ignorenulls=True).over(window))
    usage = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens", "cache_5m_tokens": "cache_creation.ephemeral_5m_input_tokens", "cache_1h_tokens": "cache_creation.ephemeral_1h_input_tokens"}
    turns = stamped.where("type = 'assistant'").withColumns({"model": text_at("$.message.model"), **{k: get(f"$.message.usage.{v}", "double") for k, v in usage.items()}})
    turns = turns.withColumns({k: counter(k) for k in usage}).select("session_key", "file_rank", "line", "uuid", "timestamp", "model", "sidechain", "prompt_uuid", "text", *usage)

    uses = blocks.where("type = 'assistant' and block_type = 'tool_use'").select("session_key", "file_rank", "line", "i", "uuid", "timestamp", text_at("$.id", "block").alias("tool_use_id"), text_at("$.name", "block").alias("name"), F.to_json(F.try_variant_get("block", "$.input", "variant")).alias("input"))
    uses = uses.where("tool_use_id is not null and name is not null")

    results = blocks.where("type = 'user' and block_type = 'tool_result'").select("session_key", "file_rank", "line", "i", "timestamp", text_at("$.tool_use_id", "block").alias("tool_use_id"), F.coalesce((kind_of("$.is_error", "block") == "BOOLEAN") & get("$.is_error", "boolean", F.col("block")), F.lit(False)).alias("is_error"), F.coalesce(text_at("$.content", "block"), F.to_json(F.try_variant_get("block", "$.content", "variant"))).alias("content"))
    # the last of a file, then the first file
    rest = F.struct("file_rank", "line", "timestamp", "is_error", "content")
    last = results.where("tool_use_id is not null").groupBy("session_key", "tool_use_id", "file_rank").agg(F.max_by(rest, F.struct("line", "i")).alias("r"))
    results = last.groupBy("session_key", "tool_use_id").agg(F.min_by("r", "file_rank").alias("r")).select("session_key", "tool_use_id", "r.*")

    def folded(df: DataFrame) -> DataFrame:
        """The first of each non-empty uuid in a session; those without one are all kept."""
        w = Window.partitionBy("session_key", "uuid").orderBy("file_rank", "line")
        return df.withColumn("k", F.row_number().over(w)).where("k = 1 or coalesce(uuid, '') = ''").drop("k")

    turns, prompts = folded(turns), folded(prompts)
    main = r.where("file_rank = 1")
    stamp = F.when(F.col("type").isin("user", "assistant"), F.col("timestamp"))
    sessions = main.groupBy("session_key", "project").agg(
        *[first_by_line(text_at(f"$.{f}")).alias(n) for f, n in (("sessionId", "session_id"), ("version", "version"), ("gitBranch", "git_branch"), ("cwd", "cwd"))],
        F.min_by(stamp, F.when(stamp.isNotNull(), F.col("line"))).alias("first_timestamp"),
        F.max_by(stamp, F.when(stamp.isNotNull(), F.col("line"))).alias("last_timestamp"),
        F.count("*").alias("messages"),
        F.count_if(F.col("record").isNull()).alias("skipped_lines"),
    )
    spine = turns.select("session_key").union(prompts.select("session_key")).distinct()
    return Sessions(sessions.join(spine, "session_key", "left_semi"), turns, uses, results, prompts, sessions.join(spine, "session_key", "left_anti"))


SNIFFED = 40  # lines that are looked at for a session's identity


def inventory(rows: DataFrame) -> DataFrame:
    """Every main transcript (project, session_key, file) with session_id, version, git_branch and cwd of its first lines, and its non-blank lines.

    A bounded look: only the first SNIFFED lines of a file are parsed, all are counted.
    """
    parts = F.split("file", "/")
    own = rows.where((F.element_at(parts, -2) != "subagents") & (F.trim("text") != "")).withColumn("record", F.when(F.col("line") < SNIFFED, F.try_parse_json("text")))
    own = own.withColumns({"project": F.element_at(parts, -2), "session_key": F.regexp_replace(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)), r"\.jsonl$", "")})
    named = [first_by_line(text_at(f"$.{f}")).alias(n) for f, n in (("sessionId", "session_id"), ("version", "version"), ("gitBranch", "git_branch"), ("cwd", "cwd"))]
    return own.groupBy("project", "session_key", "file").agg(*named, F.count("*").alias("messages"))


def in_project(sessions: DataFrame, root: str) -> DataFrame:
    """Sessions with in_project: true, false, or null where the working folder is unknown. A .. that leads out of the root is outside."""
    root = root.rstrip("/") or "/"
    inside = (F.col("cwd") == root) | F.startswith("cwd", F.lit(root.rstrip("/") + "/"))
    climbs = F.col("cwd").rlike(r"(?:^|/)\.\.(?:/|$)")
    return sessions.withColumn("in_project", F.when(F.col("cwd").isNotNull(), inside & ~climbs))


def scope_counts(sessions: DataFrame, root: str) -> DataFrame:
    """One row: sessions of a project, of others, and of an unknown working folder."""
    own = in_project(sessions, root)
    return own.agg(F.count_if("in_project").alias("in_scope"), F.count_if(~F.col("in_project")).alias("excluded_other_project"), F.count_if(F.col("in_project").isNull()).alias("excluded_unknown_cwd"))
