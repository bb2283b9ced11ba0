"""What is asked about rules and configurations before they are used: lints, allow patterns, fixtures."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import PatternError, glob_to_java
from ..plans.rules import Config, Rule, RuleError, Spans, rule_of
from ..sources.jsonl import number_lines
from ..sources.shared import Store
from .evaluate import evaluate

# Commands and paths of everyday work: a pattern that lets one of them pass is too broad.
CANARIES = ("pwd", "date", "npm run lint", "git log --oneline", "grep -n main app.py", "mkdir -p notes", "lib/util.go", "notes/today.txt", "make check")


def lint(rule: Rule) -> list[str]:
    """What a rule's author may not have meant."""
    out = []
    for group in ("any_of", "all_of", "none_of"):
        for i, c in enumerate(getattr(rule.match, group)):
            at = f"{group}[{i}]"
            for name in ("label", "file_glob"):
                if (g := getattr(c, name)) and re.search(r"\{[^{},]*\}", g) and not re.search(r"\{-?\d+\.\.-?\d+\}", g):
                    out.append(f"{at}: a brace with one arm in {name} stands for itself")
            if group != "none_of" and c.label in (None, "*", "**") and not (c.detail_contains or c.detail_matches or c.file_glob or c.numeric):
                out.append(f"{at}: matches every call")
            if c.numeric:
                out.append(f"{at}: calls carry no token counts or durations of their own")
            for name in ("label", "file_glob"):
                try:
                    if g := getattr(c, name):
                        glob_to_java(g)
                except PatternError as e:
                    out.append(f"{at}: {name} never matches ({e})")
    if not rule.agent_in or not rule.project_in:
        out.append("an empty scope matches nothing")
    return out


RULE_ROW = "struct<id:string,category:string,severity:string,action:string,title:string,owasp:array<string>,data:string,problem:string,lints:array<string>>"


def read_rules(rows: DataFrame, text: str = "rule", source: str = "yours") -> DataFrame:
    """rows with `read`: what a rule's JSON text says, as data that reads again as the same rule, why it is no rule, and its lints.

    Rules are read by the tasks that hold their texts, so a table of them may be of any size.
    """

    def one(t: str | None) -> dict:
        try:
            rule = rule_of(json.loads(t or ""), source)
        except (RuleError, ValueError, AttributeError, TypeError) as e:
            return {"problem": str(e) or type(e).__name__, "lints": []}
        shown = {"id": rule.id, "category": rule.category, "severity": rule.severity, "action": rule.action, "title": rule.title, "owasp": list(rule.owasp)}
        return {**shown, "data": json.dumps(export([rule])[0], ensure_ascii=False), "lints": lint(rule)}

    kind = pa.struct([*((n, pa.string()) for n in ("id", "category", "severity", "action", "title")), ("owasp", pa.list_(pa.string())), ("data", pa.string()), ("problem", pa.string()), ("lints", pa.list_(pa.string()))])
    read = F.arrow_udf(lambda texts: pa.array([one(t) for t in texts.to_pylist()], kind), RULE_ROW)
    return rows.withColumn("read", read(text))


def _java_glob(patterns: pa.Array) -> pa.Array:
    def one(p: str | None) -> str | None:
        try:
            return glob_to_java(p, False) if p else None
        except PatternError:
            return None

    return pa.array([one(p) for p in patterns.to_pylist()], pa.string())


def refusals(rows: DataFrame, pattern: str = "pattern", block: str | None = None, most: int = 0) -> DataFrame:
    """rows with `refusal`: why a pattern may not be allowed for a rule, or null if it may.

    block: a column with an array of commands and paths that the rule exists to catch. most: everyday calls that may pass.
    """
    text = F.trim(F.coalesce(pattern, F.lit("")))
    passes = lambda calls: F.size(F.filter(calls, lambda c: F.coalesce(F.rlike(c, F.col("__java")), F.lit(False))))
    caught = F.coalesce(F.col(block), F.array().cast("array<string>")) if block else F.array().cast("array<string>")
    everyday = F.array(*[F.lit(c) for c in CANARIES])
    own = rows.withColumn("__java", F.arrow_udf(_java_glob, "string")(text))
    own = own.withColumns({"__blind": passes(caught), "__broad": passes(everyday)})
    hole = r"(?i)^(?:<[\w -]+>|\.{3}|todo|example|placeholder|pattern)$"
    hidden = r"(?i)<(?:path|value|secret|email|redacted)[^>]*>|\[redacted\]"
    why = (
        F.when(text == "", "empty").when(text.rlike(hole), "a placeholder").when(text.rlike(hidden), "holds redacted text").when(F.col("__java").isNull(), "not a pattern")
        .when(F.col("__blind") > 0, F.format_string("blinds the rule: %d of %d of its own examples would pass", F.col("__blind"), F.size(caught)))
        .when(F.col("__broad") > most, F.format_string("too broad: %d of %d everyday calls pass", F.col("__broad"), F.lit(len(CANARIES))))
        .when(F.regexp_replace(text, r"[*?{}\[\]()|!@+\\/. ]", "") == "", "lets every call of the rule pass")
    )
    return own.withColumn("refusal", why).drop("__java", "__blind", "__broad")


def refuse_allow(spark: SparkSession, pattern: str, rule: Rule, block: Iterable[str] = (), most: int = 0) -> str | None:
    """Why one pattern may not be allowed for a rule; None if it may (see refusals)."""
    rows = spark.createDataFrame([(pattern, list(block))], "pattern string, block array<string>")
    return refusals(rows, "pattern", "block", most).first()["refusal"]


def check_fixtures(spark: SparkSession, rule: Rule, block: Iterable[dict], allow: Iterable[dict]) -> DataFrame:
    """Examples {tool, command | file_path} that a rule must and must not match: a row for each that it gets wrong."""
    rows = [(e.get("tool"), e.get("command"), e.get("file_path"), must) for must, part in ((True, block), (False, allow)) for e in part]
    df = spark.createDataFrame(rows, "tool string, command string, file_path string, must boolean")
    spans = Spans(kind="'execute_tool'", label="tool", detail="command", mcp_input=None, file_path="file_path", agent=None, project=None, tokens=None, cached_tokens=None, duration_ms=None)
    out = evaluate(df, [rule], Config(), spans).withColumn("matched", F.size("matches") > 0)
    return out.where("matched <> must").select("tool", "command", "file_path", "must", "matched")


def _known(values: DataFrame) -> list[str]:
    """The values, the longest first."""
    known = sorted({r[0] for r in values.limit(1001).collect() if r[0]}, key=lambda v: (-len(v), v))
    if len(known) > 1000:
        raise ValueError("more than 1,000 values: scrub in several passes")
    return known


def _spelled(value: str) -> list[str]:
    """A value as JSON may write it."""
    plain = json.dumps(value, ensure_ascii=False)[1:-1]
    return list(dict.fromkeys((json.dumps(value)[1:-1], plain, plain.replace("/", r"\/"))))


def _spellings(values: DataFrame) -> list[str]:
    return [x for v in _known(values) for x in dict.fromkeys([v, *_spelled(v)])]


def scrub_plan(lines: DataFrame, values: DataFrame, mark: str = "<removed>") -> DataFrame:
    """Lines (file, line, text) with known values replaced in their three JSON spellings; `changed`, and whether any is left.

    values: one column `value`, of a few strings (a checked bound), which are compiled into the plan.
    """
    known = _known(values)
    out = F.col("text")
    for v in known:
        for spelled in _spelled(v):
            out = F.replace(out, F.lit(spelled), F.lit(mark))
    left = F.lit(False)
    for v in known:
        left = left | F.contains(F.col("scrubbed"), F.lit(v))
    done = lines.withColumn("scrubbed", out)
    return done.withColumns({"changed": F.col("scrubbed") != F.col("text"), "left": left, "valid": F.try_parse_json("text").isNull() | F.try_parse_json("scrubbed").isNotNull()})


def scrub_stage(plan: DataFrame, folder: str) -> str:
    """Write a plan's scrubbed lines beside a folder that is to be, one text file a file: <staged>/file=<name>/part-* in their order. Nothing is read from there yet."""
    staged = f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}"
    plan.select("file", "line", "scrubbed").repartition("file").sortWithinPartitions("file", "line").select("file", F.col("scrubbed").alias("value")).write.partitionBy("file").text(staged)
    return staged


def _digest(rows: DataFrame, line: str, text: str, *more: Column) -> DataFrame:
    """By file: its lines, and a sum over hashes of each line with its number, which any change, loss or exchange of lines changes."""
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.xxhash64(F.col(line).cast("long"), F.col(text)).cast("decimal(38,0)")).alias("digest"), *more)


def scrub_commit(plan: DataFrame, staged: str, folder: str, values: DataFrame | None = None) -> DataFrame:
    """Read the staged copy back, compare it with the plan, and give it its name by one rename; a copy that fails goes.

    A copy fails if a file's lines are not those of the plan in their order, if a line holds one of the values (a column
    `value`) still, if a line is no JSON any more that was before, and if the folder is taken. Result: file, lines, changed.
    """
    spark, store = plan.sparkSession, Store(plan.sparkSession)
    ranked = plan.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    wanted = _digest(ranked, "at", "scrubbed", F.count_if("changed").alias("changed"), F.count_if(~F.col("valid")).alias("invalid"))
    copy = spark.read.schema("value string, file string").option("lineSep", "\n").text(staged).select("value", F.col("file").alias("name"), "_metadata")
    found = number_lines(copy).select(F.col("name").alias("file"), "line", "value")
    left = F.lit(False)
    for v in _spellings(values) if values is not None else ():
        left = left | F.contains("value", F.lit(v))
    got = _digest(found, "line", "value", F.count_if(left).alias("left")).select("file", F.col("lines").alias("got_lines"), F.col("digest").alias("got_digest"), "left")
    same = F.col("lines").eqNullSafe(F.col("got_lines")) & F.col("digest").eqNullSafe(F.col("got_digest"))
    report = wanted.join(got, "file", "full_outer").withColumn("bad", ~same | (F.coalesce("left", F.lit(0)) > 0) | (F.coalesce("invalid", F.lit(0)) > 0))
    bad = report.where("bad").orderBy("file").limit(3).collect()
    if bad or not store.rename(staged, folder):
        store.delete(staged)
        raise ScrubError(f"not committed: {', '.join(str(r['file']) for r in bad)}" if bad else f"{folder} is there already")
    return wanted.select("file", "lines", "changed")


class ScrubError(RuntimeError):
    """A scrubbed copy that is not what it should be."""


def scrub_write(plan: DataFrame, folder: str, values: DataFrame | None = None) -> DataFrame:
    """Write a plan's scrubbed lines below a new folder, whole or not at all (see scrub_stage and scrub_commit). Files are never changed in place."""
    staged = scrub_stage(plan, folder)
    done = scrub_commit(plan, staged, folder, values)
    return done.withColumns({"lines_left": F.lit(0).cast("long"), "lines_invalid": F.lit(0).cast("long")})


def export(rules: Iterable[Rule], disabled: Iterable[str] = ()) -> list[dict]:
    """Rules as the data that rules_of() reads, without those that are disabled."""
    off = set(disabled)
    condition = lambda c: {k: ([{"field": n.field, "op": n.op, "value": n.value} for n in v] if k == "numeric" else list(v) if isinstance(v, tuple) else v) for k, v in vars(c).items() if v not in (None, ())}
    return [
        {"id": r.id, "category": r.category, "severity": r.severity, "defaultAction": r.action, "title": r.title, "description": r.description, "owasp": list(r.owasp), "match": {g: [condition(c) for c in own] for g in ("all_of", "any_of", "none_of") if (own := getattr(r.match, g))}}
        for r in rules if r.id not in off
    ]
