"""Evaluation of large catalogs: an index of required literals names a call's candidate rules, and only these are tested.

evaluate() makes an expression of every rule, which suits the some hundred rules that people write by hand. Here rules are
rows. Of most rules a text is known that every match must hold, out of the texts of their conditions; one automaton over all of
them finds in one scan of a call which rules can match. Candidates are then tested in full by one expression over rows of
rules, so the plan does not grow with the catalog; rules without such a text are candidates of every call.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import PatternError, glob_to_java, js_to_java
from ..plans.required import folded, needed_by, required  # noqa: F401 (required: for who asks here)
from ..plans.rules import Condition, Config, Rule, Spans, enabled
from .evaluate import MATCH, decided_columns


class RuleIndex:
    """The candidates of a text, as numbers of rules."""

    def __init__(self, rules: list[Rule]):
        by: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(rules):
            texts = needed_by(r)
            for t in texts or ():
                by.setdefault(t, []).append(i)
            if texts is None:
                self.always.append(i)
        self.automaton = None
        if by:
            self.automaton = ahocorasick.Automaton()
            for t, own in by.items():
                self.automaton.add_word(t, tuple(own))
            self.automaton.make_automaton()

    def candidates(self, *texts: str | None) -> list[int]:
        found = set(self.always)
        for t in texts:
            if t and self.automaton is not None:
                for _, own in self.automaton.iter(folded(t)):
                    found.update(own)
        return sorted(found)


# -- rules as rows ----------------------------------------------------------------------------------------------------

CONDITION = "struct<kind:string,label:string,content:boolean,holds:array<string>,matches:array<string>,path:string,numbers:array<struct<field:string,op:string,value:double>>,never:boolean>"
RULES = f"ord:int,rule_id:string,action:string,title:string,agents:array<string>,projects:array<string>,all_of:array<{CONDITION}>,any_of:array<{CONDITION}>,none_of:array<{CONDITION}>,allow:array<string>"


def _java(glob: str | None, *fold: bool) -> tuple[str | None, bool]:
    """The pattern, and whether the glob is none that can match."""
    try:
        return (None if glob is None else glob_to_java(glob, *fold)), False
    except PatternError:
        return None, True


def _condition_row(c: Condition) -> dict:
    patterns = []
    for p in c.detail_matches:
        try:
            patterns.append(js_to_java(p))
        except PatternError:  # matches nothing
            pass
    (label, no_label), (path, no_path) = _java(c.label), _java(c.file_glob)
    channel = c.channel or ("content" if (c.label or "").startswith("mcp__") else "command")
    numbers = [{"field": n.field, "op": n.op, "value": float(n.value)} for n in c.numeric]
    never = no_label or no_path or (bool(c.detail_matches) and not patterns)
    return {"kind": c.kind and c.kind.lower(), "label": label, "content": channel == "content", "holds": c.detail_contains, "matches": patterns, "path": path, "numbers": numbers, "never": never}


def _rule_row(i: int, r: Rule) -> dict:
    scope = lambda s: None if "*" in s else s
    parts = {k: [_condition_row(c) for c in getattr(r.match, k)] for k in ("all_of", "any_of", "none_of")}
    allow = [x for g in r.allow if (x := _java(g, False)[0]) is not None]
    return {"ord": i, "rule_id": r.id, "action": r.action, "title": " ".join(r.title.split()) or r.id, "agents": scope(r.agent_in), "projects": scope(r.project_in), **parts, "allow": allow}


def _fits(c: Column, spans: Spans) -> Column:
    """Whether a span fulfils a condition row."""
    command = spans.col(spans.detail).cast("string")
    content = F.coalesce(spans.col(spans.mcp_input).cast("string"), command) if spans.mcp_input else command
    text = F.when(c["content"], content).otherwise(command)
    sure = lambda x: F.coalesce(x, F.lit(False))
    unless = lambda given, test: given.isNull() | sure(test)

    def number(n: Column) -> Column:
        value = F.lit(None).cast("double")
        for name in ("tokens", "cached_tokens", "duration_ms"):
            value = F.when(n["field"] == name, spans.col(getattr(spans, name), 0).cast("double")).otherwise(value)
        return sure(F.when(n["op"] == "gt", value > n["value"]).when(n["op"] == "gte", value >= n["value"]).when(n["op"] == "lt", value < n["value"]).otherwise(value <= n["value"]))

    return (
        ~c["never"] & unless(c["kind"], F.lower(spans.col(spans.kind)) == c["kind"]) & unless(c["label"], F.rlike(spans.col(spans.label).cast("string"), c["label"]))
        & F.forall(c["holds"], lambda x: sure(F.contains(text, x))) & ((F.size(c["matches"]) == 0) | F.exists(c["matches"], lambda p: sure(F.rlike(text, p))))
        & unless(c["path"], F.rlike(spans.col(spans.file_path).cast("string"), c["path"])) & F.forall(c["numbers"], number)
    )


def _hit(r: Column, spans: Spans) -> Column:
    inside = lambda some, column: some.isNull() | F.coalesce(F.array_contains(some, spans.col(column).cast("string")), F.lit(False))
    raw = spans.col(spans.raw_path or spans.file_path).cast("string")
    lets = F.exists(r["allow"], lambda p: F.coalesce(F.rlike(spans.col(spans.detail).cast("string"), p), F.lit(False)) | F.coalesce(F.rlike(raw, p), F.lit(False)))
    fits = lambda c: _fits(c, spans)
    some = (F.size(r["any_of"]) == 0) | F.exists(r["any_of"], fits)
    return inside(r["agents"], spans.agent) & inside(r["projects"], spans.project) & F.forall(r["all_of"], fits) & some & ~F.exists(r["none_of"], fits) & ~lets


def evaluate_indexed(spans: DataFrame, catalog: Iterable[Rule], config: Config | None = None, columns: Spans | None = None) -> DataFrame:
    """As evaluate(), for catalogs of thousands of rules; one Arrow pass over the texts names the candidates."""
    rules, columns = enabled(catalog, config or Config()), columns or Spans()
    spark = spans.sparkSession
    index = spark.sparkContext.broadcast(RuleIndex(rules))

    def run(detail: pa.Array, content: pa.Array) -> pa.Array:
        find = index.value.candidates
        return pa.array([find(a, b) for a, b in zip(detail.to_pylist(), content.to_pylist(), strict=True)], pa.list_(pa.int32()))

    detail = columns.col(columns.detail).cast("string")
    content = columns.col(columns.mcp_input).cast("string") if columns.mcp_input else F.lit(None).cast("string")
    # a constant of the plan, which is read once when the query is planned
    rows = F.from_json(F.lit(json.dumps([_rule_row(i, r) for i, r in enumerate(rules)])), f"array<struct<{RULES}>>")
    named = F.arrow_udf(run, "array<int>")(detail, content)
    own = spans.withColumn("__candidates", named)
    tested = F.filter(F.transform("__candidates", lambda i: F.get(rows, i)), lambda r: _hit(r, columns))
    matches = F.transform(tested, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["action"].alias("action"), r["ord"].alias("ord"))).cast(MATCH)
    return decided_columns(own.withColumn("matches", matches).drop("__candidates"), lambda m: F.get(rows, m["ord"])["title"])
