"""The rule language: records, validation, and compilation to columns.

A rule is data. `match` holds any_of / all_of / none_of lists of conditions; every field that a condition has must
hold. Compiled against a table of spans, a rule is one boolean column: no rule is interpreted row by row.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import PatternError, glob_to_java, js_to_java, nested_quantifier

# The vocabulary of the rule language.
KINDS = ("llm", "execute_tool", "retrieval", "embedding", "agent", "internal")
SEVERITIES = ("critical", "high", "medium", "low", "info")
ACTIONS = ("block", "require_approval", "warn")
CHANNELS = ("content", "command")
NUMERIC_FIELDS = ("tokens", "cached_tokens", "duration_ms")
OPERATORS = ("gt", "gte", "lt", "lte")
MAX_PATTERNS, MAX_PATTERN_CHARS = 10, 320

_COMPARE: dict[str, Callable] = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


class RuleError(ValueError):
    """A rule that is not valid."""


@dataclass(frozen=True)
class Numeric:
    field: str
    op: str
    value: float


@dataclass(frozen=True)
class Condition:
    kind: str | None = None
    label: str | None = None
    detail_contains: tuple[str, ...] = ()
    detail_matches: tuple[str, ...] = ()
    file_glob: str | None = None
    numeric: tuple[Numeric, ...] = ()
    channel: str | None = None


@dataclass(frozen=True)
class Match:
    any_of: tuple[Condition, ...] = ()
    all_of: tuple[Condition, ...] = ()
    none_of: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    match: Match
    category: str = "user"
    severity: str = "medium"
    action: str = "warn"
    title: str = ""
    description: str = ""
    owasp: tuple[str, ...] = ()
    agent_in: tuple[str, ...] = ("*",)
    project_in: tuple[str, ...] = ("*",)
    source: str = "library"
    allow: tuple[str, ...] = field(default=())  # globs of commands or paths that this rule lets pass


def _texts(value, what: str) -> tuple[str, ...]:
    if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) and x for x in value):
        raise RuleError(f"{what} must be a list of non-empty strings")
    if len(value) > MAX_PATTERNS or any(len(x) > MAX_PATTERN_CHARS for x in value):
        raise RuleError(f"{what} takes {MAX_PATTERNS} patterns of {MAX_PATTERN_CHARS} characters at most")
    return tuple(value)


def _condition(data: dict) -> Condition:
    known = {"kind", "label", "detail_contains", "detail_matches", "file_glob", "numeric", "channel"}
    if not isinstance(data, dict) or not data:
        raise RuleError("a condition must be a non-empty object")
    if extra := set(data) - known:
        raise RuleError(f"unknown keys in a condition: {sorted(extra)}")
    numeric = []
    for n in data.get("numeric", ()):
        if set(n) != {"field", "op", "value"} or n["field"] not in NUMERIC_FIELDS or n["op"] not in OPERATORS or isinstance(n["value"], bool) or not isinstance(n["value"], (int, float)):
            raise RuleError(f"not a numeric condition: {n}")
        numeric.append(Numeric(n["field"], n["op"], n["value"]))
    out = Condition(data.get("kind"), data.get("label"), _texts(data.get("detail_contains", ()), "detail_contains"), _texts(data.get("detail_matches", ()), "detail_matches"), data.get("file_glob"), tuple(numeric), data.get("channel"))
    if out.kind is not None and out.kind.lower() not in KINDS:
        raise RuleError(f"unknown kind {out.kind!r}")
    if out.channel is not None and out.channel not in CHANNELS:
        raise RuleError(f"unknown channel {out.channel!r}")
    for p in out.detail_matches:
        if nested_quantifier(p):
            raise RuleError(f"nested unbounded quantifiers: {p!r}")
        try:
            js_to_java(p)
        except PatternError as e:
            raise RuleError(f"{p!r}: {e}") from e
    return out


def match_of(data: dict) -> Match:
    if not isinstance(data, dict) or set(data) - {"any_of", "all_of", "none_of"}:
        raise RuleError("match takes any_of, all_of and none_of")
    parts = {k: tuple(_condition(c) for c in v) for k, v in data.items()}
    if not parts.get("any_of") and not parts.get("all_of"):
        raise RuleError("match needs any_of or all_of")
    return Match(**parts)


def rule_of(data: dict, source: str = "yours") -> Rule:
    """A rule from its data; what is left out takes its default, unknown keys are refused."""
    known = {"id", "category", "severity", "defaultAction", "title", "description", "match", "owasp", "scope", "fixtures"}
    if extra := set(data) - known:
        raise RuleError(f"unknown keys in a rule: {sorted(extra)}")
    if not isinstance(data.get("id"), str) or not data["id"].strip():
        raise RuleError("a rule needs an id")
    severity, action = data.get("severity", "medium"), data.get("defaultAction", "warn")
    if severity not in SEVERITIES or action not in ACTIONS:
        raise RuleError(f"unknown severity or action in {data['id']}")
    scope = data.get("scope", {})
    return Rule(data["id"], match_of(data.get("match", {})), data.get("category", "user"), severity, action, data.get("title") or data["id"], data.get("description", ""), tuple(data.get("owasp", ())), tuple(scope.get("agent_in", ("*",))), tuple(scope.get("project_in", ("*",))), source)


def rules_of(data: Iterable[dict], source: str = "yours") -> tuple[list[Rule], list[str]]:
    """The valid rules, and why each of the others is none."""
    good, bad = [], []
    for i, d in enumerate(data):
        try:
            good.append(rule_of(d, source))
        except (RuleError, TypeError, AttributeError) as e:
            bad.append(f"rule {i}: {e}")
    return good, bad


@dataclass(frozen=True)
class Config:
    """What a project switches off or changes; unreadable entries are left out, so more is enforced, not less."""

    disabled_packs: frozenset[str] = frozenset()
    disabled_rules: frozenset[str] = frozenset()
    actions: tuple[tuple[str, str], ...] = ()
    allow: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, data: dict | None) -> Config:
        data = data if isinstance(data, dict) else {}
        listed = lambda k: frozenset(x for x in data.get(k, ()) if isinstance(x, str)) if isinstance(data.get(k), list) else frozenset()
        over = data.get("guardrailActionOverrides")
        actions = tuple((k, v) for k, v in over.items() if v in ACTIONS) if isinstance(over, dict) else ()
        entries = data.get("allowlist")
        allow = tuple((e["guardrail"], e["pattern"]) for e in entries if isinstance(e, dict) and isinstance(e.get("guardrail"), str) and isinstance(e.get("pattern"), str)) if isinstance(entries, list) else ()
        return cls(listed("disabledPacks"), listed("disabledGuardrails"), actions, allow)


def enabled(catalog: Iterable[Rule], config: Config) -> list[Rule]:
    """The catalog's rules in order, less what config disables, with its actions and allow patterns."""
    out = []
    actions = dict(config.actions)
    for r in catalog:
        if r.category in config.disabled_packs or r.id in config.disabled_rules:
            continue
        out.append(replace(r, action=actions.get(r.id, r.action), allow=tuple(p for g, p in config.allow if g == r.id)))
    return out


# -- compilation --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spans:
    """Which columns of a table hold a span's fields; any may be an expression."""

    kind: str = "kind"
    label: str = "label"
    detail: str = "detail"
    mcp_input: str | None = "mcp_input"
    file_path: str | None = "file_path"
    raw_path: str | None = None  # the path as it was given, if file_path is normalised
    agent: str | None = "agent_id"
    project: str | None = "project_id"
    tokens: str | None = "tokens"
    cached_tokens: str | None = "cached_tokens"
    duration_ms: str | None = "duration_ms"

    def col(self, name: str | None, default=None) -> Column:
        return F.expr(name) if name else F.lit(default)


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _safe(build: Callable[[], Column]) -> Column:
    """A pattern that doesn't compile matches nothing."""
    try:
        return build()
    except PatternError:
        return F.lit(False)


def condition_column(c: Condition, spans: Spans) -> Column:
    parts: list[Column] = []
    if c.kind is not None:
        parts.append(F.lower(spans.col(spans.kind)) == c.kind.lower())
    if c.label is not None:
        parts.append(_safe(lambda: spans.col(spans.label).rlike(glob_to_java(c.label))))
    command = spans.col(spans.detail)
    content = F.coalesce(spans.col(spans.mcp_input).cast("string"), command) if spans.mcp_input else command
    channel = c.channel or ("content" if (c.label or "").startswith("mcp__") else "command")
    text = content if channel == "content" else command
    parts += [_holds(F.contains(text, F.lit(x))) for x in c.detail_contains]
    if c.detail_matches:
        parts.append(functools.reduce(operator.or_, [_safe(lambda p=p: _holds(text.rlike(js_to_java(p)))) for p in c.detail_matches]))
    if c.file_glob is not None:
        parts.append(_safe(lambda: spans.col(spans.file_path).rlike(glob_to_java(c.file_glob))))
    for n in c.numeric:
        parts.append(_COMPARE[n.op](spans.col(getattr(spans, n.field), 0), n.value))
    return functools.reduce(operator.and_, [_holds(p) for p in parts], F.lit(True))


def rule_column(rule: Rule, spans: Spans, made: dict[Condition, Column] | None = None) -> Column:
    """Whether a span is a match of the rule, scope and allow patterns included. Never null. made: columns of conditions that rules share."""
    out, made = F.lit(True), {} if made is None else made
    for scope, column in ((rule.agent_in, spans.agent), (rule.project_in, spans.project)):
        if "*" not in scope:
            out = out & _holds(spans.col(column).isin(*scope)) if scope else out & F.lit(False)
    m = rule.match
    if m.all_of:
        out = out & functools.reduce(operator.and_, [condition_column(c, spans) for c in m.all_of])
    if m.any_of:
        out = out & functools.reduce(operator.or_, [condition_column(c, spans) for c in m.any_of])
    for c in m.none_of:
        if c not in made:
            made[c] = condition_column(c, spans)
        out = out & ~made[c]
    raw = spans.col(spans.raw_path or spans.file_path)
    for p in rule.allow:
        allowed = _safe(lambda p=p: _holds(spans.col(spans.detail).rlike(glob_to_java(p, False))) | _holds(raw.rlike(glob_to_java(p, False))))
        out = out & ~allowed
    return out


def condition_reasons(c: Condition, spans: Spans) -> list[tuple[str, Column]]:
    """Each field of a condition with the column that decides it, in the order in which they are tried."""
    one = lambda **k: condition_column(Condition(channel=c.channel, **k), spans)
    out = []
    if c.kind is not None:
        out.append((f"kind is {c.kind}", one(kind=c.kind)))
    if c.label is not None:
        out.append((f"label matches {c.label}", one(label=c.label)))
    scoped = {"label": c.label} if (c.label or "").startswith("mcp__") and not c.channel else {}
    if c.detail_contains:
        out.append((f"detail contains {', '.join(c.detail_contains)}", one(detail_contains=c.detail_contains, **scoped)))
    if c.detail_matches:
        out.append((f"detail matches {' or '.join(c.detail_matches)}", one(detail_matches=c.detail_matches, **scoped)))
    if c.file_glob is not None:
        out.append((f"file matches {c.file_glob}", one(file_glob=c.file_glob)))
    out += [(f"{n.field} {n.op} {n.value:g}", one(numeric=(n,))) for n in c.numeric]
    return out


def explain_column(rule: Rule, spans: Spans) -> Column:
    """For each condition, the first of its fields that fails, or that it holds: an array of strings."""
    rows = []
    for group in ("all_of", "any_of", "none_of"):
        for i, c in enumerate(getattr(rule.match, group)):
            say = F.lit(f"{group}[{i}]: holds")
            for text, column in reversed(condition_reasons(c, spans)):
                say = F.when(~column, F.lit(f"{group}[{i}]: not {text}")).otherwise(say)
            rows.append(say)
    return F.array(*rows)
