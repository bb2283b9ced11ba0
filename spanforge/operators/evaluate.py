"""Evaluation of a rule catalog against spans: a theta join without a join.

The catalog is compiled into one array expression per span, in catalog order, so the scan of the spans is the whole
plan: nothing is shuffled, and columns that no rule reads are pruned.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.required import FOLD, needed_by
from ..plans.rules import Condition, Config, Rule, Spans, condition_column, enabled, explain_column, rule_column

MATCH = "array<struct<rule_id:string,action:string,ord:int>>"


def labels_of(rule: Rule) -> tuple[str, ...] | None:
    """The label globs one of which a call must have for the rule to match; None where the rule doesn't tell."""
    m = rule.match
    if named := [c.label for c in m.all_of if c.label is not None]:
        return (named[0],)
    if m.any_of and all(c.label is not None for c in m.any_of):
        return tuple(dict.fromkeys(c.label for c in m.any_of))
    return None


def matches_column(rules: Iterable[Rule], spans: Spans) -> Column:
    """The matching rules in catalog order.

    Rules that need one of the same labels stand behind one test of the label, so a call's text is held only against
    the rules of its tool, and a rule's patterns behind a search for the texts of which its matches hold one (see
    needed_by), in the call's text folded once; that changes no result.
    """
    rules = list(rules)
    needed = [needed_by(r) for r in rules]
    text = F.concat_ws("\n", *[spans.col(c).cast("string") for c in (spans.detail, spans.mcp_input) if c])  # no needed text holds a line feed
    folded = F.lower(F.translate(text, *FOLD))
    return F.get(F.transform(F.array(folded if any(needed) else F.lit("")), lambda t: _matches(rules, needed, spans, t)), F.lit(0))


def _matches(rules: list[Rule], needed: list[frozenset[str] | None], spans: Spans, text: Column) -> Column:
    groups: dict[tuple[str, ...] | None, list[Column]] = {}
    made: dict[Condition, Column] = {}
    for i, r in enumerate(rules):
        may = [F.contains(text, F.lit(x)) for x in sorted(needed[i] or ())]
        fits = rule_column(r, spans, made)
        hit = F.when(functools.reduce(lambda a, b: a | b, may) & fits if may else fits, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.action).alias("action"), F.lit(i).alias("ord")))
        groups.setdefault(labels_of(r), []).append(hit)
    none, parts = F.array().cast(MATCH), []
    for labels, hits in groups.items():
        own = F.filter(F.array(*hits), lambda m: m.isNotNull()).cast(MATCH)
        if labels is not None:
            fits = functools.reduce(lambda a, b: a | b, [condition_column(Condition(label=x), spans) for x in labels])
            own = F.when(F.coalesce(fits, F.lit(False)), own).otherwise(none)
        parts.append(own)
    if not parts:
        return none
    return parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts), lambda a, b: a["ord"] - b["ord"])


def first_of(matches: Column, action: str) -> Column:
    return F.get(F.filter(matches, lambda m: m["action"] == action), F.lit(0))


def strictest_column(matches: Column) -> Column:
    """block, require_approval, warn or none."""
    has = lambda a: F.exists(matches, lambda m: m["action"] == a)
    return F.when(has("block"), "block").when(has("require_approval"), "require_approval").when(F.size(matches) > 0, "warn").otherwise("none")


def verdict_column(matches: Column) -> Column:
    """struct<verdict, policy_id>: the strongest verdict, and the first rule in catalog order that gives it."""
    block, ask = first_of(matches, "block"), first_of(matches, "require_approval")
    return F.struct(
        F.when(block.isNotNull(), "deny").when(ask.isNotNull(), "require_approval").otherwise("allow").alias("verdict"),
        F.when(block.isNotNull(), block["rule_id"]).otherwise(ask["rule_id"]).alias("policy_id"),
    )


def titled(rules: Iterable[Rule]) -> Callable[[Column], Column]:
    """The title of a match's rule, or its id."""
    known = {r.id: r.title for r in rules if r.title}
    if not known:
        return lambda m: m["rule_id"]
    named = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, " ".join(v.split()))])
    return lambda m: F.coalesce(named[m["rule_id"]], m["rule_id"])


def decision_column(matches: Column, title: Callable[[Column], Column]) -> Column:
    """struct<decision, reason>: deny, ask or allow, with the deciding rule's title; a warning is an allow with one."""
    block, ask, warn = (first_of(matches, a) for a in ("block", "require_approval", "warn"))
    return F.struct(
        F.when(block.isNotNull(), "deny").when(ask.isNotNull(), "ask").otherwise("allow").alias("decision"),
        F.when(block.isNotNull(), F.concat(F.lit("Blocked: "), title(block))).when(ask.isNotNull(), F.concat(F.lit("Needs approval: "), title(ask))).when(warn.isNotNull(), F.concat(F.lit("Warning: "), title(warn))).alias("reason"),
    )


def decided_columns(spans: DataFrame, title: Callable[[Column], Column]) -> DataFrame:
    """spans, which have matches, with strictest, verdict, policy_id, decision and reason."""
    out = spans.withColumn("strictest", strictest_column(F.col("matches")))
    out = out.withColumns({"__v": verdict_column(F.col("matches")), "__d": decision_column(F.col("matches"), title)})
    return out.select("*", "__v.verdict", "__v.policy_id", "__d.decision", "__d.reason").drop("__v", "__d")


def evaluate(spans: DataFrame, catalog: Iterable[Rule], config: Config | None = None, columns: Spans | None = None, explain: bool = False) -> DataFrame:
    """spans with matches, strictest, verdict, policy_id, decision and reason (and explain, by rule, if asked)."""
    rules, columns = enabled(catalog, config or Config()), columns or Spans()
    out = decided_columns(spans.withColumn("matches", matches_column(rules, columns)), titled(rules))
    if explain:
        out = out.withColumn("explain", F.map_from_arrays(F.array(*[F.lit(r.id) for r in rules]), F.array(*[explain_column(r, columns) for r in rules])))
    return out


def strictest_candidate(candidates: DataFrame, call: list[str], position: str, strictest: str = "strictest") -> DataFrame:
    """Of each call's candidates, the strictest; the earliest of equals."""
    rank = F.when(F.col(strictest) == "block", 3).when(F.col(strictest) == "require_approval", 2).when(F.col(strictest) == "warn", 1).otherwise(0)
    rest = [c for c in candidates.columns if c not in call]
    best = F.max_by(F.struct(*rest), F.struct(rank.alias("r"), (-F.col(position)).alias("p")))
    return candidates.groupBy(*call).agg(best.alias("__b")).select(*call, "__b.*")


def catalog_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The catalog as a table, with each rule's place in it."""
    rows = [(r.id, i, r.category, r.severity, r.action, r.title, r.description, list(r.owasp), r.source) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id string, ord int, category string, severity string, action string, title string, description string, owasp array<string>, source string")


def dimension(catalog: DataFrame) -> DataFrame:
    """One row for each rule id: the last of those that share it."""
    rest = [c for c in catalog.columns if c != "rule_id"]
    return catalog.groupBy("rule_id").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("rule_id", "r.*")


def listed(catalog: DataFrame, config: Config, packs: Iterable[str] = (), owasp: Iterable[str] = (), only: str | None = None) -> DataFrame:
    """The catalog with an enabled column, filtered by pack, by OWASP id and by only = 'enabled' or 'disabled'."""
    off = F.col("category").isin(*config.disabled_packs) if config.disabled_packs else F.lit(False)
    off = off | F.col("rule_id").isin(*config.disabled_rules) if config.disabled_rules else off
    pack_on = ~F.col("category").isin(*config.disabled_packs) if config.disabled_packs else F.lit(True)
    out = catalog.withColumns({"enabled": ~off, "pack_on": pack_on})
    packs, owasp = list(packs), list(owasp)
    if packs:
        out = out.where(F.col("category").isin(*packs))
    if owasp:
        out = out.where(F.arrays_overlap("owasp", F.array(*[F.lit(x) for x in owasp])))
    return out.where(F.col("enabled") == (only == "enabled")) if only else out
