"""Aggregations over evaluated calls: findings, recurring shapes, tallies, token totals.

Calls are counted in `decided` and `risky_by_action`; matches are counted in `findings` and `match_tally`.
Input tables have `matches` (see evaluate); all group keys are pre-aggregated by Spark before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import ACTIONS, SEVERITIES


def rank_of(column: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; unknown values come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(column == v, i).otherwise(out)
    return out


def alphabetical(column: str | Column) -> list[Column]:
    """Sort keys of a text in the order of Unicode's collation: letters first, then accents, then case. What it takes for equal goes by code points."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.collate(c, "UNICODE"), c]


def risky_by_action(calls: DataFrame) -> DataFrame:
    """One row: calls, risky ones, and these by their strictest action."""
    by = [F.count_if(F.col("strictest") == a).alias(a) for a in ACTIONS]
    return calls.agg(F.count("*").alias("tool_calls"), F.count_if(F.size("matches") > 0).alias("risky"), *by)


def decided(calls: DataFrame) -> DataFrame:
    """Calls by strictest action and the sorted set of rules that gave it (joined by commas)."""
    ids = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["action"] == F.col("strictest")), lambda m: m["rule_id"])))
    risky = calls.where(F.size("matches") > 0)
    return risky.groupBy(F.col("strictest").alias("action"), F.array_join(ids, ",").alias("rule_ids")).agg(F.count("*").alias("calls"))


def match_rows(calls: DataFrame, *columns: str) -> DataFrame:
    """A row for each match, with the named columns of its call.

    explode_outer, since of explode Spark infers a filter on the array, which it evaluates twice more below every exchange.
    """
    return calls.select(*columns, F.explode_outer("matches").alias("m")).where("m is not null").select(*columns, "m.rule_id", "m.action", "m.ord")


def findings(calls: DataFrame, shape: str, examples: int = 3) -> DataFrame:
    """By rule: matches, and the most frequent shapes with their counts (ties by text), `more` counting the rest."""
    ranked = ranked_shapes(match_rows(calls, shape).groupBy("rule_id", shape).agg(F.count("*").alias("n")), "rule_id", shape)
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.struct("k", F.col(shape).alias("shape"), "n"))))
    out = ranked.groupBy("rule_id").agg(F.sum("n").alias("matches"), F.count("*").alias("shapes"), top.alias("top"))
    return out.select("rule_id", "matches", F.transform("top", lambda t: F.struct(t["shape"].alias("shape"), t["n"].alias("n"))).alias("examples"), F.greatest(F.lit(0), F.col("shapes") - examples).alias("more"))


def ranked_shapes(counted: DataFrame, key: str, shape: str, n: str = "n") -> DataFrame:
    """counted with k: the place of a shape among its key's, the most frequent first, ties in alphabetical order."""
    return counted.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(n), *alphabetical(shape))))


def recurring(calls: DataFrame, call_id: str, shape: str, least: int = 2) -> DataFrame:
    """(rule, shape) found `least` times or more; calls: distinct calls that have the shape under any rule."""
    rows = match_rows(calls, call_id, shape)
    counted = rows.groupBy("rule_id", shape).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # one row a call and shape before counting, so a rule's repeats don't matter
    by_shape = calls.where(F.size("matches") > 0).groupBy(shape).agg(F.countDistinct(call_id).alias("calls"))
    return counted.join(by_shape, shape).select("rule_id", shape, "n", "calls")


def owasp_tally(calls: DataFrame, call_id: str, dimension: DataFrame) -> DataFrame:
    """By risk id: calls (one row each, told apart by call_id), matches, and rules with a match."""
    ids = dimension.select("rule_id", F.explode(F.array_distinct("owasp")).alias("owasp_id"))
    # a call's ids are made distinct within its row, so calls are counted without being told apart
    own = {r["rule_id"]: list(r["owasp"] or []) for r in dimension.select("rule_id", "owasp").collect()}  # as many rows as the catalog
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x]).cast("array<string>") for kv in own.items() for x in kv])
    per_call = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.coalesce(F.try_element_at(known, m["rule_id"]), F.array().cast("array<string>")))))
    counted = calls.where(F.size("matches") > 0).select(per_call.alias("ids"))
    by_id = counted.select(F.explode("ids").alias("owasp_id")).groupBy("owasp_id").agg(F.count("*").alias("calls"))
    rules = match_rows(calls).groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(ids), "rule_id").groupBy("owasp_id").agg(F.sum("n").alias("matches"), F.count("*").alias("rules"))
    return by_id.join(rules, "owasp_id")


def match_tally(calls: DataFrame, dimension: DataFrame) -> DataFrame:
    """Matches by severity (critical first) and action; none without a match."""
    rows = match_rows(calls).groupBy("rule_id", "action").agg(F.count("*").alias("n"))
    out = rows.join(F.broadcast(dimension.select("rule_id", "severity")), "rule_id", "left").groupBy("severity", "action").agg(F.sum("n").alias("matches"))
    return out.withColumn("severity_rank", rank_of(F.col("severity"), SEVERITIES))


def counter(column: str) -> Column:
    """A token counter as it is counted: floored, and 0 for null, NaN, infinite and negative values."""
    c = F.col(column).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf")), F.floor(c)).otherwise(F.lit(0)).cast("long")


def token_totals(turns: DataFrame, keys: tuple[str, ...] = (), fields: tuple[str, ...] = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")) -> DataFrame:
    """Sums of the clamped counters, their total, and the number of turns."""
    sums = [F.sum(counter(f)).alias(f) for f in fields]
    out = turns.groupBy(*keys).agg(*sums, F.count("*").alias("turns"))
    total = sum((F.coalesce(F.col(f), F.lit(0)) for f in fields[1:]), F.coalesce(F.col(fields[0]), F.lit(0)))
    return out.withColumn("total_tokens", total)


def no_match_share(calls: DataFrame) -> DataFrame:
    """The share of calls without a match in per cent, floored to a tenth; null without calls."""
    return calls.agg((F.floor(F.count_if(F.size("matches") == 0) * 1000 / F.nullif(F.count("*"), F.lit(0))) / 10).alias("no_match_percent"))


def most_frequent_match(log: DataFrame, rule: str = "rule_id", command: str = "command", order: str = "line") -> DataFrame:
    """The most frequent rule (ties to the smaller id) and its most frequent command (ties to the first seen)."""
    pairs = log.where(F.col(rule).isNotNull()).groupBy(rule, command).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rules = pairs.groupBy(rule).agg(F.sum("n").alias("matches"), F.min_by(command, F.struct((-F.col("n")).alias("n"), "first")).alias(command))
    return rules.agg(F.min_by(F.struct(rule, command, "matches"), F.struct((-F.col("matches")).alias("n"), F.col(rule))).alias("r")).where("r is not null").select("r.*")


def recent_counts(log: DataFrame, now: Column, days: int, agents: tuple[str, ...] | None = None, ts: str = "ts", decision: str = "decision") -> DataFrame:
    """Asks and blocks in the `days` before now; later rows and rows without a readable time don't count."""
    t = F.try_to_timestamp(F.col(ts).cast("string"))
    rows = log.where((t > now - F.expr(f"INTERVAL {days} DAYS")) & (t <= now))
    if agents is not None:
        rows = rows.where(F.col("agent").isin(*agents))
    return rows.agg(F.count_if(F.col(decision) == "ask").alias("asks"), F.count_if(F.col(decision) == "deny").alias("blocks"))


def stepped_aside_projects(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Distinct projects with a stepped-aside record in the window."""
    t = F.try_to_timestamp("ts")
    return log.where((F.col("event") == "stepped-aside") & (t > now - F.expr(f"INTERVAL {days} DAYS")) & (t <= now)).agg(F.countDistinct("project").alias("projects"))


def unmapped_tools(calls: DataFrame, name: str = "name") -> DataFrame:
    return calls.where("kind = 'unmapped'").groupBy(name).agg(F.count("*").alias("calls"))


def tuning_hint(decided_rows: list[dict], most: int = 3, share: float = 0.6, least: int = 5) -> dict | None:
    """Of the (small) decided table: at most `most` ask rules that would remove `share` of all asks, chosen greedily.

    A call's ask goes only when all the rules that ask for it are switched off.
    """
    asks = [(frozenset(r["rule_ids"].split(",")), r["calls"]) for r in decided_rows if r["action"] == "require_approval"]
    total = sum(n for _, n in asks)
    if total < least:
        return None
    off: frozenset[str] = frozenset()
    gone = lambda s: sum(n for ids, n in asks if ids <= s)
    while len(off) < most and gone(off) < share * total:
        rest = sorted({i for ids, _ in asks for i in ids} - off)
        if not rest:
            break
        off |= {max(rest, key=lambda i: (gone(off | {i}), sum(n for ids, n in asks if i in ids)))}
    return {"rules": sorted(off), "removed": gone(off), "asks": total} if gone(off) >= share * total else None


def tuning_hint_of(decided: DataFrame, most: int = 3, share: float = 0.6, least: int = 5) -> dict | None:
    """tuning_hint of a table of any size (action, rule_ids, calls): in each of at most `most` rounds one rule comes to the driver."""
    asks = decided.where("action = 'require_approval'").select(F.split("rule_ids", ",").alias("ids"), "calls")
    total = asks.agg(F.sum("calls")).first()[0] or 0
    off: list[str] = []
    removed = 0
    while total >= least and len(off) < most and removed < share * total:
        left = F.array_except("ids", F.array(*[F.lit(x) for x in off]).cast("array<string>"))
        each = asks.select("calls", left.alias("left")).select("calls", F.explode("left").alias("id"), (F.size("left") == 1).alias("last"))
        best = each.groupBy("id").agg(F.sum(F.when(F.col("last"), F.col("calls")).otherwise(0)).alias("gone"), F.sum("calls").alias("n")).orderBy(F.desc("gone"), F.desc("n"), "id").first()
        if best is None:
            break
        off, removed = [*off, best["id"]], removed + best["gone"]
    return {"rules": sorted(off), "removed": removed, "asks": total} if total >= least and removed >= share * total else None


def top_with_rest(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order, each with `more`: how many rows are left out.

    The cut is a limit, which every partition applies before anything is moved.
    """
    rest = F.greatest(F.lit(0), df.select(F.count("*")).scalar() - k)
    return df.orderBy(*order).limit(k).withColumn("more", rest)


def text_search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows whose text holds a trimmed needle, whatever the case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.strip().lower())))


def findings_order(findings: DataFrame) -> DataFrame:
    """Findings as a report lists them: most matches first, ties by rule id in alphabetical order."""
    return findings.orderBy(F.desc("matches"), *alphabetical("rule_id"))


def by_severity(findings: DataFrame, dimension: DataFrame) -> DataFrame:
    """Findings with their rule's severity, gravest first, then most matches, then by rule id; rank is the place."""
    rows = findings.join(F.broadcast(dimension.select("rule_id", "severity")), "rule_id", "left").withColumn("severity_rank", rank_of(F.col("severity"), SEVERITIES))
    return rows.orderBy("severity_rank", F.desc("matches"), *alphabetical("rule_id"))


def first_disclosures(calls: DataFrame, text: Column, order: list[str], most: int = 50) -> DataFrame:
    """The first `most` distinct texts of matched calls to servers' tools, in the order in which they came."""
    own = calls.where((F.size("matches") > 0) & F.col("tool").startswith("mcp__")).withColumn("disclosure", F.concat("tool", F.lit("  "), text))
    first = own.where("disclosure is not null").groupBy("disclosure").agg(F.min(F.struct(*order)).alias("first"))
    return first.orderBy("first").limit(most).select("disclosure", "first.*")


def enforcement(catalog: DataFrame) -> DataFrame:
    """What is enforced of a catalog with an enabled column: rules, the library's packs and those that are on, the user's own rules."""
    on, library = F.col("enabled"), F.col("source") == "library"
    pack = catalog.where(library).groupBy("category").agg(F.bool_or("pack_on").alias("on")).agg(F.count("*").alias("packs"), F.count_if("on").alias("packs_on"))
    rules = catalog.agg(F.count_if(on).alias("rules"), F.count_if(on & ~library).alias("yours"))
    return rules.withColumns({n: pack.select(n).scalar() for n in ("packs", "packs_on")})


def project_count(sessions: DataFrame, agent: str) -> DataFrame:
    """How many projects sessions belong to: by folder, of sessions that were read, or by working folder, as the app's files tell."""
    column = {"claude": "project", "cursor": "project", "codex": "cwd"}[agent]
    return sessions.where(F.col(column).isNotNull()).agg(F.countDistinct(column).alias("projects"))


def report_search(rows: DataFrame, needle: str, columns: tuple[str, ...], action: str | None = None, owasp: str | None = None, sort: str = "matches") -> DataFrame:
    """Rows of a report that hold a text, of one action and one risk id, if given; sorted by matches, severity or rule id."""
    out = text_search(rows, needle, *columns)
    if action is not None:
        out = out.where(F.col("action") == action)
    if owasp is not None:
        out = out.where(F.array_contains("owasp", owasp))
    name = alphabetical("rule_id")
    keys = {"matches": [F.desc("matches"), *name], "severity": [rank_of(F.col("severity"), SEVERITIES), F.desc("matches"), *name], "rule": name}
    return out.orderBy(*keys[sort])
