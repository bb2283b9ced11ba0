"""The verification checks: what calls did, as counts by fixed names and one status for each category.

Every check reads the same table of calls (see read_calls) and gives rows (category, status, fact, n). Facts about
repositories come in as tables that may be absent: what can't be looked up counts as could-not-check, never as clean.
All are column expressions, windows within a session and hash aggregations; a check's result is a few rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import readers, shell
from ..functions.labels import TUNNELS
from ..plans.rules import Rule, Spans
from ..sources import shared
from .evaluate import matches_column
from .verify import honest, may_have_run, status

# The categories in the order in which they may lead, with the status and the fact that they lead by.
HEADLINES = (
    ("secrets", "act", "likely-real"), ("skipped-checks", "act", "no-verify.on-main"), ("lost-work", "act", "recoverable"),
    ("cloud", "review", "iam"), ("tests", "act", "thresholds-lowered"), ("destructive", "act", "rm.unguarded-variable"),
)
ORDER = ("secrets", "skipped-checks", "lost-work", "cloud", "prod-infra", "tests", "destructive", "unreviewed", "egress")
INFRA_RULES = {
    "pi.terraform-auto-approve": "terraform", "pi.terraform-state-mutate": "terraform", "pi.kubectl-delete": "kubernetes", "pi.prod-namespace": "kubernetes",
    "pi.helm-release": "helm", "pi.cloud-resource-delete": "cloud-delete", "pi.deploy-to-prod": "deploy", "block-prod-config-edit": "prod-config",
}
KEY = ("session_key", "call_order")


def read_calls(calls: DataFrame) -> DataFrame:
    """calls (session_key, call_order, tool, full_command, cwd, records_results, has_result, is_error, content) with the reading that all checks share.

    reading: see shell.read_once, in which every command is read once; executed: the text without data; hiding: forms in
    which more may run; state: ran or unknown, as far as the result tells.
    """
    coded = F.coalesce(F.col("content").rlike(r"^\s*Exit code -?\d+"), F.lit(False))
    why = (
        F.when(~F.col("records_results"), "not-recorded").when(~F.col("has_result"), "no-result")
        .when(F.col("is_error") & ~coded, "error-result").when(F.col("is_error"), "exit-code").otherwise("result")
    )
    out = calls.withColumns({"reading": shell.reading(F.when(F.col("tool") == "Bash", F.col("full_command"))), "why": why})
    unread = F.when(F.col("tool") == "PowerShell", F.array(F.lit("unread-shell"))).otherwise(F.col("reading.hiding"))
    return out.withColumns({"executed": F.col("reading.text"), "hiding": unread, "state": F.when(F.col("why").isin("result", "exit-code"), "ran").otherwise("unknown")})


def once(calls: DataFrame) -> DataFrame:
    """calls as a table of the shared folder, for what asks more than once: commands are read when it is written."""
    path = shared.new_path(calls.sparkSession, "calls")
    calls.write.parquet(path)
    return calls.sparkSession.read.schema(calls.schema).parquet(path)


def _count(labels: Column, label: str) -> Column:
    """How many labels are this one, or begin with it if it ends in a colon."""
    return F.size(F.filter(labels, lambda x: x.startswith(label) if label.endswith(":") else x == label))


def _sum(c: Column, when: Column | None = None) -> Column:
    c = c.cast("long")
    return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0)).cast("long")


def _calls(label: str, name: str) -> dict[str, Column]:
    """Calls with a label that ran, that only mention it, and that are unknown."""
    own, raw, ran = _count(F.col("labels"), label) > 0, _count(F.col("raw_labels"), label) > 0, F.col("state") == "ran"
    return {f"{name}.ran": _sum(own & ran), f"{name}.mentioned": _sum(~own & raw), f"{name}.unknown": _sum(own & ~ran)}


def _hides() -> dict[str, Column]:
    return {"could-hide": _sum((F.size("hiding") > 0) & may_have_run(F.col("state"), F.col("why")))}


def _labelled(calls: DataFrame, name: str) -> DataFrame:
    """labels of what is executed; raw_labels of the whole text, which only mentions what the former lacks."""
    return calls.withColumns({"labels": F.col(f"reading.labels.{name}"), "raw_labels": F.col(f"reading.raw.{name}")})


def _agg(calls: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """One row of facts; recorded is 1 where all calls' results are recorded."""
    recorded = F.coalesce(F.bool_and("records_results"), F.lit(True)).alias("recorded")
    return calls.agg(*[c.alias(n) for n, c in facts.items()], recorded)


def _absent(*names: str) -> dict[str, Column]:
    return {n: F.max(F.lit(0)) for n in names}


def card(category: str, parts: list[DataFrame], state: Column) -> DataFrame:
    """Rows (category, status, fact, n) of a check's facts, which come as one row of each part."""
    entry = lambda c: F.struct(F.lit(c).alias("fact"), F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias("n"))
    long = functools.reduce(DataFrame.union, [d.select(F.explode(F.array(*map(entry, d.columns))).alias("f")).select("f.*") for d in parts])
    one = long.agg(F.map_from_entries(F.collect_list(F.struct("fact", "n"))).alias("facts"))  # some twenty entries
    return one.select(F.lit(category).alias("category"), state.alias("status"), F.explode("facts").alias("fact", "n")).where("fact <> 'recorded'")


def _fact(*names: str) -> Column:
    return functools.reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at("facts", F.lit(n)), F.lit(0)) for n in names])


def _status(act: Column, review: Column, incomplete: Column) -> Column:
    return honest(status(act, review, incomplete), _fact("could-hide"), _fact("recorded") == 1)



def _with(calls: DataFrame, table: DataFrame | None, **columns: str) -> tuple[DataFrame, Column]:
    """calls with the columns of a table by call; without the table they are null. The second value: whether a call was looked up."""
    if table is None:
        return calls.withColumns({n: F.lit(None).cast(k) for n, k in columns.items()}), F.lit(False)
    found = table.groupBy(*KEY).agg(*[F.bool_or(n).alias(n) if k == "boolean" else F.sum(n).alias(n) for n, k in columns.items()]).withColumn("__looked_up", F.lit(True))
    return calls.join(found, list(KEY), "left"), F.coalesce(F.col("__looked_up"), F.lit(False))


# -- the checks -------------------------------------------------------------------------------------------------------


def skipped_checks(calls: DataFrame, commits: DataFrame | None = None, hook_paths: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Commits without hooks and other switches. commits: (session_key, call_order, on_main) of such commits; hook_paths: (folder, off); files: (path, content)."""
    own, known = _with(_labelled(calls, "skips"), commits, on_main="boolean")
    bare = (_count(F.col("labels"), "no-verify") > 0) & (F.col("state") == "ran")
    facts = {
        **_calls("no-verify", "no-verify"), "no-verify.on-main": _sum(bare & F.coalesce(F.col("on_main"), F.lit(False))), "no-verify.off-main": _sum(bare & ~F.coalesce(F.col("on_main"), F.lit(True))),
        "no-verify.could-not-check": _sum(bare & ~known), **_calls("other-no-verify", "other-no-verify"), **_calls("husky", "husky"), **_calls("one-command", "one-command"), **_calls("hooks-path", "hooks-path"), **_hides(),
    }
    parts = [_agg(own, facts | (_absent("hooks-path.off") if hook_paths is None else {}) | (_absent("instructions.read", "instructions.say-to-skip") if files is None else {}))]
    if hook_paths is not None:
        parts.append(hook_paths.agg(_sum(F.col("off")).alias("hooks-path.off")))
    if files is not None:
        parts.append(files.where(readers.is_instruction_file(F.col("path"))).agg(F.count("*").alias("instructions.read"), _sum(readers.tells_to_skip(F.col("content"))).alias("instructions.say-to-skip")))
    unknown = _fact("no-verify.could-not-check", *[f"{n}.unknown" for n in ("no-verify", "other-no-verify", "husky", "one-command", "hooks-path")])
    unasked = F.lit(files is None) | (F.lit(hook_paths is None) & (_fact("hooks-path.ran") > 0))
    act = (_fact("no-verify.on-main", "hooks-path.off", "instructions.say-to-skip") > 0)
    return card("skipped-checks", parts, _status(act, _fact("no-verify.off-main", "other-no-verify.ran", "husky.ran", "one-command.ran") > 0, (unknown > 0) | unasked))


def lost_work(calls: DataFrame, losses: DataFrame | None = None) -> DataFrame:
    """Branches, stashes and changes thrown away. losses: (session_key, call_order, recoverable, main_checkout) of these calls."""
    own, known = _with(_labelled(calls, "lost"), losses, recoverable="boolean", main_checkout="boolean")
    kinds = ("branch-delete", "stash-drop", "stash-clear", "discard-all", "discard-paths")
    any_ = functools.reduce(lambda a, b: a | b, [_count(F.col("labels"), k) > 0 for k in kinds]) & (F.col("state") == "ran")
    facts = {n: c for k in kinds for n, c in _calls(k, k).items()} | {
        "recoverable": _sum(any_ & F.coalesce(F.col("recoverable"), F.lit(False))), "main-checkout": _sum(any_ & F.coalesce(F.col("main_checkout"), F.lit(False))),
        "could-not-check": _sum(any_ & ~known), "copies": _sum(_count(F.col("labels"), "copy"), F.col("state") == "ran"), **_hides(),
    }
    incomplete = _fact("could-not-check", *[f"{k}.unknown" for k in kinds]) > 0
    return card("lost-work", [_agg(own, facts)], _status(_fact("recoverable") > 0, _fact("main-checkout") > 0, incomplete))


def cloud(calls: DataFrame) -> DataFrame:
    """Changes to a cloud account: never act, since what they did can't be seen here."""
    own = _labelled(calls, "cloud")
    ran = F.col("state") == "ran"
    subjects = ("access-keys", "credentials", "policies", "roles", "groups", "users", "other")
    each = {f"iam.{s}": _sum(_count(F.col("labels"), f"iam:{s}"), ran) for s in subjects} | {k: _sum(_count(F.col("labels"), k), ran) for k in ("auto-scaling", "s3", "local-stack")}
    terraform = _sum(_count(F.col("labels"), "terraform") + _count(F.col("labels"), "terraform:"), ran)
    some = lambda labels: F.size(F.filter(labels, lambda x: x != "local-stack")) > 0
    facts = {"iam": _sum(_count(F.col("labels"), "iam:"), ran), **each, "terraform": terraform, "terraform.unasked": _sum(_count(F.col("labels"), "terraform:unasked"), ran), "mentioned": _sum(~some(F.col("labels")) & some(F.col("raw_labels"))), "unconfirmed": _sum(some(F.col("labels")) & ~ran), **_hides()}
    return card("cloud", [_agg(own, facts)], _status(F.lit(False), _fact("iam", "auto-scaling", "s3", "terraform", "unconfirmed") > 0, F.lit(False)))


def prod_infra(calls: DataFrame, catalog: list[Rule]) -> DataFrame:
    """Rules on production infrastructure that ran, and databases that were aimed at; calls may have a file_path."""
    rules = [r for r in catalog if r.id in INFRA_RULES]
    path = "file_path" if "file_path" in calls.columns else None
    spans = Spans(kind="'execute_tool'", label="tool", detail="executed", mcp_input=None, file_path=path, agent=None, project=None, tokens=None, cached_tokens=None, duration_ms=None)
    kind_of = F.create_map(*[F.lit(x) for kv in INFRA_RULES.items() for x in kv])
    own = _labelled(calls, "databases").withColumn("kinds", F.array_distinct(F.transform(matches_column(rules, spans), lambda m: kind_of[m["rule_id"]])))
    own = own.withColumn("local", F.col("reading.here"))
    ran, hit = F.col("state") == "ran", F.size("kinds") > 0
    facts = {
        "infra": _sum(hit & ran & ~F.col("local")), "infra.local": _sum(hit & ran & F.col("local")), "infra.unconfirmed": _sum(hit & ~ran),
        **{f"infra.{k}": _sum(F.array_contains("kinds", k) & ran & ~F.col("local")) for k in dict.fromkeys(INFRA_RULES.values())},
        **{f"database.{k}": _sum(_count(F.col("labels"), f"db:{k}"), ran) for k in ("local", "scratch", "other", "unresolved")}, **_hides(),
    }
    return card("prod-infra", [_agg(own, facts)], _status(F.lit(False), _fact("infra", "database.other") > 0, _fact("infra.unconfirmed", "database.unresolved") > 0))


def destructive(calls: DataFrame, home: str, tracked: DataFrame | None = None) -> DataFrame:
    """Recursive removals by class, and databases dropped. tracked: (path, missing) of the paths that a repository holds files under.

    A path that no row of tracked is at or below is scratch by its name, or other; without the table it could not be checked.
    """
    ran = F.col("state") == "ran"
    target = lambda t: readers.removal(t, F.col("cwd"), F.lit(home))
    own = _labelled(calls, "databases").withColumns({"targets": F.transform("reading.labels.removed", target), "raw_targets": F.size("reading.raw.removed")})
    own = once(own.select("state", "why", "hiding", "records_results", "labels", "raw_labels", "targets", "raw_targets"))
    each = own.where(ran).select(F.explode("targets").alias("t")).select("t.label", "t.path")
    looked = each.where(F.col("label").isin("rm:path", "rm:scratch-name")).groupBy("label", "path").agg(F.count("*").alias("n"))
    if tracked is not None:
        # a target holds the files at it or below it: their folders are listed once for each file, and joined by equality
        parts = F.split("path", "/")
        above = tracked.select("missing", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).where("path <> ''").groupBy("path").agg(F.bool_or("missing").alias("missing"))
        looked = looked.join(above, "path", "left").withColumn("kind", F.when(F.col("missing"), "tracked-missing").when(~F.col("missing"), "tracked").when(F.col("label") == "rm:scratch-name", "scratch").otherwise("other"))
    else:
        looked = looked.withColumn("kind", F.lit("could-not-check"))
    kinds = ("guarded-variable", "unguarded-variable", "could-not-check", "home-or-above", "scratch", "other", "tracked", "tracked-missing")
    plain = each.where(~F.col("label").isin("rm:path", "rm:scratch-name")).groupBy(F.substring("label", 4, 100).alias("kind")).agg(F.count("*").alias("n"))
    classes = looked.groupBy("kind").agg(F.sum("n").alias("n")).union(plain).agg(*[_sum(F.col("n"), F.col("kind") == k).alias(f"rm.{k}") for k in kinds])
    some, raw = F.size("targets") > 0, F.col("raw_targets") > 0
    facts = {
        "rm.ran": _sum(some & ran), "rm.mentioned": _sum(~some & raw), "rm.unknown": _sum(some & ~ran), **_calls("db:", "database"),
        **{f"database.{k}": _sum(_count(F.col("labels"), f"db:{k}"), ran) for k in ("local", "scratch", "other", "unresolved")}, **_hides(),
    }
    act = _fact("rm.home-or-above", "rm.unguarded-variable", "rm.tracked-missing") > 0
    review = _fact("rm.tracked", "rm.other", "database.local", "database.other") > 0
    return card("destructive", [_agg(own, facts), classes], _status(act, review, _fact("rm.could-not-check", "rm.unknown", "database.unknown", "database.unresolved") > 0))


def unreviewed(calls: DataFrame, on_main: DataFrame | None = None) -> DataFrame:
    """Pushes to main by what their output says. on_main: (hash, contained) of commits, whether main has them now."""
    own = _labelled(calls, "pushes").select("content", "state", "why", "hiding", "records_results", "labels", "raw_labels")
    own = once(own).withColumn("refs", F.filter(readers.pushed_refs(F.coalesce("content", F.lit(""))), lambda r: F.regexp_replace(r["branch"], "^refs/heads/", "").isin("main", "master")))
    live = F.size(F.filter("labels", lambda x: x != "push:dry-run")) > 0
    raw = F.size(F.filter("raw_labels", lambda x: x != "push:dry-run")) > 0
    ran = F.col("state") == "ran"
    says = readers.push_reported(F.col("content"))
    facts = {
        "pushes-to-main": _sum(F.size("refs"), live & ran), "pushes-creating-main": _sum(F.size(F.filter("refs", lambda r: r["to_hash"].isNull())), live & ran),
        "pushes-not-checked": _sum(live & ran & ~says), "mentioned": _sum(~live & raw), "unconfirmed": _sum(live & ~ran), **_hides(),
    }
    hashes = own.where(live & ran).select(F.explode_outer("refs.to_hash").alias("hash")).where("hash is not null")
    if on_main is not None:
        told = hashes.join(on_main.groupBy("hash").agg(F.bool_or("contained").alias("contained")), "hash", "left").agg(_sum(F.col("contained")).alias("commits-on-main"), _sum(~F.col("contained")).alias("commits-not-on-main"), _sum(F.col("contained").isNull()).alias("commits-not-checked"))
    else:
        told = hashes.agg(F.max(F.lit(0)).alias("commits-on-main"), F.max(F.lit(0)).alias("commits-not-on-main"), F.count("*").alias("commits-not-checked"))
    return card("unreviewed", [_agg(own, facts), told], _status(_fact("commits-on-main") > 0, _fact("commits-not-on-main") > 0, _fact("pushes-not-checked", "unconfirmed", "commits-not-checked", "pushes-creating-main") > 0))


def egress(calls: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Uploads and tunnels. running: (name) of the tunnel programs that run now."""
    own = _labelled(calls, "traffic")
    ran = F.col("state") == "ran"
    left = lambda labels: F.size(F.filter(labels, lambda x: x.endswith(":leaving")))
    kinds = ("http-upload", "file-copy", "cloud-storage", "raw-socket", "paste")
    facts = {
        "uploads": _sum(F.size(F.filter("labels", lambda x: x.startswith("upload:") & x.endswith(":leaving"))), ran), "tunnels": _sum(_count(F.col("labels"), "tunnel:leaving"), ran), "local-only": _sum(F.size(F.filter("labels", lambda x: x.endswith(":local"))), ran),
        **{f"upload.{k}": _sum(_count(F.col("labels"), f"upload:{k}:leaving"), ran) for k in kinds}, "mentioned": _sum((left(F.col("labels")) == 0) & (left(F.col("raw_labels")) > 0)), "unconfirmed": _sum((left(F.col("labels")) > 0) & ~ran), **_hides(),
    }
    parts = [_agg(own, facts | (_absent("tunnels-running") if running is None else {}))]
    if running is not None:
        parts.append(running.where(F.col("name").isin(*TUNNELS)).agg(F.count("*").alias("tunnels-running")))
    unasked = F.lit(running is None) & (_fact("tunnels") > 0)
    return card("egress", parts, _status(_fact("tunnels-running") > 0, _fact("uploads", "tunnels") > 0, (_fact("unconfirmed") > 0) | unasked))


def dependencies(calls: DataFrame) -> DataFrame:
    """installs and restores by manager, of calls that ran."""
    each = calls.where("state = 'ran'").select(F.explode_outer("reading.labels.installs").alias("x")).where("x is not null").select(F.split("x", ":").alias("p"))
    return each.groupBy(F.col("p")[1].alias("manager")).agg(F.count_if(F.col("p")[0] == "install").alias("installs"), F.count_if(F.col("p")[0] == "restore").alias("restores"))


def tests(calls: DataFrame, edits: DataFrame | None = None, disk: DataFrame | None = None) -> DataFrame:
    """Ways to make tests pass. edits: (session_key, call_order, path, removed, added, whole, deleted), see mapping.edits; disk: (path, content) of configs now.

    A whole write is compared with what the session wrote to the file before. A lowered threshold that was seen in the
    session before its last coverage run undoes an automatic raise, if autoUpdate is on in the edit or on disk.
    What was before is never gathered in a row: failing lines and thresholds are tables of their first calls, found by equality,
    so a session costs as much as it has calls.
    """
    ran = F.col("state") == "ran"
    of_tests = lambda paths: F.filter(paths, readers.is_test_path)
    label = lambda n: F.col(f"reading.labels.{n}")
    config_written = F.exists(label("written"), lambda w: readers.is_test_config(w) | readers.is_ci_file(w))
    failing = F.filter(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), readers.reports_failure)
    own = calls.select(
        *KEY, "state", "why", "hiding", "records_results", of_tests(label("deleted")).alias("deletes"), F.size(of_tests(F.col("reading.raw.deleted"))).alias("raw_deletes"), label("passes").alias("passes"),
        (config_written | label("patched")).alias("unread"), F.when(label("tests") & ran, failing).alias("failing"), (label("coverage") & ran).alias("covers"),
    )
    own = once(own)
    failed = own.select(*KEY, F.explode("failing").alias("line")).select(*KEY, "line", F.explode(readers.pieces(F.col("line"))).alias("piece"))
    failed = failed.groupBy("session_key", "piece", "line").agg(F.min("call_order").alias("failed_at"))

    def after_failing(rows: DataFrame) -> DataFrame:
        """Those of rows (session_key, call_order, path) whose file a run before had reported as failing."""
        rows = rows.withColumn("base", readers.base_name(F.col("path"))).withColumn("piece", readers.longest_piece(F.col("base"))).alias("r")
        before = (F.col("r.session_key") == F.col("f.session_key")) & (F.col("r.piece") == F.col("f.piece")) & (F.col("f.failed_at") < F.col("r.call_order")) & readers.names(F.col("f.line"), F.col("r.base"))
        return rows.join(failed.alias("f"), before, "left_semi")

    some = (F.size("deletes") > 0) | F.col("passes") | F.col("unread")
    facts = {
        "pass-with-no-tests": _sum(F.col("passes") & ran), "test-files-deleted": _sum(F.size("deletes"), ran), "deleted-failure-unknown": _sum(F.size("deletes"), ran & ~F.col("records_results")),
        "unread-edits": _sum(F.col("unread") & ran), "mentioned": _sum(~some & (F.col("raw_deletes") > 0)), "unconfirmed": _sum(some & ~ran), **_hides(),
    }
    gone_files = own.where(ran & F.col("records_results")).select(*KEY, F.explode("deletes").alias("path"))
    of_edits = ("thresholds-lowered", "auto-update-reverts", "configs-rewritten", "excludes-added", "edits.pass-with-no-tests", "ci-steps-forced-true", "edits.test-files-deleted", "edits.deleted-after-failing")
    parts = [_agg(own, facts | (_absent(*of_edits) if edits is None else {})), after_failing(gone_files).agg(F.count("*").alias("deleted-after-failing"))]
    if edits is not None:
        order = Window.partitionBy("session_key").orderBy("call_order").rowsBetween(Window.unboundedPreceding, -1)
        known = own.select(*KEY, "state", "records_results", F.max(F.when(F.col("covers"), F.col("call_order"))).over(order).alias("coverage"))
        e = edits.join(known, list(KEY)).where(ran)
        file = Window.partitionBy("session_key", "path").orderBy("call_order")
        last = F.lag(F.when(F.col("whole"), F.col("added"))).over(file)  # an edit in between makes the content unknown
        e = e.withColumn("last", last).withColumns({"removed": F.when(F.col("whole") & F.col("last").isNotNull(), F.col("last")).otherwise(F.col("removed")), "whole": F.col("whole") & F.col("last").isNull()})
        a, b, part = F.col("removed"), F.col("added"), ~F.col("whole") & ~F.col("deleted")
        config, ci = readers.is_test_config(F.col("path")), readers.is_ci_file(F.col("path"))
        e = e.withColumns({"lowers": F.coalesce(config & part & readers.lowers_threshold(F.col("path"), a, b), F.lit(False)), "auto": readers.updates_itself(F.concat_ws("\n", a, b)), "id": F.monotonically_increasing_id()})
        e = once(e)
        value = lambda text: F.array_distinct(F.transform(readers.limits(text), lambda x: x["value"]))
        seen = e.select("session_key", "path", "call_order", F.explode(value(F.concat_ws("\n", a, b))).alias("value")).groupBy("session_key", "path", "value").agg(F.min("call_order").alias("seen_at"))
        low = e.where(F.col("lowers") & F.col("coverage").isNotNull())
        if disk is not None:
            low = low.join(disk.groupBy("path").agg(F.bool_or(readers.updates_itself(F.col("content"))).alias("on_disk")), "path", "left")
        low = low.where(F.col("auto") | (F.coalesce(F.col("on_disk"), F.lit(False)) if disk is not None else F.lit(False)))
        each = low.select("id", "session_key", "path", "coverage", F.explode_outer(value(b)).alias("value")).join(seen, ["session_key", "path", "value"], "left")
        reverts = each.groupBy("id").agg(F.bool_and(F.col("value").isNull() | F.coalesce(F.col("seen_at") < F.col("coverage"), F.lit(False))).alias("back")).agg(_sum(F.col("back")).alias("auto-update-reverts"))
        gone = F.col("deleted") & readers.is_test_path(F.col("path"))
        told = {
            "lowered": _sum(F.col("lowers")), "configs-rewritten": _sum((config | ci) & F.col("whole")), "excludes-added": _sum(config & part & readers.adds_exclude(a, b)),
            "edits.pass-with-no-tests": _sum((config | ci) & ~F.col("whole") & (readers.passes_set(b) > readers.passes_set(a))), "ci-steps-forced-true": _sum(ci & ~F.col("whole") & (readers.steps_forced(b) > readers.steps_forced(a))),
            "edits.test-files-deleted": _sum(gone),
        }
        both = e.agg(*[c.alias(n) for n, c in told.items()]).crossJoin(reverts)  # one row each
        parts.append(both.withColumn("thresholds-lowered", F.col("lowered") - F.col("auto-update-reverts")).drop("lowered"))
        parts.append(after_failing(e.where(gone & F.col("records_results")).select(*KEY, "path")).agg(F.count("*").alias("edits.deleted-after-failing")))
    act = _fact("thresholds-lowered", "pass-with-no-tests", "edits.pass-with-no-tests", "ci-steps-forced-true", "deleted-after-failing", "edits.deleted-after-failing") > 0
    review = _fact("excludes-added", "test-files-deleted", "edits.test-files-deleted", "auto-update-reverts", "configs-rewritten") > 0
    return card("tests", parts, _status(act, review, (_fact("unconfirmed", "unread-edits") > 0) | F.lit(edits is None)))


CLASSES = ("likely-real", "committed-fixture", "placeholder", "local-dev")


def secret_items(values: DataFrame, committed: DataFrame | None = None, salt: str = "", set_aside: DataFrame | None = None) -> DataFrame:
    """A row for each distinct credential-like value, by its keyed fingerprint: class, kinds, vias and files. values: (value, kind, file, and via if it is known).

    via is how a value got into a transcript (see mapping.provenance). Classes: set-aside for those of the list set_aside
    (fingerprint), which a user has looked at, then placeholder, local-dev, committed-fixture (committed: fingerprints of values in
    tracked files) and, for none of these, likely-real. Values never leave the aggregation.
    """
    from ..functions.redact import fingerprint, is_local_value, is_placeholder

    v = F.col("value")
    via = F.col("via") if "via" in values.columns else F.lit("unknown")
    own = values.groupBy(fingerprint(v, salt).alias("fingerprint")).agg(
        F.bool_or(is_placeholder(v)).alias("fake"), F.bool_or(is_local_value(v)).alias("near"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set(F.coalesce(via, F.lit("unknown")))).alias("vias"), F.count_distinct("file").alias("files"),
    )
    for table, name in ((committed, "fixture"), (set_aside, "aside")):
        if table is not None:
            own = own.join(table.select("fingerprint").distinct().withColumn(name, F.lit(True)), "fingerprint", "left")
        else:
            own = own.withColumn(name, F.lit(None).cast("boolean"))
    kind = F.when(F.col("aside"), "set-aside").when(F.col("fake"), "placeholder").when(F.col("near"), "local-dev").when(F.col("fixture"), "committed-fixture").otherwise("likely-real")
    return own.select("fingerprint", kind.alias("class"), "kinds", "vias", "files")


def secret_groups(items: DataFrame) -> DataFrame:
    """Items by class, kind and via: how many there are, and how many files the one in most files is in. An item of several kinds or vias counts for each."""
    each = items.select("class", "files", F.explode("kinds").alias("kind"), "vias").select("class", "kind", F.explode("vias").alias("via"), "files")
    return each.groupBy("class", "kind", "via").agg(F.count("*").alias("items"), F.max("files").alias("most_files"))


def secrets(values: DataFrame, committed: DataFrame | None = None, salt: str = "", set_aside: DataFrame | None = None) -> DataFrame:
    """Distinct credential-like values by class (see secret_items); those set aside don't count for the status."""
    aside = {} if set_aside is None else {"set-aside": _sum(F.col("class") == "set-aside")}
    facts = {n: _sum(F.col("class") == n) for n in CLASSES} | {"most-files": F.coalesce(F.max(F.when(F.col("class") == "likely-real", F.col("files"))), F.lit(0))} | aside
    rows = secret_items(values, committed, salt, set_aside).agg(*[c.alias(n) for n, c in facts.items()])
    return card("secrets", [rows], F.when(_fact("likely-real") > 0, "act").when(_fact(*CLASSES) > 0, "review").otherwise("clean"))


# -- all of them -------------------------------------------------------------------------------------------------------


def verify(calls: DataFrame, catalog: list[Rule], home: str, edits: DataFrame | None = None, secret_values: DataFrame | None = None, **tables: DataFrame) -> DataFrame:
    """Every check's rows. tables: commits, hook_paths, files, losses, tracked, on_main, running, disk, committed; any may be left out."""
    t = tables.get
    calls = once(calls)  # read once for all checks
    cards = [
        skipped_checks(calls, t("commits"), t("hook_paths"), t("files")), lost_work(calls, t("losses")), cloud(calls), prod_infra(calls, catalog), tests(calls, edits, t("disk")),
        destructive(calls, home, t("tracked")), unreviewed(calls, t("on_main")), egress(calls, t("running")),
    ]
    if secret_values is not None:
        cards.append(secrets(secret_values, t("committed")))
    return value_free(functools.reduce(DataFrame.union, cards))


def value_free(rows: DataFrame) -> DataFrame:
    """Only rows of known categories and states whose fact is a name of fixed words: nothing of a transcript's text gets out."""
    fine = F.col("category").isin(*ORDER) & F.col("status").isin("act", "review", "could-not-check", "clean") & F.col("fact").rlike("^[a-z0-9]+(?:[.-][a-z0-9]+)*$")
    return rows.where(fine).select("category", "status", "fact", F.col("n").cast("long").alias("n"))


def headline(rows: DataFrame) -> DataFrame:
    """The claims that may lead, first to last: a category in its fixed place, with its one status and a count above zero."""
    fits = functools.reduce(lambda a, b: a | b, [(F.col("category") == c) & (F.col("status") == s) & (F.col("fact") == f) for c, s, f in HEADLINES])
    place = F.create_map(*[F.lit(x) for i, (c, _, _) in enumerate(HEADLINES) for x in (c, i)])
    return rows.where(fits & (F.col("n") > 0)).select(place[F.col("category")].alias("rank"), "category", "fact", "n").orderBy("rank")
