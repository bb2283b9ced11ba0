"""Verification: what calls of one kind did, as counts and a status that is never better than the evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shell
from ..sources import shared


def tally(calls: DataFrame, *keys: str) -> DataFrame:
    """ran, mentioned and unknown calls; what may only have run by way of a written file is unknown."""
    ran = (F.col("state") == "ran") & (F.col("why") != "may-run-written-file")
    mentioned = F.col("state") == "mentioned"
    return calls.groupBy(*keys).agg(F.count_if(ran).alias("ran"), F.count_if(mentioned).alias("mentioned"), F.count_if(~ran & ~mentioned).alias("unknown"))


def may_have_run(state: Column, why: Column) -> Column:
    """Whether a call counts when hidden commands are looked for."""
    return (state != "mentioned") & (why != "error-result")


def status(act: Column, review: Column, incomplete: Column) -> Column:
    """act, review, could-not-check or clean, in this order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(act), "act").when(yes(review), "review").when(yes(incomplete), "could-not-check").otherwise("clean")


def honest(found: Column, hiding_calls: Column, results_recorded: Column) -> Column:
    """clean only where nothing could have hidden and results were recorded."""
    sure = (hiding_calls == 0) & results_recorded
    return F.when((found == "clean") & ~F.coalesce(sure, F.lit(False)), "could-not-check").otherwise(found)


def judged(calls: DataFrame, pattern: str) -> DataFrame:
    """Calls (tool, full_command, records_results, has_result, is_error, content) that match, with state and why and hiding."""
    own = calls.where(F.col("full_command").rlike("(?i)" + pattern))
    v = shell.verdict(F.col("tool"), F.col("full_command"), pattern, F.col("records_results"), F.col("has_result"), F.col("is_error"), F.col("content"))
    return own.withColumns({"v": v, "hiding": shell.hiding("full_command")}).select("*", "v.state", "v.why").drop("v")


def _each(calls: DataFrame, name: str) -> DataFrame:
    """The labels x of one kind; explode_outer, since of explode Spark infers a filter, for which every command would be read again."""
    return calls.select(F.explode_outer(shell.labels("full_command", name)).alias("x")).where("x is not null")


def dependencies(calls: DataFrame) -> DataFrame:
    """Installs and lock-file restores by package manager."""
    each = _each(calls, "installs").select(F.split("x", ":").alias("p"))
    return each.groupBy(F.col("p")[1].alias("manager")).agg(F.count_if(F.col("p")[0] == "install").alias("installs"), F.count_if(F.col("p")[0] == "restore").alias("restores"))


def traffic(calls: DataFrame) -> DataFrame:
    """Uploads and tunnels of what is executed, by kind, and whether they leave the machine."""
    each = _each(calls, "traffic").select(F.split(F.regexp_replace("x", "^upload:", ""), ":").alias("p"))
    return each.groupBy(F.col("p")[0].alias("kind")).agg(F.count_if(F.col("p")[1] == "local").alias("local"), F.count_if(F.col("p")[1] == "leaving").alias("leaving"))


def check(calls: DataFrame, pattern: str, review: bool = True) -> DataFrame:
    """One row: the tally of a category, calls that may hide, and its status."""
    own = judged(calls, pattern)
    hides = F.count_if(may_have_run(F.col("state"), F.col("why")) & (F.size("hiding") > 0))
    facts = own.agg(
        F.count_if(F.col("state") == "ran").alias("ran"), F.count_if(F.col("state") == "mentioned").alias("mentioned"), F.count_if(F.col("state") == "unknown").alias("unknown"),
        hides.alias("hiding_calls"), F.coalesce(F.bool_and("records_results"), F.lit(True)).alias("results_recorded"),
    )
    found = status(F.lit(False), F.lit(review) & (F.col("ran") > 0), F.col("unknown") > 0)
    return facts.withColumn("status", honest(found, F.col("hiding_calls"), F.col("results_recorded")))


STEPS = 200_000  # steps that a task's share of sessions has, about
STEP = "struct<lost:boolean,lead:string,up:int,path:array<string>>"


def _step(lost: bool | Column = False, lead: Column | None = None, up: Column | None = None, path: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    lost = lost if isinstance(lost, Column) else F.lit(lost)
    return F.struct(lost.alias("lost"), (F.lit(None).cast("string") if lead is None else lead).alias("lead"), (F.lit(0) if up is None else up).alias("up"), (none if path is None else path).alias("path")).cast(STEP)


def whole_folder(path: Column) -> Column:
    """The step to a folder whatever was before; lost for null."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(path.isNull(), _step(True)).otherwise(_step(lead=F.when(path.startswith("/"), "/").otherwise(""), path=parts))


def then(a: Column, b: Column) -> Column:
    """The step that two steps make, the first one first: associative, so a prefix scan may pair them in any way."""
    keep = F.size(a["path"]) - b["up"]
    path = F.when(keep >= 0, F.concat(F.slice(a["path"], 1, F.greatest(keep, F.lit(0))), b["path"])).otherwise(b["path"])
    up = F.when(a["lead"].isNotNull(), F.lit(0)).otherwise(a["up"] + F.greatest(-keep, F.lit(0)))  # nothing lies above the root
    return F.when(b["lost"] | b["lead"].isNotNull(), b).when(a["lost"], a).otherwise(_step(lead=a["lead"], up=up, path=path))


def prefix_scan(rows: DataFrame, name: str, keys: list[str], order: list[str], rounds: int) -> DataFrame:
    """rows whose column `name` is the composition of all steps up to each row: in round i of steps 2**i rows apart.

    rounds is the logarithm of the longest group, rounded up. All windows have one order, so rows are sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    for i in range(rounds):
        before = F.lag(name, 1 << i).over(w)
        rows = rows.withColumn("__before", before).withColumn(name, F.when(F.col("__before").isNull(), F.col(name)).otherwise(then(F.col("__before"), F.col(name)))).drop("__before")
    return rows


def folders(calls: DataFrame, session: str = "session_key", order: str = "call_order") -> DataFrame:
    """calls with the folder that each began in: changes of one session's calls carry over, until one is unclear.

    A session begins in its first call's cwd. A call's change is a step: to a folder, to one relative to what was before, or to
    nowhere known. The steps of the calls that have one are composed by a prefix scan, and each call takes the last before it.
    `order` tells a session's calls apart.
    """
    reset = F.regexp_extract(F.coalesce("content", F.lit("")), r"Shell cwd was reset to (\S+)", 1)
    moves = F.coalesce(F.col("full_command").rlike(r"\b(?:cd|pushd)\b"), F.lit(False))
    done = F.col("has_result") & ~F.col("is_error")
    text = F.when(moves & done & (reset == ""), F.col("full_command"))
    step = F.when(reset != "", whole_folder(reset)).when(moves, F.when(F.coalesce(done, F.lit(False)), shell.folder_step(text)).otherwise(_step(True)))
    first = calls.groupBy(session).agg(F.min_by("cwd", order).alias("cwd"))
    changes = calls.select(session, F.col(order).alias("__at"), step.alias("__step")).where("__step is not null")
    every = first.select(session, F.lit(None).cast(calls.schema[order].dataType).alias("__at"), whole_folder(F.col("cwd")).alias("__step")).union(changes)
    path = shared.new_path(calls.sparkSession, "folder-steps")
    every.write.parquet(path)
    steps = calls.sparkSession.read.schema(every.schema).parquet(path)
    longest, total = steps.groupBy(session).count().agg(F.max("count"), F.sum("count")).first()
    longest = longest or 1
    steps = steps.repartition(max(calls.sparkSession.sparkContext.defaultParallelism, (total or 0) // STEPS), session)  # the scan's windows, one above the other, hold a task's share
    scanned = prefix_scan(steps, "__step", [session], ["__at"], math.ceil(math.log2(longest)) if longest > 1 else 0)  # the session's beginning sorts first
    begin, later = scanned.where("__at is null").select(session, F.col("__step").alias("__begin")), scanned.where("__at is not null")
    own = calls.join(begin, session, "left").join(later.select(session, F.col("__at").alias(order), "__step"), [session, order], "left")
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last("__step", ignorenulls=True).over(w), F.col("__begin"))
    own = own.withColumn("__step", last)
    where = F.when(~F.col("__step.lost"), F.concat(F.col("__step.lead"), F.array_join("__step.path", "/")))
    return own.select(*calls.columns, where.alias("folder"))
