"""Operators that depend on order: keep-first, forward fill, running counts, as-of lookups, log rules.

All are window functions partitioned by session, user or file, so that no order is global; where one partition can hold
most rows (a log), the keys are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str], id_column: str | None = None) -> DataFrame:
    """The first row of each key; rows with an empty id are all kept.

    Done by an aggregation with partial sums rather than a window, so a frequent key is not gathered.
    """
    rest = [c for c in df.columns if c not in keys]
    first = lambda d: d.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*df.columns)
    if not id_column:
        return first(df)
    empty = F.coalesce(F.col(id_column), F.lit("")) == ""
    return first(df.where(~empty)).union(df.where(empty))


def forward_fill(df: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_count_before(df: DataFrame, flag: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """How many rows before this one have the flag: rows get the number of the unit that they belong to."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(flag.cast("long")).over(w), F.lit(0)))


def seen_before(df: DataFrame, flag: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Whether an earlier row has the flag."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(flag).over(w), F.lit(False)))


def call_order(df: DataFrame, keys: list[str], order: list[str], name: str = "call_order") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def as_of_previous(df: DataFrame, value: Column, when: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The value of the last earlier row for which `when` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def result_join(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with the result of their id, where there is one; a repeated result counts once (the first file's)."""
    return calls.join(results.dropDuplicates(keys), keys, "left")


def dedupe_window(log: DataFrame, key: list[str], order: list[str], ts: str, millis: int = 3000, call_id: str | None = None, within: list[str] = ("log",)) -> DataFrame:
    """Drop a record that repeats its log's last kept record within `millis` (inclusive) of that, or at any age with one call id.

    Records of another key in between end a run of repeats: A B A keeps all three. A run's kept records are found by one
    fold over its times. within: columns of independent logs, of which each is one task's (a log is one machine's file of
    a bounded size).
    """
    w = Window.partitionBy(*within).orderBy(*order)
    same = F.lit(True)
    for k in [*key, *([call_id] if call_id else [])]:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    begins = (F.row_number().over(w) == 1) | ~same
    runs = log.withColumns({"__at": F.unix_millis(F.col(ts).cast("timestamp")), "__n": F.row_number().over(w), "__begins": begins})
    runs = runs.withColumn("__run", F.sum(F.col("__begins").cast("long")).over(w))
    alone = runs.where("__begins" if not call_id else f"__begins or `{call_id}` is null")
    # the rest of each run: times from its first record on, folded to the numbers of those kept
    first = lambda acc, x: F.when(F.coalesce(x["t"] - acc["t"] > millis, F.lit(True)), F.struct(x["t"].alias("t"), F.concat(acc["kept"], F.array(x["n"])).alias("kept"))).otherwise(acc)
    times = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__at").alias("t"))))
    timed = runs if not call_id else runs.where(f"`{call_id}` is null")
    folded = timed.groupBy(*within, "__run").agg(times.alias("x")).where("size(x) > 1")
    start = F.struct(F.get("x", F.lit(0))["t"].alias("t"), F.array(F.get("x", F.lit(0))["n"]).alias("kept"))
    kept = folded.select(*within, F.explode(F.aggregate(F.slice("x", 2, F.size("x")), start, first)["kept"]).alias("__n"))
    # a run's first record is kept anyway; of records with ids only that
    more = runs.where("not __begins").join(kept, [*within, "__n"], "left_semi")
    own = alone.where("__begins")
    return own.select(*log.columns).union(more.select(*log.columns))


def compact_log(log: DataFrame, order: list[str], size: Column, ts: str, now: Column, most: int = 1 << 20, target: int = 512 << 10, days: int = 30, within: list[str] = ("log",)) -> DataFrame:
    """A log above `most` bytes keeps its newest records up to `target` bytes that are at most `days` old, in order.

    The newest records end at the first that doesn't fit any more. Records without a readable time go in a compaction.
    """
    by = list(within)
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("__size", size)
    rows = rows.withColumn("__all", F.sum("__size").over(Window.partitionBy(*by))).withColumn("__sum", F.sum("__size").over(newest))
    young = F.coalesce(F.try_to_timestamp(F.col(ts).cast("string")) >= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return rows.where((F.col("__all") <= most) | ((F.col("__sum") <= target) & young)).drop("__size", "__all", "__sum")


def tail(log: DataFrame, n: int, order: str = "line") -> DataFrame:
    """The last n rows of a log."""
    return log.orderBy(F.desc(order)).limit(n)
