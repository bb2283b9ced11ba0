"""The decision log: one JSON record a line, appended by many writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.sequence import tail
from .jsonl import lines

SCHEMA = StructType([StructField(n, StringType()) for n in ("ts", "tool", "decision", "ruleId", "command", "agent", "event", "project")])


def read(spark: SparkSession, path: str, last: int | None = 500) -> DataFrame:
    """Valid decision records (line, ts, tool, decision, rule_id, command, agent) of the last non-blank lines of a log.

    The tail is taken first, so bad lines within it are not made up for by older ones.
    """
    return parse(lines(spark, path, "*"), last)


def parse(rows: DataFrame, last: int | None = 500) -> DataFrame:
    """As read, of a log's lines (line, text)."""
    rows = rows.where(F.trim("text") != "")
    rows = (tail(rows, last) if last else rows).select("line", F.from_json("text", SCHEMA).alias("r")).select("line", "r.*")
    valid = rows.where("ruleId is not null and agent is not null and decision in ('allow', 'ask', 'deny')")
    return valid.select("line", "ts", "tool", "decision", F.col("ruleId").alias("rule_id"), "command", "agent")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of records as they arrive."""
    return spark.readStream.schema(SCHEMA).json(folder)
