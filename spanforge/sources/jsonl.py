"""JSON-lines files with line numbers, and what all transcript readers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BLOCKS = 200_000  # blocks whose first line numbers are broadcast; the numbers of more are joined by a shuffle


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", most: int = BLOCKS) -> DataFrame:
    """file, mtime, bytes, line (from 0) and text of every line below a folder; a carriage return at a line's end is dropped.

    Files are split into blocks of bytes (spark.sql.files.maxPartitionBytes) that tasks read alone, so a file of any size
    takes many; see number_lines.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    found = number_lines(files.select("value", "_metadata"), most)
    return found.select("file", "mtime", "bytes", "line", F.regexp_replace("value", r"\r$", "").alias("text"))


def number_lines(files: DataFrame, most: int = BLOCKS) -> DataFrame:
    """The columns of a table read by spark.read.text (with _metadata among them), with file, mtime, bytes and line (from 0).

    A first pass, which moves no text, counts each block's lines; a line's number is its place in its block after the lines of
    the file's blocks before. Both passes deal the blocks out alike; where that doesn't hold, since files have
    changed in between, the query fails.
    """
    meta = {"file": "file_path", "start": "file_block_start", "mtime": "file_modification_time", "bytes": "file_size"}
    rest = [c for c in files.columns if c != "_metadata"]
    rows = files.select(*rest, *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()))
    rows = rows.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    blocks = rows.groupBy("file", "start", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.select("file", "start", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    table = known.limit(most + 1).toArrow()
    known = F.broadcast(files.sparkSession.createDataFrame(table, known.schema)) if len(table) <= most else known
    number = F.coalesce(F.col("place") + F.col("shift"), F.raise_error(F.lit("a file changed while it was read")).cast("long"))
    return rows.join(known, ["file", "start", "task"], "left").select(*rest, "file", "mtime", "bytes", number.alias("line"))


def records(rows: DataFrame) -> DataFrame:
    """Non-blank lines with the parsed record (null where a line is no JSON object) and whether a bad one is the last."""
    own = rows.where(F.trim("text") != "").withColumn("record", F.try_parse_json("text"))
    own = own.withColumn("record", F.when(F.schema_of_variant("record").startswith("OBJECT"), F.col("record")))
    last = own.groupBy("file").agg(F.max("line").alias("last_line"))
    return own.join(last, "file")


def get(path: str, kind: str = "string", of: str | Column = "record") -> Column:
    return F.try_variant_get(of if isinstance(of, Column) else F.col(of), path, kind)


def kind_of(path: str, of: str = "record") -> Column:
    """STRING, BOOLEAN, OBJECT<...>, ARRAY<...> ... of what lies at a path; null where nothing does."""
    return F.schema_of_variant(F.try_variant_get(F.col(of), path, "variant"))


def text_at(path: str, of: str = "record") -> Column:
    """A string at a path; other kinds and empty strings are null."""
    value = get(path, "string", of)
    return F.when((kind_of(path, of) == "STRING") & (value != ""), value)


def first_by_line(column: Column) -> Column:
    """The value of the first line that has one."""
    return F.min_by(column, F.when(column.isNotNull(), F.col("line")))


def malformed(rows: DataFrame, known: Column) -> DataFrame:
    """By file: bad lines before the last one, a bad last line, and objects of no known kind."""
    bad = F.col("record").isNull()
    return rows.groupBy("file").agg(
        F.count_if(bad & (F.col("line") < F.col("last_line"))).alias("unparseable_lines"),
        F.count_if(bad & (F.col("line") == F.col("last_line"))).alias("truncated_last_lines"),
        F.count_if(~bad & ~F.coalesce(known, F.lit(False))).alias("unknown_records"),
    )


def not_read(all_files: DataFrame, opened: DataFrame) -> DataFrame:
    """How many files there are beyond those that were opened."""
    return all_files.select("file").distinct().join(opened.select("file").distinct(), "file", "left_anti").agg(F.count("*").alias("not_read"))
