"""Sinks for a scan's result: tables as files, and one JSON document of the small ones."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000  # of a table in the document


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table below its name. Nothing is collected; an existing folder is an error."""
    for name, table in tables.items():
        table.write.format(kind).save(f"{folder}/{name}")


def document(tables: dict[str, DataFrame]) -> str:
    """A JSON object of report tables, which rules and categories bound; one of more than MOST_ROWS rows is refused."""
    out = {}
    for name, table in tables.items():
        rows = table.select(F.to_json(F.struct("*")).alias("j")).limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows: write it as a table")
        out[name] = [json.loads(r["j"]) for r in rows]
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def quoted(text: Column) -> Column:
    """A text as one word of a shell command."""
    return F.when(text.rlike(r"^[A-Za-z0-9_@%+=:,./][A-Za-z0-9_@%+=:,./-]*$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def fixes(findings: DataFrame) -> DataFrame:
    """findings (category, kind, folder, name, hash) with `command`, which undoes one, and `left_out`, why there is none.

    Kinds: branch-delete (name, hash), stash-drop (hash), hooks-path, tracked-missing (name: the path) and tunnel (name: the program). A
    command names exactly what was lost, so it is for the machine's own user, not for a report. Names that hold a line feed
    or another control sign, and hashes that are none, make no safe command.
    """
    safe = lambda c: F.coalesce((F.length(c) > 0) & ~c.rlike(r"\p{Cntrl}"), F.lit(False))
    hashed = F.coalesce(F.col("hash").rlike("^[0-9a-f]{7,64}$"), F.lit(False))
    git = F.concat(F.lit("git -C "), quoted(F.col("folder")), F.lit(" "))
    name, kind, here = F.col("name"), F.col("kind"), safe(F.col("folder"))
    command = (
        F.when((kind == "branch-delete") & here & safe(name) & ~name.startswith("-") & hashed, F.concat(git, F.lit("branch -- "), quoted(name), F.lit(" "), "hash"))
        .when((kind == "stash-drop") & here & hashed, F.concat(git, F.lit("stash apply "), "hash"))
        .when((kind == "hooks-path") & here, F.concat(git, F.lit("config --unset core.hooksPath")))
        .when((kind == "tracked-missing") & here & safe(name), F.concat(git, F.lit("restore -- "), quoted(name)))
        .when((kind == "tunnel") & safe(name), F.concat(F.lit("pkill -x -- "), quoted(name)))
    )
    known = kind.isin("branch-delete", "stash-drop", "hooks-path", "tracked-missing", "tunnel")
    return findings.withColumn("command", command).withColumn("left_out", F.when(F.col("command").isNull(), F.when(F.coalesce(known, F.lit(False)), "no safe command").otherwise("no fix")))
