"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, unsave


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a-b and the smallest node that each reaches, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, jump := label[label]):
            label = jump
        if np.array_equal(label[x], label[y]):
            break
    return nodes, nodes[label]


TASK_LINKS = 2_000_000  # links that one task contracts in memory


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, contracted to stars: TASK_LINKS at a time, with the stars so far among them."""
    a = b = np.zeros(0, np.int64)

    def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, low = roots(a, b)
        return nodes[nodes != low], low[nodes != low]

    for batch in batches:
        x, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > TASK_LINKS:
            a, b = stars(a, b)
            if len(a) > TASK_LINKS // 2:  # many small components: let them go as they are
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node in a link to another.

    links has two long columns, in any order and with repeats; links with a null end or to oneself say nothing.
    Tasks contract their links to stars first. What is left, if it fits one task's bound (TASK_LINKS, checked), is
    contracted by one; else star steps go on over the cluster until nothing changes. Rows are links only: a hub is a
    key of aggregations with partial sums and of joins that AQE may split, never a collected list. Each round is
    written to the shared folder.
    """
    a, b = links.columns[:2]
    found = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = save(found.mapInArrow(_forest, "a long, b long"), "links")  # a > b throughout
    last = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] <= TASK_LINKS:
            edges = save(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "links")
            break
        if last == tuple(mark):
            break
        last = tuple(mark)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # larger neighbours hang on the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = save(small, "links")
        unsave(edges)
        edges = new
    heads = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)
