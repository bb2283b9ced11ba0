"""Embedding near-dedup by sorted projection passes.

Exact copies are one row first. In each pass a vector's key is the concatenation of random hyperplane bits; rows
are sorted by (pass, label, key) over the cluster, and each is compared with its neighbours within a bounded
window - its own block of the sorted order and the next. Runs of one key prefix (a cell) longer than that are
compared block by block as well, so dense groups lose no pair. Found pairs are verified by the exact cosine and
united across passes.

A pair is counted in the first pass in which its cells agree, which both rows' keys tell without looking at other
passes; so a group emits a count for each row and a forest, never its pairs. Pairs that only windows bring
together, and no pass's cells, are rare and are counted as distinct rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, unsave
from .components import components, roots
from .vectors import valid

BLOCK = 256
TAIL_BITS = 10  # beyond a cell's prefix, for the order within it


def plan(rows: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """Bits of a cell and the number of passes after which a pair at the threshold is missed with odds of miss."""
    bits = min(50, max(6, math.ceil(math.log2(max(2, rows / BLOCK))) + 3))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same))) if same < 1 else 1


def planes(p: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20, p, dim]).standard_normal((bits + TAIL_BITS, dim))


def keys(x: np.ndarray, p: int, bits: int) -> np.ndarray:
    """The concatenated hashes of each row in pass p, as integers that sort lexicographically."""
    on = x @ planes(p, bits, x.shape[1]).T > 0
    return on @ (1 << np.arange(bits + TAIL_BITS - 1, -1, -1, dtype=np.int64))


def _packed(kind: str) -> Callable:
    """Lists of numbers as bytes."""
    return F.arrow_udf(lambda column: pa.array([np.asarray(v, np.float64).astype(kind).tobytes() for v in column.to_pylist()], pa.binary()), "binary")


KEYED = "pass int, label long, dim int, key long, id long, copies long"


def _pass_rows(bits: int, passes: int, kind: str):
    """A row for each vector and pass: its key, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(3).to_numpy()
            for dim in np.unique(size).tolist():
                rest = b.take(pa.array(np.flatnonzero(size == dim)))
                n = rest.num_rows
                x = np.stack([np.frombuffer(v.as_buffer(), kind) for v in rest.column(4)]).astype(np.float64)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p), pa.int32()), rest.column(1), pa.array(np.full(n, dim), pa.int32()), pa.array(keys(x, p, bits), pa.int64()), rest.column(0), rest.column(2)], ["pass", "label", "dim", "key", "id", "copies"])

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition."""
    from pyspark import TaskContext

    at, pid = 0, TaskContext.get().partitionId()
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid), pa.int64()), pa.array(np.arange(at, at + n), pa.int64())], [*b.schema.names, "pid", "at"])
        at += n


def _compare(bits: int, passes: int, threshold: float, kind: str):
    """Counts, forest and lone window pairs of one group: its side 0 with itself and with side 1 (cells 0), or with side 1 alone."""

    def run(table: pa.Table) -> pa.Table:
        p, dim, key, ident, copies, side, cells = (table[c].to_numpy() for c in ("pass", "dim", "key", "id", "copies", "side", "cells"))
        label = table["label"].to_numpy()
        raw = table["vector"].to_pylist()
        out_a, out_b, out_n = [], [], []
        group = np.stack([p.astype(np.int64), label.astype(np.int64), dim.astype(np.int64)], 1)
        _, which = np.unique(group, axis=0, return_inverse=True)
        which = which.ravel()
        for g in range(which.max() + 1):
            at = np.flatnonzero(which == g)
            own, other = at[side[at] == 0], at[(side[at] == 1) | (cells[at] == 0)]
            if not len(own) or not len(other):
                continue
            now = int(p[at[0]])
            x = np.stack([np.frombuffer(raw[i], kind) for i in own]).astype(np.float64)
            y = np.stack([np.frombuffer(raw[i], kind) for i in other]).astype(np.float64)
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            i, j = np.nonzero(x @ y.T >= threshold)
            a, b = own[i], other[j]
            ok = (side[b] == 1) | (ident[a] < ident[b])  # within one block each pair once
            same = (key[a] >> TAIL_BITS) == (key[b] >> TAIL_BITS)
            ok &= (cells[a] == 0) | same  # later blocks are there for their cell alone
            i, j, a, b, same = i[ok], j[ok], a[ok], b[ok], same[ok]
            if not len(a):
                continue
            before, any_ = np.zeros(len(a), bool), same.copy()
            for q in range(passes):  # recomputed for found pairs only
                if q != now:
                    rows, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
                    k = keys(np.stack([np.frombuffer(raw[r], kind) for r in rows]).astype(np.float64), q, bits) >> TAIL_BITS
                    eq = k[inv[: len(a)]] == k[inv[len(a) :]]
                    any_ |= eq
                    before |= eq & (q < now)
            count = same & ~before
            links = np.zeros(len(ident), np.int64)
            np.add.at(links, a[count], copies[b[count]])
            np.add.at(links, b[count], copies[a[count]])
            has = np.flatnonzero(links)
            out_a.append(ident[has])
            out_b.append(ident[has])
            out_n.append(links[has])
            nodes, low = roots(ident[a], ident[b])
            out_a.append(nodes[nodes != low])
            out_b.append(low[nodes != low])
            out_n.append(np.zeros((nodes != low).sum(), np.int64))
            lone = ~any_
            for u, v in ((a, b), (b, a)):  # -copies of the other: a row of its own, made distinct later
                out_a.append(ident[u[lone]])
                out_b.append(ident[v[lone]])
                out_n.append(-copies[v[lone]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(out_a), pa.int64()), "b": pa.array(cat(out_b), pa.int64()), "n": pa.array(cat(out_n), pa.int64())})

    return run


def near_dedup(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-6) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label).

    Rows are compared when labels are equal and not null and lengths agree, and link when their cosine in double
    precision reaches the threshold. Null, zero and non-finite vectors and null labels link with nothing: n_links
    0 and a component of their own. Copies count as links without being listed. Rows that repeat a vec_id count
    each; a null vec_id takes no part and has a null component. Other columns are left alone.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    marked = rows.withColumn("vector", F.when(valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))))
    named = marked.withColumn("h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")))
    spark = vectors.sparkSession
    kind = "<f4" if "array<float>" in vectors.schema["embedding"].dataType.simpleString() else "<f8"  # as exact as they came
    own = named.where("vector is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    reps = save(own.withColumn("dim", F.size("vector")).withColumn("vector", _packed(kind)("vector")), "vectors")
    bits, passes = plan(reps.count(), threshold, miss)

    order = ["pass", "label", "dim", "key", "id"]
    by_pass = reps.select("id", "label", "copies", "dim", "vector").mapInArrow(_pass_rows(bits, passes, kind), KEYED)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    placed = save(by_pass.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_place, f"{KEYED}, pid long, at long"), "sorted")
    sizes = {r["pid"]: r["n"] for r in placed.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for pid in sorted(sizes):
        starts.append((pid, total))
        total += sizes[pid]
    offsets = spark.createDataFrame(starts or [(0, 0)], "pid long, start long")
    cell = F.shiftright("key", TAIL_BITS)
    at = placed.join(F.broadcast(offsets), "pid").withColumn("block", F.floor((F.col("start") + F.col("at")) / BLOCK)).withColumn("cell", cell).drop("pid", "at", "start")
    columns = ["pass", "label", "dim", "key", "id", "copies"]
    # a block's group has the block (side 0) and the next one (side 1)
    near = at.withColumn("x", F.explode(F.array(F.struct(F.col("block").alias("i"), (F.col("block") + 1).alias("j"), F.lit(0).alias("side")), F.struct((F.col("block") - 1).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))))
    near = near.select(*columns, "x.*", F.lit(0).alias("cells"))
    runs = at.groupBy("pass", "label", "dim", "cell").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("hi - lo >= 2")
    far = at.join(runs, ["pass", "label", "dim", "cell"]).withColumn("o", F.explode(F.sequence("lo", "hi"))).where("abs(o - block) >= 2")
    far = far.select(*columns, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.when(F.col("o") > F.col("block"), 0).otherwise(1).alias("side"), F.lit(1).alias("cells"))
    # keys alone are sorted and placed; vectors join the rows that are compared
    met = near.union(far).join(reps.select("id", "vector"), "id")
    found = save(met.groupBy("i", "j", "cells").applyInArrow(_compare(bits, passes, threshold, kind), "a long, b long, n long"), "found")
    unsave(placed)

    lone = found.where("n < 0").distinct().select("a", (-F.col("n")).alias("n"))
    counts = found.where("n > 0").select("a", "n").union(lone).groupBy("a").agg(F.sum("n").alias("n"))
    comps = components(found.where("a <> b").select("a", "b"))
    tagged = reps.select("label", "h1", "h2", "id", "copies").join(counts.withColumnRenamed("a", "id"), "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    tagged = tagged.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = named.select("vec_id", "label", "h1", "h2").join(tagged, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, for cosines of 0.98 or more within a label; vectors or labels that are null link with nothing."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
OP2_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND {_VALID}),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
