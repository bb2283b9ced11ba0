"""Centroid clustering by ball k-means, in integers.

A cluster is a ball: its centroid and a radius that no member is farther away than. Of a ball, only those centroids are
neighbours that are at most twice the radius away: any other is farther from every member than the own centroid. A member
at distance d from its own centroid lies in the stable core if every neighbour is farther than 2 d away, and keeps its
cluster; otherwise in the annulus of those neighbours that are at most 2 d away, and is compared with these alone. Radii
follow the centroids' moves: old radius and length of the move, rounded up.

Vectors are integers, so all of this is exact: distances are squared, bounds are compared as integers, sums have no order.
A round is one map over the table: it reads vectors with their clusters, writes them with their new ones and, beside
them, a row for each task and cluster with count, sums, farthest member and summed distance. The driver holds the k centroids
and their distances to each other; nothing is shuffled but those rows, and a lost task is run again alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, fresh, new_path, trimmed

SCALE = 1024
LARGEST = 1 << 27  # of an integer component: squared distances of 64 such are below 2**63
VECTOR, SUMS = 0, 1  # values of stats: a vector, a task's row of a cluster
STATE = {"stats": f"{VECTOR}", "row": "", "cluster": "cast(null as int)", "distance": "cast(null as long)", "n": "cast(null as long)", "total": "cast(null as long)", "sums": "cast(null as array<long>)"}


class Balls:
    """k centroids, and for each its neighbours by distance: (numbers, squared distances), the nearest first."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None = None):
        self.centroids = centroids
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for i, radius in enumerate(radii or []):
            apart = ((centroids - centroids[i]) ** 2).sum(1)
            order = np.argsort(apart, kind="stable")
            order = order[(order != i) & (apart[order] <= 4 * radius * radius)]
            self.near.append((order, apart[order]))

    def distance(self, x: np.ndarray, j: int) -> np.ndarray:
        away = x - self.centroids[j]
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, x: np.ndarray, cluster: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid (ties: the smallest number) and the squared distance to it."""
        if cluster is None:  # no balls yet
            cluster, best = np.zeros(len(x), np.int64), self.distance(x, 0)
            for j in range(1, len(self.centroids)):
                d = self.distance(x, j)
                closer = d < best
                cluster[closer], best[closer] = j, d[closer]
            return cluster, best
        out, best = cluster.copy(), np.zeros(len(x), np.int64)
        for i in np.unique(cluster).tolist():
            own = np.flatnonzero(cluster == i)
            d = best[own] = self.distance(x[own], i)
            others, apart = self.near[i]
            annulus = np.searchsorted(apart, 4 * d, side="right")  # of how many neighbours; 0 is the stable core
            for k in range(int(annulus.max(initial=0))):
                rows = own[annulus > k]
                j, d = int(others[k]), self.distance(x[rows], int(others[k]))
                closer = (d < best[rows]) | ((d == best[rows]) & (j < out[rows]))
                out[rows[closer]], best[rows[closer]] = j, d[closer]
        return out, best


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Packed integers of rows of one size."""
    raw = column.buffers()[2]
    if raw is None or not len(column):
        return np.zeros((0, size), np.int64)
    data = np.frombuffer(raw, np.int32)[column.offset * size : (column.offset + len(column)) * size]
    return data.reshape(-1, size).astype(np.int64)


def _round(size: int, balls, keep: int):
    """One pass: rows (carried columns, row, cluster or null) with the nearest centroid, and a row of sums for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = balls.value
        k = len(b.centroids)
        count, sums, far, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            x = _vectors(batch.column(keep + 1), size)
            old = batch.column(keep + 2)
            new, d = b.nearest(x, old.to_numpy(zero_copy_only=False).astype(np.int64) if not old.null_count else None)
            for j in np.unique(new).tolist():
                own = new == j
                count[j] += own.sum()
                sums[j] += x[own].sum(0)
                total[j] += d[own].sum()
                far[j] = max(far[j], d[own].max())
            nothing = pa.nulls(len(x), pa.int64())
            columns = [*batch.columns[:keep], pa.array(np.full(len(x), VECTOR, np.int32)), batch.column(keep + 1), pa.array(new, pa.int32()), pa.array(d), nothing, nothing, pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        used = np.flatnonzero(count)
        if len(used):
            blank = [pa.nulls(len(used), schema.field(c).type) for c in range(keep)]
            columns = [*blank, pa.array(np.full(len(used), SUMS, np.int32)), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(far[used]), pa.array(count[used]), pa.array(total[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return trimmed(run)


def integers(column: str, size: int):
    """The vector's components as floor(1024 x), or null for one that takes no part: another length, a component that is null, not finite or beyond LARGEST."""
    v = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < LARGEST))
    return F.when((F.size(column) == size) & fine, v.cast("array<int>"))


def _pack(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    n = len(column)
    width = flat.nbytes // max(1, n)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def ball_kmeans(vectors: DataFrame, k: int = 8, size: int = 64, rounds: int = 10, seed: int = 3, column: str = "embedding", key: str = "vec_id", carry: tuple[str, ...] | None = None) -> DataFrame:
    """vectors' columns (those of carry, if given: they are written again in each round) with cluster int, distance long, cluster_inertia long, inertia long and centroid_sha256 string (columns of these names are replaced), of every vector that takes part (see integers).

    Centroids 0, 1, ... start as the k vectors of the smallest sha256 of `seed:key` in hexadecimal; of rows that repeat a key,
    and of those without one, which come last, the smaller vector goes first. Fewer vectors than k are so many clusters; none give
    no rows. A round assigns every vector to the nearest centroid (squared distance, ties: the smaller number) and replaces every
    centroid that has vectors by the floor of their mean; at last vectors are assigned once more. Rounds that would change
    nothing are left out. Distances and sums are exact as long as a cluster has fewer than 2**36 vectors.
    """
    spark = vectors.sparkSession
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kept = [c for c in (vectors.columns if carry is None else carry) if c.lower() not in results]
    name = fresh("integers", vectors.columns)
    rows = vectors.withColumn(name, integers(column, size)).where(F.col(name).isNotNull())
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = rows.select(hashed.alias("h"), F.col(name).alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    inner = [f"c{i}" for i in range(len(kept))]
    pack = F.arrow_udf(_pack, "binary")
    blank = [pack(name).alias(c) if c == "row" else F.expr(x).alias(c) for c, x in STATE.items()]
    state = rows.select(*(F.col(c).alias(i) for c, i in zip(kept, inner, strict=True)), *blank)
    schema = state.schema
    radii: list[int] | None = None
    path, found = None, {}
    for t in range(rounds + 1 if len(centroids) else 0):
        balls = spark.sparkContext.broadcast(Balls(centroids, radii))
        new = new_path(spark, "balls")
        state.mapInArrow(_round(size, balls, len(kept)), schema).write.parquet(new)
        if path is not None:
            delete(spark, path)
        path = new
        written = spark.read.schema(schema).parquet(path)
        state = written.where(f"stats = {VECTOR}").select(*schema.names)
        found = _summed(written.where(f"stats = {SUMS}"))
        moved = centroids.copy()
        for j, (n, sums, _, _) in found.items():
            moved[j] = [s // n for s in sums]
        if t == rounds or (moved == centroids).all():
            break
        steps = ((moved - centroids) ** 2).sum(1).tolist()
        radii = [math.isqrt(found[j][2] if j in found else 0) + math.isqrt(steps[j]) + 2 for j in range(len(centroids))]
        centroids = moved
        balls.unpersist()
    every = sum(x[3] for x in found.values())
    facts = [(j, found[j][3] if j in found else 0, every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    table = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return state.join(table, "cluster").select(*(F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)), *results)


def _summed(rows: DataFrame) -> dict[int, tuple[int, list[int], int, int]]:
    """count, sums, largest and summed squared distance of each cluster."""
    sums = (F.sum(c).alias(c) for c in ("n", "x", "total"))
    facts = rows.select("cluster", "distance", "n", "total", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(*sums, F.max("distance").alias("far")).orderBy("cluster", "at").collect()
    by: dict[int, tuple[int, list[int], int, int]] = {}
    for r in facts:  # k x size numbers
        by.setdefault(r["cluster"], (r["n"], [], r["far"], r["total"]))[1].append(r["x"])
    return by


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of 64 finite components."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ball_kmeans(vectors, carry=("vec_id",)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, size: int = 64, rounds: int = 10, seed: int = 3) -> str:
    out = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        "x AS MATERIALIZED (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))",
        "y0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM c0)",
    ]
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN y{t} USING (i) GROUP BY k, c) GROUP BY k)")
        if t < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            out.append(f"m{t} AS (SELECT c, i, {mean} AS m FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{t} USING (k) GROUP BY c, i))")
            out.append(f"y{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, y) AS y FROM y{t} LEFT JOIN m{t} USING (c, i))")
    out.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS s FROM y{rounds} GROUP BY c)")
    return f"WITH {', '.join(out)} SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256 FROM kept JOIN a{rounds} USING (k) JOIN h USING (c)"


OP12_SQL = _sql()
