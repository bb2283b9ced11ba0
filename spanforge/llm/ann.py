"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced k-means on a bounded sample and live in memory as a neighbour graph. Every row goes to
its nearest list and, near a boundary, to several (closure within a distance ratio). A query walks the graph over
all centroids within a ratio of its nearest one - the ratio, not a count, prunes lists - and is compared with those
lists' rows, in blocks of bounded size however long a list is. Inner products become distances by one more
coordinate: sqrt(M^2 - |x|^2) for rows, 0 for queries, M the largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, save
from .vectors import matrix, usual_length, valid

SAMPLE = 1 << 17  # rows that centroids are fitted on, at most: 8 for each of MAX_LISTS
LIST = 512  # rows a list, about
MAX_LISTS = 16_384
CLOSURE, COPIES = 0.05, 4
PROBE = 0.14
DEGREE = 32
POST_BLOCK, QUERY_BLOCK = 4096, 1024


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """k centroids of x; a list's size so far weighs against it, so sizes stay alike."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    price = np.zeros(k)
    for _ in range(rounds):
        total, count = np.zeros_like(c), np.zeros(k)
        for s in range(0, len(x), 4096):
            d = (c * c).sum(1) - 2 * x[s : s + 4096] @ c.T
            near = (d + price).argmin(1)
            np.add.at(total, near, x[s : s + 4096])
            count += np.bincount(near, minlength=k)
        full = count > 0
        c[full] = total[full] / count[full, None]
        spread = max(1e-12, float(((x[: len(x)] - x.mean(0)) ** 2).sum(1).mean()))
        price = 0.05 * spread * (count / max(1, len(x) / k) - 1)
    return c


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's nearest others, and a few far ones so that the graph hangs together."""
    k, out = len(c), []
    rng = np.random.default_rng(61)
    for s in range(0, k, 1024):
        d = (c * c).sum(1) - 2 * c[s : s + 1024] @ c.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near = np.argsort(d, axis=1)[:, : min(degree, k)]
        out.append(np.concatenate([near, rng.integers(0, k, (len(d), 4))], axis=1))
    return np.concatenate(out)


class Centroids:
    def __init__(self, c: np.ndarray, graph: np.ndarray, usual: float):
        self.c, self.graph, self.norm, self.usual = c, graph, (c * c).sum(1), usual
        self.entries = np.unique(np.linspace(0, len(c) - 1, min(8, len(c))).astype(int))

    def within(self, x: np.ndarray, ratio: float, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances (inf where not visited) and whether a centroid is within ratio of the nearest found (or of floor), by a walk of the graph."""
        b, k = len(x), len(self.c)
        dist = np.full((b, k), np.inf)
        open_ = np.zeros((b, k), bool)
        xx = (x * x).sum(1)
        new_q, new_c = np.repeat(np.arange(b), len(self.entries)), np.tile(self.entries, b)
        while len(new_q):
            for s in range(0, len(new_q), 1 << 16):
                q, v = new_q[s : s + (1 << 16)], new_c[s : s + (1 << 16)]
                dist[q, v] = np.sqrt(np.maximum(xx[q] + self.norm[v] - 2 * np.einsum("ij,ij->i", x[q], self.c[v]), 0))
            open_[new_q, new_c] = True
            best = np.maximum(dist.min(1), floor)
            q, v = np.nonzero(open_ & (dist <= best[:, None] * (1 + ratio) + 1e-12))
            open_[q, v] = False
            todo = np.zeros((b, k), bool)
            todo[np.repeat(q, self.graph.shape[1]), self.graph[v].ravel()] = True
            new_q, new_c = np.nonzero(todo & np.isinf(dist))
        return dist, dist <= np.maximum(dist.min(1), floor)[:, None] * (1 + ratio) + 1e-12


def _rows(x: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    return ((s, min(s + size, len(x))) for s in range(0, len(x), size))


def _pack(lists: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(lists, kind="stable")
    lists, rows = lists[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        for s in range(a, b, block):
            r = rows[s : min(b, s + block)]
            out.append((int(lists[a]), len(r), int(mix64(ids[r[:1]].view(np.uint64), 8)[0] >> np.uint64(2)), ids[r].tobytes(), x[r].tobytes()))
    if out:
        v = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v[0], pa.int64()), pa.array(v[1], pa.int64()), pa.array(v[2], pa.int64()), pa.array(v[3], pa.binary()), pa.array(v[4], pa.binary())], ["list", "n", "salt", "ids", "vectors"])


PACKED = "list long, n long, salt long, ids binary, vectors binary"


def _postings(model, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = Centroids(*model.value)
        size = max(1, (1 << 23) // len(cents.c))
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column(1))
            for s, e in _rows(x, size):
                y = x[s:e]
                more = np.sqrt(np.maximum(top - (y * y).sum(1), 0))
                dist, near = cents.within(np.hstack([y, more[:, None]]), CLOSURE)
                dist = np.where(near, dist, np.inf)
                first = np.argpartition(dist, min(COPIES, dist.shape[1]) - 1, axis=1)[:, :COPIES]
                r, c = np.nonzero(np.isfinite(np.take_along_axis(dist, first, 1)))
                yield from _pack(first[r, c], r, ids[s:e], y, 1024)

    return run


def _probes(model, sizes, least: int):
    """Queries by the lists that they are compared with: those within the ratio, and more of the nearest until least rows are in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, count = Centroids(*model.value), sizes.value
        size = max(1, (1 << 23) // len(cents.c))
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column(1))
            for s, e in _rows(x, size):
                y = np.hstack([x[s:e], np.zeros((e - s, 1))])
                _, take = cents.within(y, PROBE, cents.usual)  # a query that sits on a centroid looks as far as others do
                for i in np.flatnonzero(take @ count < COPIES * least):
                    order = np.argsort(cents.norm - 2 * cents.c @ y[i])
                    n = int(np.searchsorted(np.cumsum(count[order]), COPIES * least)) + 1
                    take[i, order[:n]] = True
                q, c = np.nonzero(take & (count > 0))
                yield from _pack(c, q, ids[s:e], x[s:e], 512)

    return run


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct v of each q: highest score first, ties to the smaller v."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    q, v, s = q[new], v[new], s[new]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) + 1
    ok = rank <= k
    return q[ok], v[ok], s[ok], rank[ok]


def _scan(k: int, dim: int, groups: int):
    def run(posts: pa.Table, probes: pa.Table) -> pa.Table:
        out = []
        if posts.num_rows and probes.num_rows:
            pid = np.concatenate([np.frombuffer(x, np.int64) for x in posts["ids"].to_pylist()])
            px = np.concatenate([np.frombuffer(x, np.float64) for x in posts["vectors"].to_pylist()]).reshape(-1, dim)
            for ids, vectors in zip(probes["ids"].to_pylist(), probes["vectors"].to_pylist(), strict=True):
                qid, qx = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                for s in range(0, len(qid), 64):
                    score = qx[s : s + 64] @ px.T
                    score[qid[s : s + 64, None] == pid[None, :]] = -np.inf
                    m = min(k, score.shape[1])
                    floor = -np.partition(-score, m - 1, axis=1)[:, m - 1]  # ties at the floor all stay for now
                    i, j = np.nonzero((score >= floor[:, None] - 1e-12 * np.abs(floor[:, None])) & np.isfinite(score))
                    exact = np.einsum("ij,ij->i", qx[s + i], px[j])
                    out.append(_best(qid[s + i], pid[j], exact, k)[:3])
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        group = (mix64(q.view(np.uint64), 9) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        q, v, s, group = q[order], v[order], s[order], group[order]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(q) else np.zeros(1, int)
        rows = [(int(group[a]), q[a:b].tobytes(), v[a:b].tobytes(), s[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({"group": pa.array(cols[0], pa.int64()), "q": pa.array(cols[1], pa.binary()), "v": pa.array(cols[2], pa.binary()), "s": pa.array(cols[3], pa.binary())})

    return run


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        q, v, s = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("q", np.int64), ("v", np.int64), ("s", np.float64)))
        q, v, s, rank = _best(q, v, s, k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product, itself left out by id.

    Both tables have vec_id and embedding; ids are taken as unique (rows that repeat an id and a vector count once).
    Null, zero and non-finite vectors, null ids and vectors of another length than the most frequent take no part.
    All k (or all candidates, if fewer) come back; which of the near ones are found is approximate, scores are not.
    The fit sees SAMPLE rows at most; every row is indexed. No list, slice or probe is capped.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    dim = usual_length(vectors)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = lambda df: df.where(valid() & F.col("vec_id").isNotNull() & (F.size("embedding") == dim)).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, asked = fit(vectors), fit(queries)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    n, top = facts["n"], facts["top"]
    share = -(-n // SAMPLE)  # of the ids' hashes one in so many goes on to the one task that takes the smallest
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(share)) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    x = matrix(some["embedding"])
    x = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])
    c = balanced_kmeans(x, int(min(MAX_LISTS, max(1, n // LIST), max(1, len(x) // 8))))
    usual = float(np.median(np.sqrt(np.maximum((x * x).sum(1)[:1000, None] + (c * c).sum(1) - 2 * x[:1000] @ c.T, 0).min(1))))
    model = sc.broadcast((c, neighbour_graph(c), usual))  # MAX_LISTS centroids at most

    posts = save(rows.mapInArrow(_postings(model, top), PACKED), "postings")
    count = np.zeros(len(c), np.int64)
    for r in posts.groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row for each list
        count[r["list"]] = r["n"]
    probes = save(asked.mapInArrow(_probes(model, sc.broadcast(count), k + 1), PACKED), "probes")
    wanted = np.zeros(len(c), np.int64)
    for r in probes.groupBy("list").agg(F.sum("n").alias("n")).collect():
        wanted[r["list"]] = r["n"]
    cuts = spark.createDataFrame([(i, int(max(1, -(-a // POST_BLOCK))), int(max(1, -(-b // QUERY_BLOCK)))) for i, (a, b) in enumerate(zip(count, wanted, strict=True)) if b], "list long, slices int, blocks int")
    left = posts.join(F.broadcast(cuts), "list").select("list", F.pmod("salt", F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ids", "vectors")
    right = probes.join(F.broadcast(cuts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod("salt", F.col("blocks")).cast("int").alias("block"), "ids", "vectors")
    keys = ["list", "slice", "block"]
    groups = int(max(8, wanted.sum() // 20_000))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(k, dim, groups), "group long, q binary, v binary, s binary")
    return near.groupBy("group").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op6_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the 20 nearest found of each vector whose id is divisible by 20, out of all others. Vectors that are null, zero or not finite take no part."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
