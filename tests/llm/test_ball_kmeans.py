"""Ball k-means against plain integer k-means."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from spanforge.llm import ball_kmeans as b

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k, size, rounds, seed):
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * 1024 < b.LARGEST for x in v)]
    key = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted((key(i), v) for i, v, _ in kept)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v, _ in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    ends = [(i, *near(v)) for i, v, _ in kept]
    of = lambda j: sum(d for _, d, x in ends if x == j)
    return [(i, j, d, of(j), sum(x[1] for x in ends), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in ends]


def test_rounds_ties_and_odd_vectors(spark):
    rnd = random.Random(12)
    grid = [(i, [rnd.randint(-3, 3) / 4 for _ in range(3)], "x") for i in range(150)]  # many ties
    clumps = [(1000 + i, [c + rnd.gauss(0, 0.05) for _ in range(3)], "y") for i in range(90) for c in (rnd.choice([-2, 0, 5]),)]
    odd = [(2000, None, "z"), (2001, [], "z"), (2002, [1.0, None, 2.0], "z"), (2003, [1.0, float("nan"), 2.0], "z"), (2004, [1.0, float("inf"), 2.0], "z"), (2005, [1.0, 2.0], "z"), (2006, [1e30, 0.0, 0.0], "z"), (None, [0.5, 0.5, 0.5], None), (7, [0.0, 0.0, 0.0], None), (8, [-0.0001, 130000.0, -130000.0], None)]
    rows = [(i, v and [None if x is None else float.fromhex(float(x).hex()) for x in v], c) for i, v, c in grid + clumps + grid[:20] + odd]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    rows = [tuple(r) for r in df.collect()]  # as floats
    for k, rounds in ((8, 10), (3, 2), (40, 5), (1, 3), (400, 3)):
        out = b.ball_kmeans(df, k, 3, rounds, 5)
        assert out.columns == ["vec_id", "embedding", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        got = out.drop("embedding").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, k, 3, rounds, 5))), (k, rounds)
    assert b.ball_kmeans(df.limit(0), 8, 3).count() == 0 and b.ball_kmeans(df.where(F.size("embedding") != 3), 8, 3).count() == 0


def test_only_neighbours_are_compared():
    """Members of the stable core meet no other centroid, those of an annulus its neighbours."""
    import numpy as np

    centroids = np.array([[0, 0], [100, 0], [300, 0], [10_000, 0]], np.int64)
    balls, seen = b.Balls(centroids, [170, 10, 10, 10]), []
    assert [n.tolist() for n, _ in balls.near] == [[1, 2], [], [], []]
    x = np.array([[10, 0], [50, 0], [60, 0], [160, 0]], np.int64)
    distance = balls.distance
    balls.distance = lambda v, j: seen.append((j, len(v))) or distance(v, j)
    new, d = balls.nearest(x, np.zeros(4, np.int64))
    assert new.tolist() == [0, 0, 1, 1] and d.tolist() == [100, 2500, 1600, 3600]
    assert seen == [(0, 4), (1, 3), (2, 1)]
