import hashlib
import random

import numpy as np
import pytest

from strandex.llm import yinyang


def lloyd(rows, k, rounds, seed, dims, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, d, c in found), key=repr)


def table(spark, rows, partitions=3):
    schema = "vec_id long, embedding array<float>, cluster string, v int, `a.b` double"
    return spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], schema).repartition(partitions)


def points(seed, n, dims, spread=0.2, centres=7):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(m + rnd.gauss(0, spread)) for m in middle[i % centres]]) for i in range(n)]


@pytest.mark.parametrize(("k", "groups", "dims", "rounds"), [(8, None, 16, 10), (20, 5, 8, 6), (8, 8, 4, 3), (1, 1, 4, 2), (12, 3, 2, 10)])
def test_against_lloyd(spark, k, groups, dims, rounds):
    rows = points(k, 400, dims, spread=0.5)
    found = yinyang.cluster_vectors(table(spark, rows), k=k, rounds=rounds, seed="3", dims=dims, groups=groups)
    got = sorted((tuple(r) for r in yinyang.assignments(found).collect()), key=repr)
    assert got == lloyd(rows, k, rounds, "3", dims)
    assert found.skipped > 0 or k == 1


def test_ties_copies_and_vectors_that_take_no_part(spark):
    grid = [(i, [float(i % 5) / 1024, float(i % 3) / 1024]) for i in range(60)]  # many equal distances
    odd = [(100, None), (101, [1.0]), (102, [1.0, None]), (103, [float("nan"), 0.0]), (104, [float("inf"), 0.0]), (105, [0.0, 1e30]), (None, [0.001, 0.002]), (None, [-0.001, 0.002]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    found = yinyang.assignments(yinyang.cluster_vectors(table(spark, grid + odd), k=8, rounds=10, seed="3", dims=2))
    want = lloyd(grid + [r for r in odd if r[0] != 105], 8, 10, "3", 2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 0.0])]
    found = yinyang.assignments(yinyang.cluster_vectors(table(spark, rows), k=8, rounds=3, seed="3", dims=2))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == lloyd(rows, 8, 3, "3", 2)
    empty = yinyang.assignments(yinyang.cluster_vectors(table(spark, [(1, None)]), k=8, rounds=3, seed="3", dims=2))
    assert empty.columns == found.columns and empty.collect() == []


def test_filters_skip_most_distances(spark):
    rows = points(1, 2000, 16, spread=0.05, centres=30)
    found = yinyang.cluster_vectors(table(spark, rows), k=30, rounds=10, seed="3", dims=16)
    assert found.skipped > 0.5 * 2000 * 30 * 11
