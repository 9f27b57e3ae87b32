import hashlib
import random

import numpy as np
import pytest

from cohortkit.llm import clustering as cl


def brute(rows, k=8, rounds=10, dim=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) by plain k-means on Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and abs(x) < float("inf") for x in v):
            kept.append((i, [int(np.floor(x)) * 1024 if abs(x) >= 2 ** 53 else int(np.floor(x * 1024)) for x in v], v))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    cent = [v for _, v, _ in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        got = [near(v)[1] for _, v, _ in kept]
        cent = [[sum(c) // len(own) for c in zip(*own)] if (own := [v for (_, v, _), g in zip(kept, got) if g == n]) else old
                for n, old in enumerate(cent)]
    got = [(i, *near(v)[::-1]) for i, v, _ in kept]
    total = {n: sum(d for _, m, d in got if m == n) for n in range(len(cent))}
    fits = lambda v: v if v < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted([(i, n, fits(d), fits(total[n]), fits(sum(total.values())), sha[n]) for i, n, d in got], key=repr)


def result(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def rows_of(n=120, dim=64, groups=12):
    rnd = random.Random(5)
    base = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(groups)]
    out = []
    for i in range(n):
        b = base[int(rnd.random() ** 2 * groups)]
        out.append((i, [float(np.float32(x + rnd.gauss(0, .2) * (i % 3 > 0))) for x in b]))
    return out


def test_equals_brute_force(spark):
    rows = rows_of() + [(7, [0.5] * 64), (7, [0.5] * 64), (None, [0.25] * 64), (None, [-0.25] * 64), (200, None), (201, []), (202, [1.0] * 63),
                        (203, [1.0] * 65), (204, [float("nan")] + [0.0] * 63), (205, [float("inf")] + [0.0] * 63), (206, [None] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    df = df.selectExpr("*", "1 AS cluster", "'x' AS distance", "2 AS __id", "3 AS __v", "4 AS k")
    got = result(cl.cluster(df))
    assert got == brute(rows)
    assert len(got) == 124


def test_ties_take_the_smaller_number_and_empty_clusters_stay(spark):
    """Few distinct vectors: equal centroids, empty clusters and vectors half-way between two."""
    rows = [(i, [float(i % 3)] * 4) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(cl.cluster(df, dim=4))
    assert got == brute(rows, dim=4)
    assert len({r[1] for r in got}) <= 3


def test_few_and_no_vectors(spark):
    rows = rows_of(3)
    assert result(cl.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute(rows)
    assert result(cl.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []
    assert result(cl.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))) == []


def test_integers_beyond_64_bits(spark):
    rows = rows_of(30) + [(900 + i, [float(10 ** e)] + [float(i)] * 63) for i, e in enumerate((5, 9, 12, 18, 30, 38, 200, 307))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = result(cl.cluster(df, rounds=2))
    assert got == brute(rows, rounds=2)
    assert any(r[2] is None for r in got) or any(r[4] is None for r in got)


@pytest.mark.parametrize("k", [1, 2, 3, 17, 100])
def test_tree_finds_the_nearest_with_ties(k):
    rnd = np.random.default_rng(k)
    for dim, high in ((2, 4), (3, 1000), (16, 3)):
        points = rnd.integers(-high, high + 1, (k, dim))
        x = np.concatenate([rnd.integers(-high, high + 1, (300, dim)), points])
        tree = cl.VantageTree(points)
        best, dist = tree.nearest(x)
        d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_search_leaves_out_far_nodes():
    """Branch and bound: of well apart groups only the nodes near a vector are visited."""
    rnd = np.random.default_rng(1)
    points = np.repeat(rnd.integers(-10 ** 6, 10 ** 6, (16, 8)), 16, axis=0) + rnd.integers(-5, 6, (256, 8))
    met = []
    tree = cl.VantageTree(points)
    old, cl.squared = cl.squared, lambda x, c: (met.append(len(x)), old(x, c))[1]
    try:
        tree.nearest(points)
    finally:
        cl.squared = old
    assert sum(met) < 0.35 * 256 * 256
