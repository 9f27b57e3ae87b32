"""Exact k-means on integer vectors with a vantage-point tree over the centroids.

Vectors of ``dim`` finite components become integers floor(scale * x).  Each
round builds a vantage-point tree over the k centroids on the driver,
broadcasts it (k * dim integers, whatever the table's size) and looks up every
vector by a best-first branch and bound: of the nodes still open the one with
the least lower bound is visited next, and a node is given up only if its bound
lies above the best distance so far, so that centroids at an equal distance are
still met and the smaller number wins.  Bounds are floating-point square roots
with a margin; distances are exact integers.  The search runs over a batch of
vectors at once, each in its own order.

New centroids are the exact floor of the mean: tasks add up their vectors,
Spark adds up the tasks' sums, and k * dim sums reach the driver.

Defined cases: a vector that is null, has another number of components, or a
null, NaN or infinite one is left out; repeated rows count each for itself; a
null id comes last among the first centroids, equal ids by their components;
fewer vectors than k start as many centroids as there are; an empty table gives
an empty result; integers beyond 64 bits are computed as Python integers, and a
distance or an inertia that a long can't hold is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stage

K, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
LEAF = 2               # centroids in a leaf
MARGIN = 1e-12         # relative; far above the rounding of a square root
LIMB = 40              # bits of a partial sum that travel as one long
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where one may be too large for exact 64-bit distances."""
    with np.errstate(over="ignore"):
        low = np.floor(x * scale)
        if not len(x) or x.shape[1] * (2 * np.abs(low).max(initial=0)) ** 2 < 2.0 ** 62:
            return low.astype(np.int64)
    exact = [math.floor(v) * scale if abs(v) >= 2 ** 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to the point ``c``."""
    d = x - c
    return (d * d).sum(axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    """Square roots; beyond 10^150 they stay there, which only makes bounds weaker."""
    if d.dtype == object:
        return np.array([math.sqrt(min(v, 10 ** 300)) for v in d.tolist()], np.float64)
    return np.sqrt(d.astype(np.float64))


@dataclass
class Node:
    members: list[int]                       # of a leaf; else empty
    vantage: int = -1
    children: list[tuple[int, float, float]] = field(default_factory=list)  # node, least and greatest distance to the vantage


class VantageTree:
    """Vantage-point tree over the rows of ``points`` (integers)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes, self.leaf = points, [], leaf
        if len(points):
            self._build(list(range(len(points))))

    def _build(self, members: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(members))
        if len(members) > self.leaf:
            vantage, rest = members[0], np.array(members[1:])
            d = squared(self.points[rest], self.points[vantage])
            middle = sorted(d.tolist())[(len(rest) - 1) // 2]
            parts = [p for p in (d <= middle, d > middle) if p.any()]
            if len(parts) == 2:
                self.nodes[at] = Node([], vantage)
                for p in parts:
                    r = roots(d[p])
                    self.nodes[at].children.append((self._build(rest[p].tolist()), r.min(), r.max()))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest point of each row (the smaller one of a tie) and its squared distance."""
        n, none = len(x), len(self.points)
        best, dist = np.full(n, none), np.zeros(n, dtype=x.dtype)
        reach = np.full(n, np.inf)                            # the best distance so far, rounded up
        bound = np.full((n, len(self.nodes)), np.inf)         # of the open nodes, rounded down
        bound[:, 0] = 0

        def meet(rows: np.ndarray, k: int) -> np.ndarray:
            d = squared(x[rows], self.points[k])
            better = (best[rows] == none) | (d < dist[rows]) | ((d == dist[rows]) & (k < best[rows]))
            use = rows[better.astype(bool)]
            best[use], dist[use] = k, d[better.astype(bool)]
            r = roots(d)
            reach[rows] = np.minimum(reach[rows], r * (1 + MARGIN))
            return r

        todo = np.arange(n)
        while len(todo):
            node = bound[todo].argmin(axis=1)
            low = bound[todo, node]
            still = (low <= reach[todo]) & (low < np.inf)     # inclusive: an equal distance may have a smaller number
            todo, node, low = todo[still], node[still], low[still]
            bound[todo, node] = np.inf
            for k in np.unique(node).tolist():
                rows, own = todo[node == k], low[node == k]
                for m in self.nodes[k].members:
                    meet(rows, m)
                if self.nodes[k].children:
                    r = meet(rows, self.nodes[k].vantage)
                    for child, least, most in self.nodes[k].children:
                        gap = np.maximum(r - most, least - r) - MARGIN * (r + most)
                        bound[rows, child] = np.maximum(own, np.maximum(gap, 0))
        return best, dist


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("__v").flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _assigned(scale: int, tree) -> Callable:
    """Batches of vectors -> (batch, integers, cluster, distance)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                x = integers(_vectors(batch), scale)
                if tree.value.points.dtype == object or x.dtype == object:
                    x = x.astype(object)
                yield batch, x, *tree.value.nearest(x)
    return run


def _sums(scale: int, tree) -> Callable:
    """(cluster, component, limb, value) sums of a task's vectors; component -1 holds the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        count: dict[int, int] = {}
        for _, x, cluster, _ in _assigned(scale, tree)(batches):
            for k in np.unique(cluster).tolist():
                own = x[cluster == k].sum(axis=0).tolist()
                total[k] = [a + b for a, b in zip(total[k], own)] if k in total else own
                count[k] = count.get(k, 0) + int((cluster == k).sum())
        rows = []
        for k, sums in total.items():
            for j, value in [(-1, count[k]), *enumerate(sums)]:
                limb = 0
                while not -(1 << LIMB) <= value < 1 << LIMB:
                    rows.append((k, j, limb, value & ((1 << LIMB) - 1)))
                    value >>= LIMB
                    limb += 1
                rows.append((k, j, limb, value))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["k", "j", "limb", "value"])
    return run


def _labels(scale: int, tree, out: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, dist in _assigned(scale, tree)(batches):
            d = [v if v <= LONG else None for v in dist.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(out.field(0).type), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], schema=out)
    return run


def _moved(vectors: DataFrame, centroids: np.ndarray, scale: int, tree) -> np.ndarray:
    """The exact floor of each cluster's mean; an empty cluster's centroid stays."""
    rows = (vectors.select("__v").mapInArrow(_sums(scale, tree), "k int, j int, limb int, value long")
            .groupBy("k", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    sums: dict[tuple[int, int], int] = {}
    for r in rows:
        sums[r.k, r.j] = sums.get((r.k, r.j), 0) + (int(r.value) << (LIMB * r.limb))
    new = [[sums[k, j] // sums[k, -1] for j in range(centroids.shape[1])] if (k, -1) in sums else centroids[k].tolist()
           for k in range(len(centroids))]
    return as_points(new)


def as_points(rows: list[list[int]]) -> np.ndarray:
    if any(len(r) * (2 * max(map(abs, r), default=0)) ** 2 >= 1 << 62 for r in rows):
        return np.array(rows, dtype=object)
    return np.array(rows, dtype=np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "3",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    fine = (F.size(vector_col) == dim) & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = stage(vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).filter(fine), "vectors")
    first = (kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")), 256).alias("h"), "__v")
             .orderBy(F.col("h").asc_nulls_last(), "__v").limit(k).collect())
    start = integers(np.array([r["__v"] for r in first], np.float64).reshape(len(first), dim), scale)
    centroids = as_points(start.tolist()) if first else np.empty((0, dim), np.int64)
    for _ in range(rounds if first else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        centroids = _moved(kept, centroids, scale, tree)
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    schema = f"__id {id_type.simpleString()}, cluster int, distance long"
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    labels = stage(kept.mapInArrow(_labels(scale, tree, out), schema), "labels") if first else spark.createDataFrame([], schema)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = labels.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), exact).alias("s")).collect()
    whole = None if any(r.s is None for r in per) else sum(int(r.s) for r in per)
    fits = lambda v: None if v is None or v > LONG else int(v)
    facts = [(r.cluster, fits(r.s), fits(whole), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest())
             for r in per]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(facts), "cluster").select(
        F.col("__id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
