"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Word vectors come from all documents: every token slot has a sparse random
index vector, and a slot's vector is the sum of the index vectors of the
tokens up to ``REACH`` places away, over the corpus.  Tasks add up their own
(SLOTS x DIM) table, tables are summed by slot, and the table's fixed size is
what the driver and the broadcast hold.  A document is the weighted mean and
spread of its tokens' vectors plus three figures of the pool.  The network
(numpy, one hidden layer) is fitted on at most ``SAMPLE`` labelled documents
outside the held-out fold, and its logits are divided by a temperature that is
fitted on a part of them kept aside.

Defined cases: a null or empty text has an all-zero pool and gets the
network's score for that; repeated rows are scored each for itself; a null
id counts as the empty text in the fold rule; repeated labels of an id count
each; null labels are left out; without both labels in the sample every score
is the share of label 1 (0.5 without labels); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stage
from cohortkit.llm.shingles import mix
from cohortkit.llm.slots import token_hashes

SLOTS = 1 << 14
DIM = 48
ONES = 4              # non-zero places of an index vector
REACH = 2
RARE = 1e-3           # weight of a token of frequency p: RARE / (RARE + p)
SAMPLE = 20_000       # labelled rows that the network is fitted on, at most
HIDDEN = 32
EPOCHS = 40
FOLDS = 5
THRESHOLD = 0.3
FEATURES = 2 * DIM + 3
SLICE = 512           # texts of a batch worked on at once


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's index vector."""
    draw = mix(np.arange(SLOTS * ONES, dtype=np.uint64) + np.uint64(99))
    return ((draw >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64).reshape(SLOTS, ONES), \
        (draw & np.uint64(1)).astype(np.int64).reshape(SLOTS, ONES) * 2 - 1


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slot: how often it occurs and its sum of neighbours' index vectors."""
    place, sign = index_vectors()
    table, seen = np.zeros(SLOTS * DIM), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for hashes, counts in token_hashes(batch.column("text").slice(at, SLICE).to_pylist()):
                slot = (hashes % np.uint64(SLOTS)).astype(np.int64)
                seen += np.bincount(slot, minlength=SLOTS)
                doc = np.repeat(np.arange(len(counts)), counts)
                for far in range(1, REACH + 1):
                    near = np.flatnonzero(doc[far:] == doc[:-far]) if len(doc) > far else np.empty(0, np.int64)
                    for a, b in ((slot[near], slot[near + far]), (slot[near + far], slot[near])):
                        for k in range(ONES):
                            table += np.bincount(a * DIM + place[b, k], weights=sign[b, k], minlength=SLOTS * DIM)
    used = np.flatnonzero(seen)
    rows = table.reshape(SLOTS, DIM)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used]),
                                      *[pa.array(rows[:, d]) for d in range(DIM)]],
                                     names=["slot", "n", *[f"v{d}" for d in range(DIM)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and pooling weights of all slots (float32), from every document."""
    cols = ["n", *[f"v{d}" for d in range(DIM)]]
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _gather, "slot int, " + ", ".join(f"{c} long" for c in cols))
    sums = rows.groupBy("slot").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most SLOTS rows
    vectors, weights = np.zeros((SLOTS, DIM)), np.zeros(SLOTS)
    if len(sums):
        vectors[sums["slot"]] = sums[cols[1:]].to_numpy(float)
        n = sums["n"].to_numpy(float)
        weights[sums["slot"]] = RARE / (RARE + n / n.sum())
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32), weights.astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """FEATURES numbers per text."""
    out = []
    for hashes, counts in token_hashes(texts):
        slot = (hashes % np.uint64(SLOTS)).astype(np.int64)
        got = np.zeros((len(counts), FEATURES), np.float64)
        full = np.flatnonzero(counts)
        if len(full):
            start = (np.cumsum(counts) - counts)[full]
            w = weights[slot][:, None]
            rows = vectors[slot] * w
            total = np.add.reduceat(w, start, axis=0, dtype=np.float64)
            mean = np.add.reduceat(rows, start, axis=0, dtype=np.float64) / total
            square = np.add.reduceat(rows * vectors[slot], start, axis=0, dtype=np.float64) / total
            got[full, :DIM] = mean
            got[full, DIM:2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
            n = counts[full]
            doc = np.repeat(np.arange(len(full)), n)
            kinds = np.bincount(np.unique(doc * SLOTS + slot) // SLOTS, minlength=len(full))
            same = np.concatenate(([False], (slot[1:] == slot[:-1]) & (doc[1:] == doc[:-1])))
            got[full, 2 * DIM] = np.log1p(n)
            got[full, 2 * DIM + 1] = np.log(kinds) / np.log1p(n)
            got[full, 2 * DIM + 2] = np.bincount(doc, weights=same, minlength=len(full)) / n
        out.append(got)
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


class Network:
    """FEATURES -> HIDDEN (tanh) -> 1, with input scaling and a temperature."""

    def __init__(self, seed: int = 0):
        rnd = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.w1, self.b1 = rnd.normal(size=(FEATURES, HIDDEN)) / np.sqrt(FEATURES), np.zeros(HIDDEN)
        self.w2, self.b2 = rnd.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)
        self.temperature = 1.0
        self.constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 3e-3,
            l2: float = 1e-4) -> None:
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rnd = np.random.default_rng(1)
        aside = np.zeros(len(x), bool)
        aside[rnd.permutation(len(x))[:len(x) // 5]] = True
        cal_x, cal_y, x, y = x[aside], y[aside], x[~aside], y[~aside]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        values = [self.w1, self.b1, self.w2, self.b2]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = rnd.permutation(len(z))
            for at in range(0, len(z), batch):
                b = order[at:at + batch]
                h = np.tanh(z[b] @ self.w1 + self.b1)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -30, 30))) - y[b]) / len(b)
                dh = np.outer(d, self.w2) * (1 - h * h)
                step += 1
                for v, g, m, s in zip(values, (z[b].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)), first, second):
                    g = g + l2 * v
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
        self._calibrate(cal_x, cal_y)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Temperature of least log loss on rows kept aside."""
        if len(x):
            raw = self.logits(x)
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -raw / t * (2 * y - 1)).sum()))


def _pools(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    vectors, weights = held.value
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = pool(part.column("text").to_pylist(), vectors, weights).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), pa.array(list(x), pa.list_(pa.float32()))],
                                             names=["key", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, held, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Network:
    """Network fitted on the labelled rows with the lowest hashes of the id, outside the held-out fold."""
    chosen = stage(labels.select(F.col(id_col).alias("__i"), F.col(label_col).cast("double").alias("y"),
                                 F.xxhash64(id_col).alias("key"))
                   .filter(F.col("y").isNotNull() & F.col("__i").isNotNull() & ~held_out("__i"))
                   .orderBy("key", "y").limit(sample), "labelled")
    rows = (docs.select(F.col(id_col).alias("__d"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), F.col("__d") == F.col("__i"))  # at most SAMPLE rows
            .select("key", "y", "text").mapInArrow(lambda it: _pools(it, held), "key long, y double, x array<float>")
            .orderBy("key", "y", "x").limit(2 * sample).collect())
    net = Network()
    x = np.array([r.x for r in rows], np.float64).reshape(-1, FEATURES)
    net.fit(x, np.array([r.y for r in rows]))
    return net


def _score(batches: Iterator[pa.RecordBatch], held, net) -> Iterator[pa.RecordBatch]:
    vectors, weights = held.value
    for batch in batches:
        got = [net.value.scores(pool(batch.column("text").slice(at, SLICE).to_pylist(), vectors, weights))
               for at in range(0, batch.num_rows, SLICE)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(got) if got else np.empty(0))],
                                         names=["id", "score"])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(word_vectors(docs, text_col))                              # SLOTS x (DIM + 1) numbers
    net = sc.broadcast(fit(docs, labels, held, label_col, id_col, text_col, sample))
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(lambda it: _score(it, held, net), f"id {kind}, score double")
            .select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
