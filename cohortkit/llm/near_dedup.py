"""Near-duplicate documents by a Chosen-Path similarity join over minwise tokens.

1. Each text becomes its set of word shingles and a vector of ``COORDS``
   minwise tokens.  Equal sets are one class, named by their smallest id.
2. ``TREES`` independent trees branch the classes.  A node picks one
   coordinate, and with probability 1/3 a second one (so 4/3 = 1 / similarity
   children on average); classes that agree on the picked token share a child.
   A node of at most ``NODE`` classes is a leaf.  Deeper than ``DEPTH`` a large
   node is cut into blocks and every pair of blocks is a leaf.
3. A leaf compares all its classes by one-byte sketches.  First, in a few
   trees, each class offers its smallest similar neighbours, once a leaf; offered links are confirmed on the
   full shingle sets and joined into components.  Then the leaves of all trees name the
   classes that are similar to one of another component; these get a longer
   sketch and their shingle sets, and each leaf confirms the pairs that the
   longer sketch still shows as similar, one link per two components.  A
   group of near copies thus sends a few links per member, not all its pairs,
   and a group a little below the bound sends its members' sets and no pairs.
4. Confirmed links give the components of the classes, then of the documents.

A pair of similarity 0.75 shares a leaf with probability 0.45 per tree if three
levels are branched, so 16 trees miss about 7 in 100,000 such pairs; all trees
read one sketch, whose bound drops about as many more.  Closer pairs are missed far less often.

Defined cases: a null or empty text has no shingles and is a component of its
own, as is a row with a null id; rows of one id count as one document if their
texts are equal, else each text is linked on its own and the id is in the
smallest component of them; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import shuffle_parts, stage, with_row_ids
from cohortkit.llm.components import components
from cohortkit.llm.shingles import WORDS, mix, shingle_sets

COORDS = 128          # minwise tokens per text
TREES = 16
FIRST_TREES = 5       # trees whose leaves offer neighbours before all of them are searched for what is left
DEPTH = 4             # levels of branching
NODE = 2048           # classes that one leaf compares at most
PERCENT = 75          # least similarity
SKETCH = 0.60         # least share of agreeing sketch bytes of an offered pair
STRONG = 0.85
LONG = 1024           # bytes of the longer sketch
LONG_SHARE = 0.69     # least share of agreeing bytes in it
BROADCAST_IDS = 1 << 20  # ids (8 bytes each) that may be broadcast; beyond it the texts are joined by a shuffle
CLASSES_PER_FILE = 50_000
FAN = 256             # confirmations of one centre in one group

_rnd = np.random.default_rng(7)
_XOR = _rnd.integers(1, 1 << 63, size=COORDS + LONG, dtype=np.uint64)
_MUL = _rnd.integers(1, 1 << 63, size=COORDS + LONG, dtype=np.uint64) | np.uint64(1)
ROWS = 1 << 15        # shingles whose minwise tokens are taken at once


def minwise(sets: list[np.ndarray], first: int = 0, many: int = COORDS) -> np.ndarray:
    """32-bit minwise tokens number ``first`` and on of each non-empty set."""
    out = np.empty((len(sets), many), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= ROWS:
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at:to]])))[:-1]
        for c in range(many):
            out[at:to, c] = np.minimum.reduceat((flat ^ _XOR[first + c]) * _MUL[first + c], starts) >> np.uint64(32)
        at = to
    return out


SLICE = 256           # texts of a batch worked on at once


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = list(shingle_sets(batch.column("text").to_pylist(), words))
        full = [s for s in sets if len(s)]
        tokens = iter(minwise(full)) if full else iter(())
        total = lambda x: int(x.sum(dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([total(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([total(mix(s)) if len(s) else None for s in sets], pa.int64()),
             pa.array([next(tokens).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["id", "n", "one", "two", "tokens"])


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, set size, 128-bit hash of the set (one, two) and minwise tokens of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _sketch(it, words), "id long, n long, one long, two long, tokens binary")


def _child(node: np.ndarray, coord: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(node * np.uint64(0x9E3779B97F4A7C15) + coord.astype(np.uint64) * np.uint64(1 << 32) + token)


def root_coords(trees: int) -> np.ndarray:
    """The coordinate that each tree's root picks."""
    return np.arange(trees) * (COORDS // trees)


def _roots(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _matrix(batch.column("tokens"), np.uint32)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for r in range(trees if len(ids) else 0):
            coord = np.full(len(ids), root_coords(trees)[r])
            node = _child(np.full(len(ids), r + 1, np.uint64), coord, tokens[:, coord[0]].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), r, np.int32))],
                                             names=["node", "id", "tree"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _matrix(batch.column("tokens"), np.uint32)
        node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        ids, tree = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tree"))
        draw = mix(node + np.uint64(1))
        for k in range(2):
            use = np.flatnonzero((draw % np.uint64(3) == 0) | (k == 0))
            coord = (mix(node[use] + np.uint64(2 + k)) % np.uint64(COORDS)).astype(np.int64)
            child = _child(node[use], coord + k * COORDS, tokens[use, coord].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[use]), pa.array(tree[use])],
                                             names=["node", "id", "tree"])


def _sized(rows: DataFrame, files: int) -> DataFrame:
    """Rows of nodes with two classes at least, and the node's size; the rows are staged in ``files`` files at most."""
    rows = stage(rows.coalesce(files), "nodes")
    size = stage(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
                 .withColumnRenamed("node", "__n"), "node-sizes")
    return rows.join(size, rows["node"] == size["__n"]).drop("__n")


def _files(rows: int) -> int:
    """Files of a narrow table of so many rows between the steps.

    On a local disk without Hadoop's native library an executor starts a process to set the mode of each file that it
    writes; that process shares the executor's memory for a moment, and a reader of both counts it twice."""
    return rows // CLASSES_PER_FILE + 6


def leaves(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = NODE) -> tuple[DataFrame, DataFrame]:
    """(node, id, tree) rows of all leaves, and per class the trees whose root's child is a leaf (id, mask).

    No leaf has many more than ``most`` classes; below a root's children ``trees`` is added to the tree's number."""
    files = _files(classes.count())
    rows = stage(_sized(classes.select("id", "tokens").mapInArrow(lambda it: _roots(it, trees), "node long, id long, tree int"),
                        files), "level")
    done = [rows.filter(F.col("size") <= most).select("node", "id", "tree")]
    masks = done[0].select(F.col("id").alias("__m"), "tree").distinct().groupBy("__m").agg(
        F.expr("sum(shiftleft(1L, tree))").alias("mask"))
    rows = rows.select("node", "id", "size", (F.col("tree") + trees).cast("int").alias("tree"))
    for _ in range(depth - 1):
        large = rows.filter(F.col("size") > most)
        if large.isEmpty():
            break
        tokens = classes.select(F.col("id").alias("__id"), "tokens")
        rows = stage(_sized(large.join(tokens, large["id"] == tokens["__id"]).select("node", "id", "tree", "tokens")
                            .mapInArrow(_branch, "node long, id long, tree int"), files), "level")
        done.append(rows.filter(F.col("size") <= most).select("node", "id", "tree"))
    large = rows.filter(F.col("size") > most)
    # every pair of blocks of a node that is still large
    blocks = F.ceil(F.col("size") * 2 / F.lit(most)).cast("int")
    mine = F.pmod(F.xxhash64("id", "node"), blocks.cast("long")).cast("int")
    cut = (large.withColumn("nb", blocks).withColumn("mine", mine)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
           .select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "id", "tree"))
    done.append(cut)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, masks


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The stream, sorted by ``key``, cut so that no key's rows are in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        same = np.flatnonzero(keys != keys[-1])
        cut = int(same[-1]) + 1 if len(same) else 0   # rows before the last key's
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[0]):
            if held[-1].column(key)[-1].as_py() == keys[0]:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            else:
                yield pa.Table.from_batches(held)
                if cut:
                    yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column, kind=np.uint8, width: int = COORDS) -> np.ndarray:
    """Rows of ``width`` numbers of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


PAIRS = 1 << 16       # pairs compared at once


def _offers(batches: Iterator[pa.RecordBatch], percent: int, pick) -> Iterator[pa.RecordBatch]:
    """What ``pick`` takes from the similar pairs of each leaf (rows sorted by node and id).

    ``pick(t)`` gathers pairs and gives its rows once all pairs of a leaf are
    in: their number is bounded by the leaf's classes, not by its pairs."""
    for t in _whole_groups(batches, "node"):
        node, ids, n = (t.column(c).to_numpy() for c in ("node", "id", "n"))
        comp = t.column("comp").to_numpy() if "comp" in t.column_names else None
        data = _matrix(t.column("bytes"))
        edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        start, size = edge[:-1], np.diff(edge)
        for g in np.unique(size[size > 1]).tolist():
            i = np.repeat(np.arange(g), np.arange(g))  # later class, earlier class
            j = np.arange(len(i)) - np.repeat(np.arange(g) * (np.arange(g) - 1) // 2, np.arange(g))
            groups = start[size == g]
            many = max(1, PAIRS // len(i))
            for at in range(0, len(groups), many):
                base = groups[at:at + many, None]
                taken = pick(t)
                for lo in range(0, len(i), PAIRS):    # one large group is compared in parts
                    a, b = (base + i[lo:lo + PAIRS]).ravel(), (base + j[lo:lo + PAIRS]).ravel()
                    use = (ids[a] != ids[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                    if comp is not None:
                        use &= comp[a] != comp[b]
                    a, b = a[use], b[use]
                    share = (data[a] == data[b]).mean(axis=1) if len(a) else np.empty(0)
                    near = share >= SKETCH
                    if near.any():
                        taken.add(a[near], b[near], share[near])
                if (out := taken.rows()).num_rows:
                    yield out


class _Neighbours:
    """Each class's smallest similar and smallest very similar neighbour, unless an earlier tree had the two together."""

    def __init__(self, t):
        self.t, self.best = t, np.full((2, t.num_rows), t.num_rows)

    def add(self, a, b, share) -> None:
        for best, level in zip(self.best, (share >= SKETCH, share >= STRONG)):
            np.minimum.at(best, a[level], b[level])  # the rows of a leaf are sorted by id

    def rows(self) -> pa.RecordBatch:
        ids = self.t.column("id").to_numpy()
        found = [(a := np.flatnonzero(best < self.t.num_rows), best[a]) for best in self.best]
        a, b = np.unique(np.concatenate([np.stack(f) for f in found], axis=1), axis=1)
        keep = _unseen(self.t, a, b)
        return pa.RecordBatch.from_arrays([pa.array(ids[a[keep]]), pa.array(ids[b[keep]])], names=["u", "v"])


def _unseen(t, a, b) -> np.ndarray:
    """Pairs that no earlier tree's root has put into a leaf together: each pair is looked at once above the deeper leaves."""
    trees = len(t.column("roots")[0].as_py()) // 4
    roots = _matrix(t.column("roots"), np.uint32, trees)
    bits = (t.column("mask").to_numpy()[:, None] >> np.arange(trees)) & 1 == 1
    bits &= np.arange(trees) < t.column("tree").to_numpy()[:, None]
    return ~((roots[a] == roots[b]) & bits[a] & bits[b]).any(axis=1)


class _Members:
    """The classes of a leaf that are in any pair that is looked at there."""

    def __init__(self, t):
        self.t, self.use = t, np.zeros(t.num_rows, bool)

    def add(self, a, b, share) -> None:
        use = _unseen(self.t, a, b)
        self.use[a[use]] = self.use[b[use]] = True

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.use)
        return pa.RecordBatch.from_arrays([pa.array(self.t.column(c).to_numpy()[at]) for c in ("node", "id", "tree")],
                                          names=["node", "id", "tree"])


class _Confirmed:
    """Links between components of a leaf: pairs that the longer sketch shows as similar, confirmed on the full sets.

    Components that a link has joined need no second one, so a leaf gives fewer links than it has components."""

    def __init__(self, t, percent: int):
        self.t, self.percent, self.links = t, percent, []
        self.comp = t.column("comp").to_numpy()
        self.now: dict[int, int] = {}

    def _top(self, c: int) -> int:
        now = self.now
        while now.setdefault(c, c) != c:
            now[c] = c = now[now[c]]
        return c

    def add(self, a, b, share) -> None:
        use = _unseen(self.t, a, b)
        a, b = a[use], b[use]
        if not len(a):
            return
        at = np.unique(np.concatenate((a, b)))
        data = _matrix(self.t.column("long").take(pa.array(at)), width=LONG)
        a, b = np.searchsorted(at, a), np.searchsorted(at, b)
        near = np.concatenate([(data[a[k:k + 4096]] == data[b[k:k + 4096]]).mean(axis=1) >= LONG_SHARE
                               for k in range(0, len(a), 4096)])
        need = np.unique(np.concatenate((a[near], b[near])))
        sets = {k: np.frombuffer(raw, np.uint64) for k, raw in zip(
            need.tolist(), self.t.column("shingles").take(pa.array(at[need])).to_pylist())}
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = self._top(int(self.comp[at[i]])), self._top(int(self.comp[at[j]]))
            if x != y and _similar_sets(sets[i], sets[j], self.percent):
                self.now[max(x, y)] = min(x, y)
                self.links.append((at[i], at[j]))

    def rows(self) -> pa.RecordBatch:
        ids = self.t.column("id").to_numpy()
        at = np.array(self.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["u", "v"])


def _similar_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _leaf_rows(rows: DataFrame, classes: DataFrame, masks: DataFrame, comp: DataFrame | None = None,
               long: DataFrame | None = None) -> DataFrame:
    """Leaf rows with set size, sketch and root tokens, and if given component and longer sketch, dealt and sorted by node."""
    columns = ["node", "id", "n", "bytes", "tree", "roots", "mask"]
    small = classes.select(F.col("id").alias("__id"), "n", "bytes", "roots")
    wide = (rows.join(small, rows["id"] == small["__id"]).join(masks, rows["id"] == masks["__m"], "left")
            .withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))))
    if comp is not None:
        columns += ["comp"]
        c = comp.select(F.col("id").alias("__c"), "component")
        wide = wide.join(c, wide["id"] == c["__c"], "left").withColumn("comp", F.coalesce("component", "id"))
    if long is not None:
        columns += ["long", "shingles"]
        k = long.select(F.col("id").alias("__l"), "long", "shingles")
        wide = wide.join(k, wide["id"] == k["__l"])
    return wide.select(*columns).repartition(shuffle_parts(rows.sparkSession), "node").sortWithinPartitions("node", "id")


def _some_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the rows with the given ids (__i); by a checked broadcast, or by a join beyond it."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(side, texts["id"] == F.col("__i"), "left_semi")


def _long_sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [(i, s) for i, s in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), words))
                if len(s)]
        tokens = minwise([s for _, s in sets], COORDS, LONG).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()),
                                          pa.array([t.tobytes() for t in tokens], pa.binary()),
                                          pa.array([s.tobytes() for _, s in sets], pa.binary())],
                                         names=["id", "long", "shingles"])


def _text_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)],
                                          pa.binary())], names=["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (v, part, is the centre first); the centre's row has u = v."""
    us, vs, now, centre = [], [], None, None
    for batch in batches:
        u, v, part = (batch.column(c).to_pylist() for c in ("u", "v", "part"))
        for k, raw in enumerate(batch.column("shingles")):
            mine = np.frombuffer(raw.as_py(), np.uint64)
            if u[k] == v[k]:
                now, centre = (v[k], part[k]), mine
            elif now == (v[k], part[k]) and _similar_sets(mine, centre, percent):
                us.append(u[k])
                vs.append(v[k])
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def confirm(links: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The links whose full shingle sets are similar enough.

    ``links`` has class ids (u > v).  A centre v with many links is dealt into
    groups of about FAN, each with a copy of its set.
    """
    spark = docs.sparkSession
    ids = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).distinct()
    few = _files(links.count())
    ids = stage(ids.withColumnRenamed("id", "__i").coalesce(few), "link-ids")
    sets = stage(_some_texts(docs, ids, id_col, text_col).mapInArrow(
        lambda it: _text_sets(it, words), "id long, shingles binary"), "sets")
    fan = stage(links.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("fan"))
                .withColumnRenamed("v", "__v").coalesce(few), "fan")
    dealt = links.join(fan, links["v"] == fan["__v"]).select(
        "u", "v", F.pmod(F.xxhash64("u"), F.col("fan").cast("long")).cast("int").alias("part"))
    heads = fan.select(F.col("__v").alias("u"), F.col("__v").alias("v"),
                       F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"))
    wanted = dealt.unionByName(heads)
    wide = wanted.join(sets, wanted["u"] == sets["id"]).select("u", "v", "part", "shingles")
    return (wide.repartition(shuffle_parts(spark), "v", "part")
            .sortWithinPartitions("v", "part", (F.col("u") != F.col("v")).cast("int"))
            .mapInArrow(lambda it: _confirm(it, percent), "u long, v long").distinct().coalesce(few))


def _bytes(tokens: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(t, np.uint32).astype(np.uint8).tobytes() for t in tokens], dtype=object)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, most: int = NODE) -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    rows = stage(sketches(docs, id_col, text_col, words), "sketches")
    full = rows.filter("n > 0 and id is not null")
    names = stage(full.groupBy("one", "two", "n").agg(F.min("id").alias("id")), "classes")
    r = full.select(F.col("id").alias("__id"), F.col("one").alias("__1"), F.col("two").alias("__2"), "tokens")
    coords = root_coords(trees)
    small = F.pandas_udf(_bytes, "binary")

    @F.pandas_udf("binary")
    def roots(tokens: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(t, np.uint32)[coords].tobytes() for t in tokens], dtype=object)

    classes = stage(names.join(r, (names["id"] == r["__id"]) & (names["one"] == r["__1"]) & (names["two"] == r["__2"]))
                    .select("id", "n", "one", "two", "tokens").dropDuplicates(["id", "one", "two"])
                    .withColumn("bytes", small("tokens")).withColumn("roots", roots("tokens")), "class-tokens")
    parts = _files(classes.count())  # files of the small tables between the steps
    found, masks = leaves(classes, trees, depth, most)
    found, masks = stage(found, "leaves"), stage(masks.coalesce(parts), "masks")
    # a few trees join most copies; the pairs that are still apart are looked for in all of them
    some = found.filter(F.col("tree") % trees < FIRST_TREES)
    first = stage(_leaf_rows(some, classes, masks).mapInArrow(
        lambda it: _offers(it, percent, _Neighbours), "u long, v long").distinct().coalesce(parts), "offers")
    links = stage(confirm(first, docs, id_col, text_col, words, percent), "confirmed")
    comp = stage(components(links).coalesce(parts), "components")
    # similar pairs in two components: the long way, for their members alone
    open_ = stage(_leaf_rows(found, classes, masks, comp).mapInArrow(
        lambda it: _offers(it, percent, _Members), "node long, id long, tree int").distinct().coalesce(parts), "open")
    if not open_.isEmpty():
        ids = stage(open_.select(F.col("id").alias("__i")).distinct().coalesce(parts), "open-ids")
        long = stage(_some_texts(docs, ids, id_col, text_col).mapInArrow(
            lambda it: _long_sketch(it, words), "id long, long binary, shingles binary").dropDuplicates(["id"]), "long")
        more = stage(_leaf_rows(open_, classes, masks, comp, long).mapInArrow(
            lambda it: _offers(it, percent, partial(_Confirmed, percent=percent)), "u long, v long")
            .distinct().coalesce(parts), "confirmed")
        if not more.isEmpty():
            comp = stage(components(links.unionByName(more)).coalesce(parts), "components")
    c = comp.select(F.col("id").alias("__c"), "component")
    named = stage(names.join(c, names["id"] == c["__c"], "left").select(
        F.col("one").alias("__1"), F.col("two").alias("__2"), F.coalesce("component", "id").alias("component")), "named")
    left = rows.select("id", "n", "one", "two")
    return left.join(named, (left["one"] == named["__1"]) & (left["two"] == named["__2"]), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: one with the smallest id; each row is linked by its own text.

    If the smallest id has several rows in a component, repeated ones or with
    other texts, the one with the least hash of its text stays; rows with a
    null id stay, as they have no component.
    """
    rows, row = with_row_ids(docs)
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"), F.col(row).alias("row"))
    mine = rows.filter(F.col(id_col).isNotNull()).select(F.col(row).alias("near_row"), F.col(text_col).alias("near_text"), own.alias("own"))
    found = near_duplicates(mine, "near_row", "near_text").select(F.col("near_row").alias("__r"), "component_id")
    named = mine.select("near_row", "own")
    named = stage(named.join(found, named["near_row"] == found["__r"]).select("near_row", "own", "component_id"), "near-named")
    best = (named.groupBy("component_id").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.col("component_id").alias("__c"), "best"))
    gone = named.join(best, named["component_id"] == best["__c"]).filter("own != best").select(F.col("near_row").alias("__gone"))
    return rows.join(gone, rows[row] == gone["__gone"], "left_anti").select(*docs.columns)
