import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortkit.llm import near_dedup as nd
from cohortkit.llm.components import components
from cohortkit.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, id string, component string"


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    """doc_id -> (set size, component) by all pairs and a plain search."""
    sets = dict(zip([r[0] for r in rows], plain_sets([r[1] for r in rows])))
    comp = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    change = True
    while change:
        change = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                change = True
    return {k: (len(sets[k]), comp[k]) for k in sets}


def case(seed=2):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(40, 160))] for _ in range(25)]
    shared = [rnd.choice(vocabulary) for _ in range(60)]
    for b in base:
        for _ in range(rnd.randint(1, 5)):
            w = list(b)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append(w if rnd.random() < 0.7 else w + shared)
    hot = [rnd.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # a large group of near copies
        w = list(hot)
        w[rnd.randrange(120)] = "x%d" % i
        rows.append(w)
    texts = [" ".join(w) for w in rows]
    texts += [None, "", "  \n", "a b", "A  b", "a b c", "k " * 20000, "K\n" * 300, "\x0b".join("abcdefgh"), "a b c d e f"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab cB\n\té", max_size=40)), max_size=12))
def test_shingles_are_those_of_the_words(texts):
    plain = plain_sets(texts)
    hashed = list(shingle_sets(texts))
    assert [len(s) for s in plain] == [len(s) for s in hashed]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    got = nd.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    return df


def test_matches_brute_force(spark):
    check(spark, case())


def test_branching_and_blocks_lose_nothing(spark):
    check(spark, case(5), most=8, depth=2)


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", ""), (2, "a b c d e f", "", ""), (2, "a b c d e f", "", ""),
                                (9, "a b c d e f", "", "")], DOCS)
    rows = sorted((r.doc_id or 0, r.component_id, r.kept) for r in nd.near_duplicates(df).collect())
    assert rows == [(0, None, True), (2, 2, True), (2, 2, True), (9, 2, False)]
    assert nd.near_duplicates(df.limit(0)).count() == 0
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("size", [300, 2000])
def test_a_leaf_offers_each_class_once(size):
    """All classes of a leaf similar and still apart: rows grow with the classes, not with the pairs."""
    sets = [np.arange(100, dtype=np.uint64) * np.uint64(7919) + np.uint64(k < 0) for k in range(size)]
    data = np.random.default_rng(1).integers(0, 256, nd.COORDS, dtype=np.uint8).tobytes()
    long = nd.minwise(sets[:1], nd.COORDS, nd.LONG).astype(np.uint8).tobytes()
    ids = np.arange(size)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(size, np.int64)), pa.array(ids), pa.array(np.full(size, 100)), pa.array([data] * size), pa.array(np.zeros(size, np.int32)),
         pa.array([k.to_bytes(4, "little") * nd.TREES for k in range(size)]), pa.array(np.zeros(size, np.int64)), pa.array(ids),
         pa.array([long] * size), pa.array([s.tobytes() for s in sets])],
        names=["node", "id", "n", "bytes", "tree", "roots", "mask", "comp", "long", "shingles"])
    rows = lambda pick: sum(b.num_rows for b in nd._offers(iter([batch]), nd.PERCENT, pick))
    assert rows(nd._Members) == size
    assert rows(nd._Neighbours) == size - 1
    assert rows(partial(nd._Confirmed, percent=nd.PERCENT)) == size - 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5)], "u long, v long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3}


def test_each_row_goes_by_its_own_text(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1)), (5, words(1)), (5, words(2)), (6, words(3)), (7, words(4)), (7, words(3) + " more"),
            (8, words(5)), (8, words(5) + " more"), (9, words(5)), (None, words(1)), (5, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    got = [(r.doc_id, r.text) for r in nd.keep_one(df).collect()]
    eight = [t for i, t in got if i == 8]
    assert len(eight) == 1 and eight[0] in (words(5), words(5) + " more")
    assert sorted((i or 0, t or "") for i, t in got if i != 8) == sorted(
        [(0, words(1)), (1, words(1)), (5, ""), (5, words(2)), (6, words(3)), (7, words(4))])


def test_narrow_tables_are_a_few_files_whatever_the_partitions(spark, monkeypatch):
    """Each file that an executor writes to a local disk starts a process for its mode."""
    rows = [(k, " ".join("w%d" % (k // 2 * 100 + i) for i in range(30 + k % 2))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    files, old = {}, nd.stage

    def stage(df, name):
        out = old(df, name)
        files.setdefault(name, out)
        return out

    monkeypatch.setattr(nd, "stage", stage)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {k: k // 2 * 2 for k in range(400)}
    assert files["confirmed"].count() == 200
    assert {name: len(files[name].inputFiles()) for name in ("nodes", "confirmed")} == {"nodes": 6, "confirmed": 6}
