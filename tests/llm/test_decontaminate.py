import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortkit.llm import decontaminate as dc
from cohortkit.llm.fm_index import FMIndex, suffix_order

DOCS = "doc_id long, text string, items string, spans string, n_chars long"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=2), min_size=1))
def test_index_finds_every_occurrence(codes, phrases):
    codes = np.array(codes, np.int64)
    index = FMIndex(codes)
    lo, hi = index.search(np.array(phrases))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(codes) - 1) if list(codes[i:i + 2]) == p]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_suffix_order_of_repeats():
    codes = np.array([1] * 50 + [0] + [1] * 3)
    order = suffix_order(codes)
    assert sorted(order) == list(range(54))
    assert list(order[:3]) == [50, 49, 53]


def brute(docs, items, window=10):
    out = {}
    for doc, text in docs:
        w = dc.words(text)
        hit, ids = set(), set()
        for item, t in items:
            x = dc.words(t)
            k = min(window, len(x))
            for i in range(len(x) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j:j + k] == x[i:i + k]:
                        hit |= set(range(j, j + k))
                        ids.add(item)
        out[doc] = (len(w), len(hit), sorted(i for i in ids if i is not None))
    return out


def _case():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "b", "cc", "Dd", "é", "9"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 16)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (None, "null id item words are here"), (3, items[3][1]),
              (-7, "an id below nothing"), (-1, "another id below nothing"), (-(1 << 63), "the least id of all")]
    docs = [(i, ", ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x y " + items[4][1] + "! z " + items[4][1]), (103, "null id item words are here"),
             (104, "a " * 30000), (103, "null id item words are here"),
             (105, "an id below nothing, another id below nothing"), (106, "the least id of all; null id item words are here")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = _case()
    df = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (dc.BLOCK_BYTES, 40):  # one block of items, and several
        got = dc.search(df, bench, ["doc_id"], block_bytes=size)
        seen = got.collect()
        assert len(seen) == len(docs)
        for r in seen:
            n, hit, ids = want[r.doc_id]
            assert (r.n_words, sum(b - a for a, b in r.spans), [i for i in r["items"] if i is not None]) == (n, hit, ids)
    digest = dc.digest(got).toPandas().set_index("doc_id")
    assert digest.loc[102, "contaminated"] and not digest.loc[100, "contaminated"]


def test_empty_tables_and_columns(spark):
    docs, items = _case()
    df = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.search(df.limit(0), bench, ["doc_id"]).count() == 0
    none = dc.search(df, bench.limit(0), ["doc_id", "n_chars"]).toPandas()
    assert (none["n_words"] >= 0).all() and len(none) == len(docs)
    assert dc.remove(df, bench).columns == df.columns


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep this. {passage.title()}, and that.", 5), (2, "clean text", 10), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = dc.remove(df, bench)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert got == {1: ("Keep this. , and that.", 22), 2: ("clean text", 10), 3: (None, None)}


def test_removal_takes_one_python_step(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, passage, 55, "x"), (2, "", 0, "y"), (3, f"a {passage}", 57, None), (3, f"a {passage}", 57, None), (None, "b", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, __cut_ string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = dc.remove(df, bench)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan  # one worker with texts for each core
    assert got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "", 0, "x"), (2, "", 0, "y"), (3, "a ", 2, None), (3, "a ", 2, None), (None, "b", 1, "")], key=repr)
