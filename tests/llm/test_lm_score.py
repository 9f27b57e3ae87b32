import math
from collections import Counter

import numpy as np
import pytest

from cohortkit.llm import lm_score as lm

DOCS = "doc_id long, text string, score double, target boolean"
TEXTS = {1: "the cat sat on the mat. the cat", 2: "a dog ran, a dog barked", 3: None, 4: "", 5: "the the the the",
         6: "zyx wvu\n\nabc 12", 7: "### ### $$$ " * 4000}


def brute(texts, target):
    """doc -> (tokens, score) with plain counters over the same hashed slots."""
    def slots(t):
        out = []
        for word, before, pair, _ in lm.events([t]):
            out += list(zip(word.tolist(), before.tolist(), pair.tolist()))
        return out
    models = []
    for use in (target, set(texts)):
        w, c, p = Counter(), Counter(), Counter()
        for i in use:
            for a, b, k in slots(texts[i]):
                w[a] += 1
                c[b] += 1
                p[k] += 1
        models.append((w, c, p, sum(w.values())))

    def loss(model, a, b, k):
        w, c, p, total = model
        base = (w[a] + lm.ADD) / (total + lm.ADD * lm.WORDS)
        return -math.log(lm.LAMBDA * min(1.0, p[k] / c[b]) + (1 - lm.LAMBDA) * base if c[b] else base)
    out = {}
    for i, t in texts.items():
        s = slots(t)
        out[i] = (len(s), sum(loss(models[1], *e) - loss(models[0], *e) for e in s) / max(1, len(s)))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, v, 0.0, True) for k, v in texts.items()], DOCS).repartition(3)


def test_matches_brute_force(spark):
    ids = spark.createDataFrame([(1,), (5,), (5,), (None,)], "i long")
    want = brute(TEXTS, {1, 5})
    got = lm.score(frame(spark, TEXTS), ids).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9)
    assert next(r.score for r in got if r.doc_id == 1) > next(r.score for r in got if r.doc_id == 2)


def test_edge_tables(spark):
    df, none = frame(spark, TEXTS), spark.createDataFrame([], "i long")
    want = brute(TEXTS, set())
    for r in lm.score(df.unionAll(df.filter("doc_id = 4")), none).collect():
        assert np.isfinite(r.score) and r.n_tokens == want[r.doc_id][0]
    assert lm.score(df.limit(0), none).count() == 0


def test_one_word_pairs_do_not_cross_texts():
    events = list(lm.events(["a b", None, "b"]))[0]
    assert events[1].tolist()[0] == lm.WORDS and events[1].tolist()[2] == lm.WORDS
    assert events[3].tolist() == [2, 0, 1]


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(lm, "BROADCAST_IDS", 0)
    got = {r.doc_id: r.score for r in lm.score(frame(spark, TEXTS), spark.createDataFrame([(1,)], "i long")).collect()}
    assert got[1] == pytest.approx(brute(TEXTS, {1})[1][1], abs=1e-9)


def test_rare_pairs_share_no_count(spark):
    """More distinct words and pairs than any fixed table, against counters over the words themselves; small blocks."""
    rnd = np.random.default_rng(6)
    name = lambda k: "".join("abcdefghijklmnop"[(int(k) >> 4 * i) & 15] for i in range(6))
    texts = {i: " ".join(name(k) for k in rnd.integers(0, 1 << 24, 4000)) + " the end the cat" for i in range(50)}
    models = []
    for use in (range(10), texts):
        w, p = Counter(), Counter()
        for i in use:
            t = texts[i].split()
            w.update(t)
            p.update(zip(["", *t], t))
        c = Counter()
        for (a, _), n in p.items():
            c[a] += n
        models.append((w, c, p, sum(w.values())))
    size = max(lm.WORDS, len(models[1][0]))
    assert size > lm.WORDS

    def loss(model, a, b):
        w, c, p, total = model
        base = (w[b] + lm.ADD) / (total + lm.ADD * size)
        return -math.log(lm.LAMBDA * p[a, b] / c[a] + (1 - lm.LAMBDA) * base if c[a] else base)
    ids = spark.createDataFrame([(i,) for i in range(10)], "i long")
    got = lm.score(frame(spark, texts), ids, block=100_000).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id].split()
        want = sum(loss(models[1], a, b) - loss(models[0], a, b) for a, b in zip(["", *t], t)) / len(t)
        assert r.n_tokens == len(t) and r.score == pytest.approx(want, abs=1e-9)
