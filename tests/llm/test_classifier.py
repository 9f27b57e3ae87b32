import zlib

import numpy as np
import pytest

from cohortkit.llm import classifier as qc
from cohortkit.llm.slots import token_hashes

DOCS = "doc_id long, text string, quality int, score double"
LABELS = "doc_id long, quality int"


def plain_tokens(text):
    """Runs of letters, digits or one symbol; a line end each for itself."""
    out, last = [], None
    for b in (text or "").encode().lower():
        if b in b" \t\r\x0b\x0c":
            last = None
            continue
        kind = "l" if b >= 128 or 97 <= b <= 122 else "d" if 48 <= b <= 57 else b
        if kind == last and b != 10:
            out[-1] += bytes([48 if kind == "d" else b])
        else:
            out.append(bytes([48 if kind == "d" else b]))
        last = kind
    return out


TEXTS = ["Ab ab, ab!!  12 345\n\né-x###$", None, "", " \t", "a", "9 99", "x" * 50_000, "\n\n"]


def test_tokens():
    want = [plain_tokens(t) for t in TEXTS]
    hashes, counts = zip(*token_hashes(TEXTS))
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    assert counts.tolist() == [len(w) for w in want]
    flat = sum(want, [])
    assert all((flat[i] == flat[j]) == (hashes[i] == hashes[j]) for i in range(len(flat)) for j in range(i))


def test_word_vectors_are_neighbour_sums(spark):
    texts = ["a b c a", "b a", None, "c c c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vectors, weights = qc.word_vectors(df)
    place, sign = qc.index_vectors()
    slot = {w: int(next(token_hashes([w]))[0][0] % np.uint64(qc.SLOTS)) for w in "abc"}
    want, seen = {w: np.zeros(qc.DIM) for w in "abc"}, dict.fromkeys("abc", 0)
    for t in texts:
        w = (t or "").split()
        for i, x in enumerate(w):
            seen[x] += 1
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    np.add.at(want[x], place[slot[w[j]]], sign[slot[w[j]]])
    for w in "abc":
        assert np.allclose(vectors[slot[w]], want[w] / np.linalg.norm(want[w]), atol=1e-6)
        assert weights[slot[w]] == pytest.approx(qc.RARE / (qc.RARE + seen[w] / 9))


def test_held_out_accuracy_and_calibration(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = qc.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m["held_out"]]
    assert (m["predicted"] == m["quality"]).mean() > 0.9
    assert ((m["score"] - m["quality"]) ** 2).mean() < 0.08


def test_scores_do_not_see_labels_or_ids(spark):
    rows = [(i, f"text {i % 3} words and words", 1, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], LABELS)
    got = qc.classify(df, labels).toPandas()
    assert got.assign(k=got["doc_id"] % 3).groupby("k")["score"].nunique().max() == 1


def test_edge_tables(spark):
    df = spark.createDataFrame([(k, t, 0, 0.0) for k, t in enumerate(TEXTS)] + [(None, "a", 0, 0.0), (1, None, 0, 0.0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    got = qc.classify(df, none).collect()
    assert len(got) == len(TEXTS) + 2 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 1), (3, None)], LABELS)
    assert {r.score for r in qc.classify(df, one).collect()} == {1.0}
    assert qc.classify(df.limit(0), one).count() == 0


def test_temperature_sharpens_or_flattens():
    net = qc.Network()
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, qc.FEATURES))
    raw = net.logits(x)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-raw / 3))).astype(float)
    net._calibrate(x, y)
    assert 2 < net.temperature < 4.5
