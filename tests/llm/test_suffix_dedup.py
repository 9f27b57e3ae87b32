import hashlib
import random

import numpy as np
import pytest

from cohortkit.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, key string, spans string"


def brute(rows):
    """doc_id -> (bytes, removed, spans, sha) from the first place of every 100-byte string."""
    first = {}
    rows = sorted(rows)
    for doc, text in rows:
        d = (text or "").encode()
        for i in range(len(d) - sd.SPAN + 1):
            first.setdefault(d[i:i + sd.SPAN], (doc, i))
    out = {}
    for doc, text in rows:
        d = (text or "").encode()
        spans = sd.merged((i, i + sd.SPAN) for i in range(len(d) - sd.SPAN + 1) if first[d[i:i + sd.SPAN]] != (doc, i))
        kept = sd.keep_bytes(d, spans)
        out[doc] = (len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def case():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), text(18)
    rows = [text(rnd.randint(5, 120)) for _ in range(30)]
    for i in range(40):  # a passage of many documents, cut at every length
        rows.append(f"{text(3)} {passage[i:]} {text(3)}")
        rows.append(f"{text(2)} {passage[:len(passage) - i]}x{text(2)}")
    rows += [rows[3]] * 4 + [rows[5][7:-9], rows[6] + rows[7]]
    rows += [f"{line}\n{text(8)}\n{line}\n{line}", "a" * 500, "a" * 99, "a" * 100, "ab" * 300, "x" + "ab" * 200, "é" * 120]
    rows += [None, "", " ", text(2000), "b" * 20000]
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    got = sd.remove_repeats(df, **kw).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    return df


@pytest.mark.parametrize("kw", [{}, {"hot": 1}, {"broadcast_keys": 0, "hot": 5}])
def test_matches_brute_force(spark, kw):
    check(spark, case(), **kw)


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "q" * 150, "", ""), (4, "q" * 150, "", ""), (4, "q" * 150, "", "")], DOCS)
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [(0, 150), (4, 149), (4, 149)]  # byte 0 of the first text is in no repeat
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_multikey_order():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(0, 2, size=(300, 21)).astype(np.uint8)
    rows[5] = rows[9]
    order, common = sd.multikey_order(rows)
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)
    for k in range(1, len(order)):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert common[k] == (21 if (a == b).all() else int((a != b).argmax()))


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(1)
    piece = "".join(rnd.choice("abc ") for _ in range(150))
    found = []
    for lead in ("", "zzz", "qwertz" * 20):
        doc, place, _, first, last = sd.anchors([b"short", lead.encode() * 3, (lead + piece + lead).encode(), b"x" * 120])
        of = {s: p for d, p, a, b in zip(doc, place, first, last) for s in range(a, b + 1) if d == 2}
        assert sorted(of) == list(range(len(lead + piece + lead) - 99))
        found.append([of[len(lead) + i] - len(lead) - i for i in range(51)])
    assert found[0] == found[1] == found[2]
