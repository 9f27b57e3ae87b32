import hashlib
import random
import re

import numpy as np
import pytest

from cohortkit.llm import reference_dedup as rd

DOCS = "doc_id long, text string, key string, spans string, own int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """(doc_id, n_words, n_removed, sha) of every row, from the first document of every 50-word window."""
    place = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - rd.SPAN + 1):
            g = tuple(w[i:i + rd.SPAN])
            first[g] = min(first.get(g, place(doc)), place(doc))
    return judged(rows, lambda doc, g: first[g] < place(doc))


def judged(rows, gone):
    out = []
    for doc, text in rows:
        w = words(text)
        cut = {i + o for i in range(len(w) - rd.SPAN + 1) if gone(doc, tuple(w[i:i + rd.SPAN])) for o in range(rd.SPAN)}
        kept = [x for i, x in enumerate(w) if i not in cut]
        out.append((doc, len(w), len(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def case():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short = text(90).split(), text(30)
    rows = [text(rnd.randint(30, 200)) for _ in range(30)]
    for i in range(0, 41, 2):  # a passage of many documents, cut at every second length
        rows.append(f"{text(3)} {' '.join(passage[i:])}\n{text(3)}")
        rows.append(f"{text(2)}\t{' '.join(passage[:len(passage) - i])} {text(60)}")
    for _ in range(25):  # fewer words than a window in common: nothing to remove
        rows.append(f"{text(40)} {short} {text(40)}")
    rows += [rows[3]] * 4 + [rows[5][7:-9], f"{rows[6]} {rows[7]}", rows[6].upper(), text(3000)]
    rows += ["a " * 300, "a " * 49, "a " * 50, "a b " * 200, "x " + "a b " * 130, "a\x0bb\x0c" * 60, "é " * 120, "b" * 20000]
    rows += [None, "", " ", "\n\t"]
    numbered = [(3 * i % 251, t) for i, t in enumerate(rows)] + [(3, rows[1]), (3, rows[1]), (3, rows[2]), (None, rows[0]), (None, None), (None, rows[4])]
    rnd.shuffle(numbered)
    return numbered


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).repartition(5)


def result(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot", [rd.HOT, 3, 0])
def test_equals_brute_force(spark, hot):
    """``hot`` 0 sends every passage through the window by window way."""
    rows = case()
    want = brute(rows)
    assert result(rd.remove_passages(frame(spark, rows), hot=hot)) == want
    assert sum(r[2] > 0 for r in want) > 30


def test_no_rows(spark):
    assert result(rd.remove_passages(frame(spark, []))) == []


@pytest.mark.parametrize("shard_words", [rd.SHARD_WORDS, 120])
def test_known_passages_of_a_reference(spark, shard_words):
    """A small shard size broadcasts several automata, and cuts long texts with an overlap."""
    rows = case()
    reference = [t for i, t in rows[::7]]
    have = {tuple(w[i:i + rd.SPAN]) for t in reference for w in [words(t)] for i in range(len(w) - rd.SPAN + 1)}
    ref = spark.createDataFrame([(t,) for t in reference], "text string").repartition(2)
    assert result(rd.remove_known(frame(spark, rows), ref, shard_words=shard_words)) == judged(rows, lambda doc, g: g in have)


def test_automaton_names_first_owners():
    rnd = random.Random(2)
    for _ in range(200):
        texts = [[rnd.randint(0, 2) for _ in range(rnd.randint(0, 30))] for _ in range(rnd.randint(1, 5))]
        automaton = rd.SuffixAutomaton()
        owners = [rnd.randint(0, 9) for _ in texts]
        for t, o in zip(texts, owners):
            automaton.add(t, o)
        automaton.settle()
        for span in (1, 4, 7):
            probe = [rnd.randint(0, 3) for _ in range(25)]
            want = [min((o for t, o in zip(texts, owners) if any(t[j:j + span] == probe[i:i + span] for j in range(len(t) - span + 1))),
                        default=rd.NOBODY) for i in range(len(probe) - span + 1)]
            assert automaton.first_owners(probe, span) == want


def test_equal_windows_have_one_anchor():
    """Whatever surrounds a window, its passage names the same anchor hash."""
    rnd = np.random.default_rng(5)
    middle = rnd.integers(1, 1 << 63, 130, dtype=np.uint64)
    keys = []
    for n in (0, 7, 60, 200):
        h = np.concatenate([rnd.integers(1, 1 << 63, n, dtype=np.uint64), middle, rnd.integers(1, 1 << 63, n, dtype=np.uint64)])
        doc, key, first, last = rd.anchors(h, np.array([len(h)]))
        of = {int(p): int(k) for k, a, b in zip(key, first, last) for p in range(a, b + 1)}
        keys.append([of[n + i] for i in range(130 - rd.SPAN + 1)])
    assert all(k == keys[0] for k in keys)
