import random

import pytest

from cohortkit.llm import quality_rules as qr

DOCS = "doc_id long, text string, source string, kept string, n_words string"


def brute(text):
    """The contract's counts, by plain loops."""
    t = text or ""
    white = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in t + " ":
        if c in white:
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines = [x for x in t.split("\n") if any(c not in white for c in x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "a b a b a b", "x\ny\nx\n\n x\nx", "#*$%&|<> é", "one\x0btwo\x0cthree\rfour",
         "the end " * 4000, "\u00a0no break", "l1 a b\nl2\nl1 a b", "z" * 50_000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS)


def test_counts_match_brute_force(spark):
    rnd = random.Random(3)
    texts = TEXTS + [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    got = qr.judge(frame(spark, [(i, t, "s%d" % (i % 3)) for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def clean(rnd, n=80):
    return " ".join("w%d" % rnd.randrange(10_000) for _ in range(n))


def test_host_verdict_is_strict_only_in_bad_hosts(spark):
    rnd = random.Random(4)
    mild = lambda: clean(rnd) + " " + "# " * 15  # noqa: E731  over 3 and under 10 symbols per 100 characters
    rows = [(i, mild() if i % 10 < 8 else clean(rnd), "bad") for i in range(60)]
    rows += [(100 + i, mild() if i == 0 else clean(rnd), "good%d" % (i % 6)) for i in range(240)]
    rows += [(900 + i, mild() if i == 1 else clean(rnd), None) for i in range(30)]
    got = {r.doc_id: r.kept for r in qr.judge(frame(spark, rows)).collect()}
    for i, t, s in rows:
        assert got[i] == (not (s == "bad" and "#" in t)), (i, s)


def test_one_host_and_repeated_rows(spark):
    rnd = random.Random(5)
    df = frame(spark, [(1, clean(rnd), "s"), (2, "short", "s")])
    df = df.unionAll(df.filter("doc_id = 1"))
    assert sorted((r.doc_id, r.kept) for r in qr.judge(df).collect()) == [(1, True), (1, True), (2, False)]
    kept = qr.keep_good(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes and [r.doc_id for r in kept.collect()] == [1, 1]
    assert qr.judge(df.limit(0)).count() == 0 and qr.keep_good(df.limit(0)).count() == 0


def test_null_id(spark):
    df = frame(spark, [(None, "short", "s"), (3, clean(random.Random(1)), None)])
    assert [r.doc_id for r in qr.keep_good(df).collect()] == [3]


def test_no_python_in_the_plan(spark):
    plan = qr.judge(frame(spark, [(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("salts", [1, 64])
def test_salts_change_nothing(spark, monkeypatch, salts):
    monkeypatch.setattr(qr, "HOST_SALTS", salts)
    rows = frame(spark, [(i, "# " * 60, "s") for i in range(5)])
    assert {r.kept for r in qr.judge(rows).collect()} == {False}


def test_each_row_goes_by_its_own_verdict(spark):
    rnd = random.Random(8)
    good = [clean(rnd) for _ in range(4)]
    df = frame(spark, [(None, "short", "s"), (None, good[0], "s"), (None, good[1], None), (3, good[2], "s"), (3, "", "s"),
                       (3, good[3], "s")])
    assert sorted(r.text for r in qr.keep_good(df).collect()) == sorted(good)
