import hashlib
import itertools
import random
import re
import zlib

import pytest

from cohortkit.llm import conversations as cv

ROWS = "conv_id long, turn long, role string, text string"
WHITE = "[\x20\x09-\x0d]*"


def faults(rows):
    """Rows of one conversation in order -> (kind initial, fault) each."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(WHITE + r"\Z", "", text)
        f = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], f))
    return out


def full_table(found):
    """Least (cost, audit, edits) over all edits by the full dynamic program that carries every audit."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {0: (0, "", ())}

    def relax(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserts(ways):
        for _ in range(3):
            for state, (cost, audit, edits) in list(ways.items()):
                for r in "ua":
                    if (r, state) in step:
                        relax(ways, step[r, state], (cost + 2, audit + "I", edits + (("I", r),)))
        return ways

    for at, (kind, fault) in enumerate(found):
        after = {}
        for state, (cost, audit, edits) in inserts(dict(best)).items():
            relax(after, state, (cost + 3, audit + "D", edits + (("D", at),)))
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                if (kind, state) in step:
                    relax(after, step[kind, state], (cost + t, audit + "K", edits + (("K", at),)))
                for r in "ua":
                    if (r, state) in step:
                        relax(after, step[r, state], (cost + 2 + t, audit + "R", edits + (("R", at, r),)))
        best = after
    ends = inserts(best)
    return min((ends[q] for q in (0, 3) if q in ends), key=lambda w: w[:2])


def brute(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).hexdigest())
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own]
        own = sorted(own, key=key)
        turns = [r[1] for r in own if r[1] is not None]
        found = faults([r[2:] for r in own])
        cost, audit, edits = full_table(found)
        name = {"u": "user", "a": "assistant"}
        body = [f"{own[e[1]][2]}:{own[e[1]][3]}" if e[0] == "K" else f"{name[e[2]]}:{own[e[1]][3]}" if e[0] == "R" else f"{name[e[1]]}:"
                for e in edits if e[0] != "D"]
        kinds = "".join(k if k in "sua" and k else "x" for k, _ in found)
        illegal = sum(kinds[i:i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == w for _, f in found) for w in (
            "blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def some(seed, convs, length):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Well?", "and then", "", " \t", "é.", "Long " * 30 + "end.", "x.\n\x0b", " ", "a. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Sys", "u", " "]
    out = []
    for c in range(convs):
        for t in range(rnd.randint(1, length)):
            role = rnd.choice(roles[:2 + rnd.choice((0, 1, 3, 8))])
            out.append((c, t + 3 * (rnd.random() < .1), role, rnd.choice(texts) if rnd.random() < .5 else f"{rnd.random()}."))
    return out


def odd():
    return [(None, None, None, None), (None, 1, "user", "a."), (900, None, "user", "q."), (900, None, "user", "q."), (900, 5, "assistant", "r."),
            (901, None, "system", None), (902, 1, "user", "x" * 100_000 + "."), (902, 2, "assistant", "ok."), (903, -4, "user", "a."),
            (903, 9, "assistant", "b."), (903, 9, "assistant", "b."), (903, 9, "user", "c"), (904, 1, "", ""), (905, 0, "system", "s.")]


def test_search_equals_the_full_table():
    """Every short run of classes, and long random ones: cost and ASCII-least audit."""
    named = {c: ((" sua")[c // 4], ("", "truncated", "blank", "duplicate")[c % 4]) for c in range(16)}
    use = [0, 4, 6, 8, 9, 11, 12, 13]
    for n in range(5):
        for classes in itertools.product(use, repeat=n):
            assert cv.repair_classes(bytes(classes)) == full_table([named[c] for c in classes])[:2], classes
    rnd = random.Random(3)
    for _ in range(400):
        classes = bytes(rnd.choice(range(16)) for _ in range(rnd.randint(5, 90)))
        assert cv.repair_classes(classes) == full_table([named[c] for c in classes])[:2]


def test_crossings_between_blocks_equal_those_between_rows():
    rnd = random.Random(4)
    for _ in range(100):
        blocks = [bytes(rnd.choice((4, 8, 9, 12, 13, 0, 10)) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 9))]
        tables = [cv.combined([cv.TABLES[c] for c in b]) for b in blocks]
        cost, q = cv.last_state(cv.combined(tables)[0])
        states = cv.crossings(tables, 0, q)
        audit = "".join(cv.between(b, x, y) for b, x, y in zip(blocks, states, states[1:])) + "I" * cv.LAST_INSERTS[q]
        assert (cost, audit) == cv.repair_classes(b"".join(blocks))


@pytest.mark.parametrize("rows_max,fan", [(cv.ROWS, cv.FAN), (3, 2)])
def test_equals_brute_force(spark, rows_max, fan):
    """With tiny segments long conversations cross many of them and several levels of tables."""
    rows = some(1, 60, 12) + [(300, t, "user" if t % 2 else "assistant", f"{t // 4}.") for t in range(70)] + odd()
    rows += [(301, 7, "user", "same.")] * 40
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS name", "2 AS key", "'x' AS class", "3 AS part", "0 AS __n").repartition(6)
    broken = hurt(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: empty for c in {r[0] for r in rows}} | brute(broken)
    assert result(cv.digest(cv.repair(cv.damage(df), rows_max=rows_max, fan=fan), df)) == want
    assert result(cv.digest(cv.repair(df, rows_max=rows_max, fan=fan), df)) == brute(rows)


def test_repaired_rows_follow_the_pattern(spark):
    df = spark.createDataFrame(some(9, 40, 15), ROWS)
    got = {}
    for r in cv.repaired_rows(cv.repair(df, rows_max=4, fan=2)).orderBy("name", "ord", "pos").collect():
        got.setdefault(r.name, []).append(r.role[:1])
    assert len(got) > 20
    for roles in got.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def test_no_rows(spark):
    df = spark.createDataFrame([], ROWS)
    assert result(cv.digest(cv.repair(cv.damage(df)), df)) == {}
