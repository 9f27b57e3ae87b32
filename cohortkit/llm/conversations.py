"""Repair of conversation structure with a Hirschberg search.

The rows of a conversation, taken by turn, are edited at least cost until the
roles read ``(s?(ua)+)?`` by their initials: keep (0), rerole to user or
assistant (2), delete (3; blank and duplicate rows must go), insert an empty
user or assistant row (2); a truncated row that stays adds 1.  The initials of
the edits are the audit; of the cheapest ones the ASCII-least is taken.

The pattern has four states (nothing yet, after system, after user, after
assistant).  Hirschberg's divide and conquer: four forward costs from the left
end and four backward costs from the right end meet in the middle row, the
cheapest crossing state is chosen, and both halves are solved alone, in space
that grows with the rows only.  Beside each forward cost stands the place of
its audit among the four in ASCII order.  Audits to a crossing end with a row's
own letter, so that none is the start of another, and the least of the optimal
crossings is the one whose forward audit comes first.

A long conversation is spread over tasks the same way.  Rows are
range-partitioned by conversation, turn and row, and cut into segments of at
most ``ROWS`` rows and ``BYTES`` of text.  A segment's table gives for each state at its left
end the four forward costs and places at its right end; tables of ``FAN``
neighbours combine to one until a conversation has one, the crossing states are
chosen downwards from there, and each segment is solved between its two.  Only
the digest of a conversation reads its segments in turn, in constant memory.

Defined cases: a null text or role is one space; a null conversation id is one
conversation; null turns come first; rows of one turn are taken in order of a
digest of role and text, equal ones follow each other; a role whose initial is
not s, u or a can't be kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cohortkit.llm.common import SPACES, shuffle_parts, stage, stage_path

ROWS = 4096
BYTES = 4 << 20
FAN = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NONE = 1 << 60

# A row's class: its fault plus four times its kind.
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)
KINDS = {"s": 1, "u": 2, "a": 3}
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a row of kind k leads to state k.
COMES_AFTER = {1: {0}, 2: {0, 1, 3}, 3: {2}}
ANSWER = (2, 2, 3, 2)           # the state that user or assistant, whichever may follow, leads to
ROLE = {2: "user", 3: "assistant"}
LAST_INSERTS = (0, 2, 1, 0)     # rows missing to the pattern's end

Table = list  # table[p][q] = (cost, place among the audits from p)


def _letters(row_class: int) -> list[list[tuple[int, str] | None]]:
    """Cheapest cost and audit of one row, insertions before it included, from state p to state q."""
    fault, kind = row_class % 4, row_class // 4
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        state, cost, audit = p, 0, ""
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if fault < BLANK:
                more = TRUNCATED if fault == CUT_OFF else 0
                ways.append((ANSWER[state], REROLE + more, "R"))
                if kind and state in COMES_AFTER[kind]:
                    ways.append((kind, KEEP + more, "K"))
            for q, c, letter in ways:
                out[p][q] = min(out[p][q] or (NONE, ""), (cost + c, audit + letter))
            state, cost, audit = ANSWER[state], cost + INSERT, audit + "I"
    return out


LETTERS = [_letters(c) for c in range(16)]


def _placed(letters: list) -> Table:
    def place(line):
        order = sorted(w[1] for w in line if w)
        return [(w[0], order.index(w[1])) if w else (NONE, 0) for w in line]
    return [place(line) for line in letters]


TABLES = [_placed(x) for x in LETTERS]


def start_at(p: int) -> list[tuple[int, int]]:
    return [(0, 0) if q == p else (NONE, 0) for q in range(4)]


def forward(vector: list[tuple[int, int]], table: Table) -> list[tuple[int, int]]:
    """Costs and audit places behind one more row (or block of rows)."""
    best = []
    for q in range(4):
        ways = [(vector[p][0] + table[p][q][0], vector[p][1], table[p][q][1]) for p in range(4)
                if vector[p][0] < NONE and table[p][q][0] < NONE]
        best.append(min(ways) if ways else None)
    order = sorted(w[1:] for w in best if w)
    return [(w[0], order.index(w[1:])) if w else (NONE, 0) for w in best]


def backward(costs: list[int], table: Table) -> list[int]:
    """Least costs from in front of one more row (or block) to the end."""
    return [min(table[p][q][0] + costs[q] for q in range(4)) for p in range(4)]


def combined(tables: list[Table]) -> Table:
    out = []
    for p in range(4):
        vector = start_at(p)
        for t in tables:
            vector = forward(vector, t)
        out.append(vector)
    return out


def last_state(vector: list[tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) at the end of all rows, with the insertions that are then missing."""
    cost, _, q = min((vector[q][0] + INSERT * LAST_INSERTS[q], vector[q][1], q) for q in range(4))
    return cost, q


def crossings(tables: list[Table], p: int, q: int) -> list[int]:
    """States in front of each block and behind the last one on the audit-least cheapest way from p to q."""
    out = [p] + [0] * (len(tables) - 1) + [q]
    todo = [(0, len(tables))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left = start_at(out[lo])
        for t in tables[lo:mid]:
            left = forward(left, t)
        right = [0 if s == out[hi] else NONE for s in range(4)]
        for t in reversed(tables[mid:hi]):
            right = backward(right, t)
        out[mid] = min((left[s][0] + right[s], left[s][1], s) for s in range(4))[2]
        todo += [(lo, mid), (mid, hi)]
    return out


def _between(classes: bytes, p: int, q: int) -> str:
    states = crossings([TABLES[c] for c in classes], p, q)
    return "".join(LETTERS[c][a][b][1] for c, a, b in zip(classes, states, states[1:]))


_between_short = lru_cache(1 << 15)(_between)


def between(classes: bytes, p: int, q: int) -> str:
    """Audit of a block of rows between two crossing states."""
    return (_between_short if len(classes) <= 64 else _between)(classes, p, q)


@lru_cache(1 << 15)
def _ends(classes: bytes) -> tuple[int, int]:
    vector = start_at(0)
    for c in classes:
        vector = forward(vector, TABLES[c])
    return last_state(vector)


def repair_classes(classes: bytes) -> tuple[int, str]:
    """Cost and audit of one whole conversation."""
    cost, q = _ends(classes)
    return cost, between(classes, 0, q) + "I" * LAST_INSERTS[q]


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts behind the edits, from a state on."""
    out_roles, out_texts, at = [], [], 0
    for letter in audit:
        if letter == "K":
            state = KINDS[roles[at][0]]
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        elif letter in "RI":
            state = ANSWER[state]
            out_roles.append(ROLE[state])
            out_texts.append(texts[at] if letter == "R" else "")
        at += letter != "I"
    return out_roles, out_texts


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv:turn`` modulo 20 (fixed kinds 0 to 4); a null is one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col))) % 20
    text, role = part(text_col), part(role_col)
    hurt = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("__n"))
    return hurt.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__n")


SEGMENT = ("part int, k int, edge boolean, name string, classes binary, first_key string, last_key string, "
           "first_turn long, last_turn long, n_turns long, turns array<long>, roles array<string>, texts array<string>")


def _conv_name(c: str) -> Column:
    """A conversation id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col(c).cast("string")), F.lit("null"))


def _classified(rows: DataFrame) -> DataFrame:
    """name, turn, role, text, key, class of every row; equal rows of one turn still share a class."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = rows.select(_conv_name("conv_id").alias("name"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"),
                    part("text").alias("text"))
    r = r.withColumn("key", F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    first = r.groupBy(F.col("name").alias("__name"), F.col("key").alias("__key")).agg(F.min(when).alias("__first"))
    r = r.join(first, (r["name"] == first["__name"]) & (r["key"] == first["__key"])).drop("__name", "__key")
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = (F.when(end == "", F.lit(BLANK)).when(when > F.col("__first"), F.lit(DUPLICATE))
             .when(~end.isin(".", "!", "?"), F.lit(CUT_OFF)).otherwise(F.lit(FINE)))
    kind = F.left("role", F.lit(1))
    for initial, n in KINDS.items():
        fault = fault + F.when(kind == initial, F.lit(4 * n)).otherwise(F.lit(0))
    return r.select("name", "turn", "key", "role", "text", fault.alias("class"))


def _repeat_class(c: int) -> int:
    """The class of a row that follows an equal one."""
    return c if c % 4 == BLANK else c - c % 4 + DUPLICATE


def _segments(rows_max: int, bytes_max: int):
    """Sorted rows of a partition -> segments of one conversation; only a conversation inside the partition is no edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size, done = TaskContext.get().partitionId(), 0, [], 0, []
        schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("edge", pa.bool_()), ("name", pa.string()), ("classes", pa.binary()),
                            ("first_key", pa.string()), ("last_key", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                            ("n_turns", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                            ("texts", pa.list_(pa.string()))])
        last, state = None, {"first": True, "long": False}

        def close(end: bool) -> None:
            """The held rows become a segment; ``end``: the conversation ends here and the next one begins in this partition."""
            nonlocal k, held, size
            edge = state["first"] or state["long"] or not end
            turns = [h[0] for h in held]
            done.append((part, k, edge, last[0], bytes(h[4] for h in held), f"{turns[0]}:{held[0][1]}", f"{turns[-1]}:{held[-1][1]}",
                         next((t for t in turns if t is not None), None), turns[-1], len(set(turns) - {None}), turns,
                         [h[2] for h in held], [h[3] for h in held]))
            k, held, size = k + 1, [], 0

        def out() -> pa.RecordBatch:
            nonlocal done
            rows, done = done, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("name", "turn", "key", "role", "text", "class"))):
                this = (name, row[0], row[1])
                if last is not None and last[0] != name:
                    if held:
                        close(True)
                    state.update(first=False, long=False)
                elif last == this:
                    row[4] = _repeat_class(row[4])
                last = this
                held.append(row)
                size += len(row[3])
                if len(held) >= rows_max or size >= bytes_max:
                    state["long"] = True
                    close(False)
            if len(done) >= 256 or sum(len(d[4]) for d in done) >= rows_max:
                yield out()
        if held:
            close(False)
        if done:
            yield out()
    return run


def _facts(name, classes: bytes, turns: list) -> tuple:
    """blank, duplicate, truncated and illegal counts inside a block of rows."""
    a = np.frombuffer(classes, np.uint8)
    n = np.bincount(a % 4, minlength=4)
    kind = a // 4
    legal = {(1, 2), (2, 3), (3, 2)}
    pairs = np.bincount(kind[:-1] * 4 + kind[1:], minlength=16)
    illegal = int(pairs.sum()) - sum(int(pairs[4 * x + y]) for x, y in legal)
    return int(n[BLANK]), int(n[DUPLICATE]), int(n[CUT_OFF]), illegal


DONE = ("name string, ord long, audit string, cost long, blank long, duplicate long, truncated long, illegal long, "
        "lo long, hi long, n_turns long, roles array<string>, texts array<string>")
_DONE = pa.schema([("name", pa.string()), ("ord", pa.int64()), ("audit", pa.string()), *((c, pa.int64()) for c in (
    "cost", "blank", "duplicate", "truncated", "illegal", "lo", "hi", "n_turns")), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments -> edits and repaired rows; ``p`` and ``q`` are null for a whole conversation."""
    for batch in batches:
        rows = []
        for s in batch.to_pylist():
            classes, prev = s["classes"], s["prev"]
            if s["again"]:
                classes = bytes([_repeat_class(classes[0])]) + classes[1:]
            p, q = s["p"] or 0, s["q"]
            if q is None:
                cost, audit = repair_classes(classes)
            else:
                cost, audit = None, between(classes, p, q) + "I" * (LAST_INSERTS[q] if s["last"] else 0)
            roles, texts = applied(audit, p, s["roles"], s["texts"])
            blank, duplicate, truncated, illegal = _facts(s["name"], classes, s["turns"])
            if prev is not None:
                illegal += _facts(None, bytes([prev, classes[0]]), [])[3]
            if cost is None:
                stay = sum(letter != "D" and classes[at] % 4 == CUT_OFF for at, letter in enumerate(audit.replace("I", "")))
                cost = sum(map({"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}.get, audit)) + TRUNCATED * stay
            rows.append((s["name"], s["ord"], audit, cost, blank, duplicate, truncated, illegal, s["first_turn"], s["last_turn"],
                         s["n_turns"] - bool(s["same_turn"]), roles, texts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DONE)], schema=_DONE)


def _pack(table: Table) -> bytes:
    return np.array(table, np.int64).tobytes()


def _unpack(data: bytes) -> Table:
    return [[tuple(c) for c in line] for line in np.frombuffer(data, np.int64).reshape(4, 4, 2).tolist()]


def _leaf_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for classes, again in zip(batch.column("classes").to_pylist(), batch.column("again").to_pylist()):
            if again:
                classes = bytes([_repeat_class(classes[0])]) + classes[1:]
            out.append(_pack(combined([TABLES[c] for c in classes])))
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("ord"), pa.array(out, pa.binary())], names=["name", "ord", "t"])


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("ord")
    return pd.DataFrame([(group["name"].iloc[0], group["block"].iloc[0], _pack(combined([_unpack(t) for t in group["t"]])))],
                        columns=["name", "ord", "t"])


def _crossed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("ord")
    states = crossings([_unpack(t) for t in group["t"]], int(group["bp"].iloc[0]), int(group["bq"].iloc[0]))
    return pd.DataFrame({"name": group["name"], "ord": group["ord"], "p": states[:-1], "q": states[1:]})


@F.pandas_udf(IntegerType())
def _top_state(t: pd.Series) -> pd.Series:
    return pd.Series([last_state(_unpack(x)[0])[1] for x in t], dtype="int32")


def _boundary_states(edges: DataFrame, fan: int) -> DataFrame:
    """name, ord, p, q of each segment: tables combined upwards, crossing states chosen downwards."""
    node = "name string, ord long, t binary"
    levels = [stage(edges.select("name", "ord", "classes", "again").mapInArrow(_leaf_tables, node), "tables")]
    block = F.expr(f"(ord - 1) div {fan} + 1")
    while (levels[-1].agg(F.max("ord")).first()[0] or 1) > 1:
        levels.append(stage(levels[-1].withColumn("block", block).groupBy("name", "block").applyInPandas(_joined, node), "tables"))
    states = levels[-1].select("name", "ord", F.lit(0).alias("p"), _top_state("t").alias("q"))
    for level in reversed(levels[:-1]):
        up = states.select(F.col("name").alias("__name"), F.col("ord").alias("__ord"), F.col("p").alias("bp"), F.col("q").alias("bq"))
        x = level.withColumn("block", block)
        x = x.join(up, (x["name"] == up["__name"]) & (x["block"] == up["__ord"])).select("name", "ord", "block", "t", "bp", "bq")
        states = stage(x.groupBy("name", "block").applyInPandas(_crossed, "name string, ord long, p int, q int"), "states")
    return states


def repair(rows: DataFrame, rows_max: int = ROWS, bytes_max: int = BYTES, fan: int = FAN) -> DataFrame:
    """Repaired segments of each conversation of ``rows`` (conv_id, turn, role, text), in order of ``ord``.

    Columns: name (of the conversation), ord, audit, cost, blank, duplicate,
    truncated, illegal, lo, hi and n_turns (turns as given), roles and texts
    (the repaired rows).  Conversations inside one segment have one.
    """
    spark = rows.sparkSession
    r = _classified(rows).withColumn("__tie", F.monotonically_increasing_id())
    order = [F.col("name"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("__tie")]
    cut = (r.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
           .select("name", "turn", "key", "role", "text", "class").mapInArrow(_segments(rows_max, bytes_max), SEGMENT))
    path = stage_path(spark, "segments")
    cut.write.partitionBy("edge").parquet(path)
    segments = spark.read.schema(SEGMENT).parquet(path)
    body = ["name", "classes", "first_turn", "last_turn", "n_turns", "turns", "roles", "texts"]
    whole = segments.filter("not edge").select(
        *body, F.lit(1).cast("long").alias("ord"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("q"),
        F.lit(False).alias("again"), F.lit(False).alias("same_turn"), F.lit(None).cast("int").alias("prev"), F.lit(True).alias("last"))
    # segments of conversations that may go on in the next partition, without their texts
    in_turn = Window.partitionBy("name").orderBy("part", "k")
    edges = stage(segments.filter("edge").select(
        "part", "k", "name", "classes", F.row_number().over(in_turn).cast("long").alias("ord"),
        F.coalesce(F.lag("last_key").over(in_turn) == F.col("first_key"), F.lit(False)).alias("again"),
        F.coalesce(F.lag("last_turn").over(in_turn) == F.col("first_turn"), F.lit(False)).alias("same_turn"),
        F.lag(F.conv(F.hex(F.expr("substring(classes, -1, 1)")), 16, 10).cast("int")).over(in_turn).alias("prev"),
        F.lead("k").over(in_turn).isNull().alias("last")), "edges")
    states = _boundary_states(edges, fan)
    known = (edges.drop("classes").join(states.select(F.col("name").alias("__name"), F.col("ord").alias("__ord"), "p", "q"),
                                        (F.col("name") == F.col("__name")) & (F.col("ord") == F.col("__ord")))
             .select(F.col("part").alias("__part"), F.col("k").alias("__k"), "ord", "p", "q", "again", "same_turn", "prev", "last"))
    long = segments.filter("edge")
    long = long.join(known, (long["part"] == known["__part"]) & (long["k"] == known["__k"])).select(*whole.columns)
    return stage(whole.unionByName(long).mapInArrow(_solve, DONE), "repaired")


def repaired_rows(segments: DataFrame) -> DataFrame:
    """name, ord, pos, role, text: the repaired conversations row by row, by (ord, pos)."""
    return segments.select("name", "ord", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r")).select(
        "name", "ord", "pos", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DIGEST = "name string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (name, ord) -> one row per conversation; a hash state is all that is held of a text."""
    schema = pa.schema([("name", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    name, done = None, []

    def close() -> None:
        gaps = hi - lo + 1 - turns if lo is not None else 0
        done.append((name, gaps, *counts, cost, "".join(audit), sha.hexdigest()))

    for batch in batches:
        for s in batch.to_pylist():
            if s["name"] != name:
                if name is not None:
                    close()
                name, lo, hi, turns, counts, cost, audit, sha, some = s["name"], None, None, 0, [0] * 4, 0, [], hashlib.sha256(), False
            lo, hi = s["lo"] if lo is None else lo, s["hi"] if s["hi"] is not None else hi
            turns, cost = turns + s["n_turns"], cost + s["cost"]
            counts = [a + s[c] for a, c in zip(counts, COUNTS[1:5])]
            audit.append(s["audit"])
            for role, text in zip(s["roles"], s["texts"]):
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if name is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def digest(segments: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each id of ``conversations``: its counts, cost, audit and the hash of its repaired rows."""
    d = segments.repartition("name").sortWithinPartitions("name", "ord").mapInArrow(_digest, DIGEST)
    ids = conversations.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("__name", _conv_name("conv_id"))
    return ids.join(d, ids["__name"] == d["name"], "left").select(
        F.col("conv_id").alias(conv_col), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
