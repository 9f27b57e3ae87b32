"""Exact substring dedup with a sampled, range-partitioned suffix array.

Every ``SPAN``-byte string that also starts earlier is removed.  Sorting the
suffixes of all bytes would ship the corpus many times over, so suffixes are
sampled by content: in every window of SPAN bytes the place of its smallest
``SEED``-byte hash (the leftmost one) is its anchor.  Equal windows have their
anchors at the same place, so all copies of a string meet at one anchor, and
consecutive windows with one anchor travel as one context of at most
2 * SPAN - SEED bytes.

1. Texts equal to an earlier text are removed whole.
2. Anchors whose leading SEED bytes occur in one text only, and once, are dropped.
3. Equal contexts are one: all but the earliest are repeats throughout.
4. The distinct contexts are range-partitioned by sampled splitters over the
   anchor's leading bytes, each bucket is sorted by multikey sort to the right
   and to the left of the anchor, and neighbours' common lengths tell for each
   window which earlier context has it.  Leading bytes never straddle a
   splitter; those shared by over ``HOT`` contexts would fill a bucket, and
   their windows are compared one by one across all buckets instead (a
   map-side combined minimum, joined back).
5. Removed runs are merged per document.

Hashes choose anchors and name equal texts and contexts (128 bits); windows of
a bucket are compared by their bytes.

Defined cases: a null or empty text has no bytes; texts under SPAN bytes stay
whole; rows with one id and the same text are one document and get one
result, with different texts they are ordered by a hash of the text; a null
id comes last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import shuffle_parts, stage

SPAN = 100
SEED = 32
HOT = 2000             # contexts with the same leading bytes that one bucket takes at most
BUCKET = 20_000        # contexts per bucket, about
SAMPLE_PER_BUCKET = 30
BROADCAST_KEYS = 1 << 22   # leading-byte hashes (8 bytes each) that may be broadcast; else they are joined
BROADCAST_IDS = 1 << 20
MAX_ID = (1 << 63) - 1

CHUNK = 1 << 16        # bytes of text worked on at once; a longer text is a chunk of its own
_SPREAD, _HIGH, _LOW = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF << 32), np.uint64(0xFFFFFFFF)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64)


def _powers() -> list[tuple[int, np.uint64]]:
    out, m, p = [], 1, 0x9E3779B97F4A7C15
    while m < SEED:
        out.append((m, np.uint64(p)))
        m, p = 2 * m, p * p % (1 << 64)
    return out


_POWERS = _powers()


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, anchor's place, its hash, first and last start of its windows; in text order.

    All texts are worked on as one string; windows that reach over a text's end are left out.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(raw) < SPAN:
        return none, none, np.empty(0, np.uint64), none, none
    h = _BYTE[raw]
    for m, p in _POWERS:
        h = h[:-m] * p + h[m:]
    # hash above, place below: the least is the smallest hash, the leftmost one if several
    low = ((h * _SPREAD) & _HIGH) | np.arange(len(h), dtype=np.uint64)
    width, m = SPAN - SEED + 1, 1
    while m < width:
        k = min(m, width - m)
        low = np.minimum(low[:-k], low[k:])
        m += k
    at = (low & _LOW).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    # a run of windows is cut where a text ends; its windows end at that text's last one
    edges = np.unique(np.concatenate((begin, ends[ends < len(at)])))
    doc = np.searchsorted(ends, edges, side="right")
    last = np.minimum(np.concatenate((edges[1:], [len(at)])) - 1, ends[doc] - SPAN)
    use = last >= edges
    first, last, doc = edges[use], last[use], doc[use]
    place, start = at[first], (ends - [len(t) for t in texts])[doc]
    return doc, place - start, h[place], first - start, last - start


def _chunks(texts: list[str | None], tags: list[list]) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts of SPAN bytes and more, about CHUNK bytes at a time, with their entries of ``tags``."""
    held, keep, size = [], [[] for _ in tags], 0
    for k, t in enumerate(texts):
        data = t.encode() if t is not None and len(t) * 4 >= SPAN else b""
        if len(data) < SPAN:
            continue
        held.append(data)
        for x, tag in zip(keep, tags):
            x.append(tag[k])
        size += len(data)
        if size >= CHUNK:
            yield held, keep
            held, keep, size = [], [[] for _ in tags], 0
    if held:
        yield held, keep


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct anchor hashes of each text, and whether one repeats in it."""
    for batch in batches:
        out = []
        for data, (t1,) in _chunks(batch.column("text").to_pylist(), [batch.column("t1").to_pylist()]):
            doc, _, key, _, _ = anchors(data)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            n = np.diff(np.append(np.flatnonzero(new), len(new)))
            out.append((key[new], np.array(t1, np.int64)[doc[new]], (n > 1).astype(np.int8)))
        if out:
            key, tag, many = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tag), pa.array(many)],
                                             names=["key", "tag", "many"])


CONTEXT = "key long, c1 long, c2 long, ctx binary, lead int, id long, t1 long, place long, run int"


def _contexts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors whose hash is wanted (sorted array, or the row's own list)."""
    for batch in batches:
        cols = [[] for _ in range(9)]
        tags = [batch.column(c).to_pylist() for c in (["id", "t1"] if wanted is not None else ["id", "t1", "keys"])]
        for data, (ids, t1s, *lists) in _chunks(batch.column("text").to_pylist(), tags):
            doc, place, key, first, last = anchors(data)
            if wanted is None:
                own = [np.array(x, np.int64).view(np.uint64) for x in lists[0]]
                use = np.concatenate([np.isin(key[doc == k], x) for k, x in enumerate(own)])
            elif len(wanted):
                use = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            else:
                continue
            for k, p, h, a, b in zip(doc[use].tolist(), place[use].tolist(), key[use].view(np.int64).tolist(),
                                     first[use].tolist(), last[use].tolist()):
                ctx = data[k][a:b + SPAN]
                name = xxhash.xxh3_128_digest(ctx, seed=p - a)
                for c, v in zip(cols, (h, int.from_bytes(name[:8], "little", signed=True),
                                       int.from_bytes(name[8:], "little", signed=True), ctx, p - a, ids[k], t1s[k], p, b - a)):
                    c.append(v)
            if len(cols[0]) > 20_000:
                yield _context_batch(cols)
                cols = [[] for _ in range(9)]
        yield _context_batch(cols)


def _context_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=[x.split()[0] for x in CONTEXT.split(", ")])


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows, and the common length of each with the row before it.

    Multikey sort with eight bytes as one character: rows are sorted by a
    character, and only runs that are still equal go on to the next one.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(new)[at]
        char = words[order[at], k]
        by = np.lexsort((char, run))
        order[at] = order[at][by]
        char = char[by]
        inside = ~new[at]
        inside[1:] &= char[1:] == char[:-1]
        new[at] = ~inside
    sorted_ = rows[order]
    same = np.zeros((n, width + 1), bool)
    same[1:, :width] = sorted_[1:] == sorted_[:-1]
    return order, same.argmin(axis=1)


def resolve(ctx: list[bytes], lead: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest lead of the windows of each context that an earlier one has; -1 if none.

    Contexts come in document order and are aligned at their anchors.  A
    window with ``a`` bytes before the anchor agrees with another one if the
    contexts agree on SPAN - a bytes to the right and on a bytes to the left.
    """
    n = len(ctx)
    left = SPAN - SEED
    right_rows = np.frombuffer(b"".join(c[k:].ljust(SPAN, b"\0") for c, k in zip(ctx, lead)), np.uint8).reshape(n, SPAN)
    left_rows = np.frombuffer(b"".join(c[:k][::-1].ljust(left, b"\0") for c, k in zip(ctx, lead)), np.uint8).reshape(n, left)
    r_order, r_common = multikey_order(right_rows)
    l_order, l_common = multikey_order(left_rows)
    least, most = np.full(n, -1), np.full(n, -1)
    r_group, l_group = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(lead.max(initial=-1)) + 1):
        on = np.flatnonzero((lead - run <= a) & (a <= lead))
        if len(on) < 2:
            continue
        r_group[r_order] = np.cumsum(r_common < SPAN - a)
        l_group[l_order] = np.cumsum(l_common < a)
        _, first = np.unique(r_group[on] * (n + 1) + l_group[on], return_index=True)
        again = np.ones(len(on), bool)
        again[first] = False
        on = on[again]
        most[on] = a
        least[on[least[on] < 0]] = a
    return least, most


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the contexts of one bucket after another (rows sorted by bucket and document order)."""
    held: list[pa.RecordBatch] = []
    now = None

    def flush():
        t = pa.Table.from_batches(held)
        lead, run = (t.column(c).to_numpy().astype(np.int64) for c in ("lead", "run"))
        least, most = resolve(t.column("ctx").to_pylist(), lead, run)
        hit = np.flatnonzero(most >= 0)
        place = t.column("place").to_numpy()[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array(t.column(c).to_numpy()[hit]) for c in ("id", "t1")]
            + [pa.array(place - most[hit]), pa.array(place - least[hit] + SPAN)], names=["id", "t1", "lo", "hi"])

    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and bucket[a] != now:
                yield flush()
                held = []
            now = bucket[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of each context."""
    for batch in batches:
        cols = [[] for _ in range(6)]
        for ctx, lead, i, t1, place, run in zip(*(batch.column(c).to_pylist() for c in (
                "ctx", "lead", "id", "t1", "place", "run"))):
            for k in range(run + 1):
                name = xxhash.xxh3_128_digest(ctx[k:k + SPAN])
                for c, v in zip(cols, (int.from_bytes(name[:8], "little", signed=True),
                                       int.from_bytes(name[8:], "little", signed=True), i, t1, place, place - lead + k)):
                    c.append(v)
            if len(cols[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["w1", "w2", "id", "t1", "place", "start"])
                cols = [[] for _ in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["w1", "w2", "id", "t1", "place", "start"])


def _not_first(rows: DataFrame, name: list[str], order: list[str]) -> DataFrame:
    """Rows that aren't the first in ``order`` of those with the same name; the firsts are map-side combined."""
    first = stage(rows.groupBy(*[F.col(c).alias(f"__{c}") for c in name]).agg(F.min(F.struct(*order)).alias("__first")), "first")
    on = [rows[c] == first[f"__{c}"] for c in name]
    return rows.join(first, on).filter(F.struct(*order) != F.col("__first")).select(*rows.columns)


def _shared_keys(texts: DataFrame) -> DataFrame:
    """Anchor hashes that two different texts have, or one text twice."""
    rows = texts.mapInArrow(_keys, "key long, tag long, many byte")
    return stage(rows.groupBy("key").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.max("many").alias("m"))
                 .filter("a <> b or m > 0").select("key"), "keys")


def _context_rows(texts: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Contexts of the anchors with a shared hash; by a checked broadcast, or by joins beyond it."""
    if keys.count() <= limit:
        held = texts.sparkSession.sparkContext.broadcast(
            np.sort(np.array([r[0] for r in keys.toLocalIterator()], np.int64).view(np.uint64)))
        return texts.mapInArrow(lambda it: _contexts(it, held.value), CONTEXT)

    def named(batches):
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                t = text.as_py()
                key = np.unique(anchors([(t or "").encode()])[2]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array([batch.column("id")[k].as_py()] * len(key), pa.int64()),
                     pa.array([batch.column("t1")[k].as_py()] * len(key), pa.int64())], names=["key", "id", "t1"])

    of = stage(texts.mapInArrow(named, "key long, id long, t1 long"), "text-keys")
    k = keys.withColumnRenamed("key", "__k")
    lists = (of.join(k, of["key"] == k["__k"]).select("id", "t1", "key").distinct()
             .groupBy(F.col("id").alias("__id"), F.col("t1").alias("__t1")).agg(F.collect_list("key").alias("keys")))
    lists = stage(lists, "key-lists")  # per text at most as many as it has anchors
    rows = texts.join(lists, (texts["id"] == lists["__id"]) & (texts["t1"] == lists["__t1"])).select("id", "t1", "text", "keys")
    return rows.mapInArrow(lambda it: _contexts(it, None), CONTEXT)


def repeats(texts: DataFrame, broadcast_keys: int = BROADCAST_KEYS, hot: int = HOT) -> DataFrame:
    """(id, t1, lo, hi) byte ranges that are repeats, of texts (id, t1, text)."""
    spark = texts.sparkSession
    found = stage(_context_rows(texts, _shared_keys(texts), broadcast_keys), "anchors")
    order = ["id", "t1", "place"]
    distinct = stage(found.groupBy("c1", "c2").agg(
        F.min(F.struct(*order)).alias("f"), F.first("ctx").alias("ctx"), F.first("lead").alias("lead"),
        F.first("run").alias("run"), F.first("key").alias("key"))
        .select("c1", "c2", "f.*", "ctx", "lead", "run", "key"), "contexts")
    # equal contexts: all but the first are repeats throughout
    names = distinct.select(F.col("c1").alias("__1"), F.col("c2").alias("__2"), F.struct(*order).alias("__first"))
    slim = found.select("c1", "c2", "lead", "run", *order)
    equal = (slim.join(names, (slim["c1"] == names["__1"]) & (slim["c2"] == names["__2"]))
             .filter(F.struct(*order) != F.col("__first"))
             .select("id", "t1", (F.col("place") - F.col("lead")).alias("lo"),
                     (F.col("place") - F.col("lead") + F.col("run") + SPAN).alias("hi")))
    sizes = stage(distinct.groupBy(F.col("key").alias("__k")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    groups = stage(distinct.join(sizes, distinct["key"] == sizes["__k"]).drop("__k", "c1", "c2"), "groups")
    cold, warm = groups.filter(F.col("size") <= hot), groups.filter(F.col("size") > hot)
    # buckets by sampled splitters over the anchor's leading bytes
    total = cold.count()
    buckets = max(shuffle_parts(spark), total // BUCKET + 1)
    leading = F.expr(f"substring(ctx, lead + 1, {SEED})")
    share = min(1.0, SAMPLE_PER_BUCKET * buckets / max(1, total))
    sample = sorted(bytes(r[0]) for r in cold.select(leading).sample(share, seed=3).limit(4 * SAMPLE_PER_BUCKET * buckets).collect())
    cuts = np.array(sorted({sample[len(sample) * k // buckets] for k in range(1, buckets)}) if sample else [], dtype=f"S{SEED}")
    text_cuts = [bytes(c).ljust(SEED, b"\0") for c in cuts]

    @F.pandas_udf("int")
    def bucket(lead_bytes):
        import pandas as pd
        from bisect import bisect_right
        return pd.Series([bisect_right(text_cuts, bytes(x)) for x in lead_bytes], dtype="int32")

    cold = (cold.withColumn("bucket", bucket(leading)).repartition(buckets, "bucket")
            .sortWithinPartitions("bucket", *order)
            .select("bucket", "id", "t1", "place", "ctx", "lead", "run")
            .mapInArrow(_bucket, "id long, t1 long, lo long, hi long"))
    windows = warm.mapInArrow(_windows, "w1 long, w2 long, id long, t1 long, place long, start long")
    warm = (_not_first(windows, ["w1", "w2"], ["id", "t1", "start"]).groupBy("id", "t1", "place")
            .agg(F.min("start").alias("lo"), (F.max("start") + SPAN).alias("hi")).select("id", "t1", "lo", "hi"))
    return equal.unionByName(cold).unionByName(warm)


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def keep_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, n, sha = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = text.as_py().encode()
            cut = merged((s["lo"], s["hi"]) for s in spans.as_py())
            removed.append(sum(b - a for a, b in cut))
            n.append(len(cut))
            sha.append(hashlib.sha256(keep_bytes(data, cut)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("t1"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
            names=["__id", "__t1", "removed", "spans", "sha"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   broadcast_keys: int = BROADCAST_KEYS, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("id"),
                        F.xxhash64(text).alias("t1"), text.alias("text"))
    base = stage(docs.select(F.col(id_col).alias("__own"), F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("id"),
                             F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("t2"),
                             F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole")), "texts")
    copies = stage(base.filter(F.col("n_bytes") >= SPAN).groupBy(F.col("t1").alias("__1"), F.col("t2").alias("__2"))
                   .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    spans = stage(repeats(texts, broadcast_keys, hot).groupBy("id", "t1")
                  .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    ids = spans.select(F.col("id").alias("__i"), F.col("t1").alias("__t"))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = texts.join(side, (texts["id"] == F.col("__i")) & (texts["t1"] == F.col("__t")), "left_semi").distinct()
    s = spans.select(F.col("id").alias("__i"), F.col("t1").alias("__t"), "spans")
    cut = stage(some.join(s, (some["id"] == s["__i"]) & (some["t1"] == s["__t"])).select("id", "t1", "text", "spans")
                .mapInArrow(_apply, "__id long, __t1 long, removed long, spans long, sha string"), "cut")
    firsts = base.join(copies, (base["t1"] == copies["__1"]) & (base["t2"] == copies["__2"]), "left").select(
        "__own", "id", "t1", "n_bytes", "whole", (F.col("id") > F.col("first")).alias("again"))
    out = firsts.join(cut, (firsts["id"] == cut["__id"]) & (firsts["t1"] == cut["__t1"]), "left")
    again = F.coalesce("again", F.lit(False))
    return out.select(
        F.col("__own").alias(id_col), "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(again, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"))
