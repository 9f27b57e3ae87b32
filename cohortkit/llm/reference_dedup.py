"""Removal of passages that start in an earlier document, by suffix automata over reference shards.

Every word inside a ``SPAN``-word window whose word sequence also starts in a
document with a smaller id is removed.  A suffix automaton of a shard of
reference passages holds all their substrings; each state knows the least id
that has it.  Documents are streamed through it: the matching statistic (the
longest stretch that ends at a word and occurs in the shard) reaches SPAN where
a window is found, and the state then names the window's first document.

The reference is the corpus itself, so shards and documents are cut by content
so that each piece meets the one shard that can match it.  In every window the
place of its least ``SEED``-word hash (the leftmost one) is its anchor; equal
windows have their anchors at the same place, and consecutive windows with one
anchor travel as one passage of at most 2 * SPAN - SEED words.

1. Anchors of one document alone are dropped (a map-side combined minimum and maximum).
2. Equal passages of an anchor are one, with the least id that has it.
3. Shards: the passages of an anchor, at most ``HOT``, make an automaton; it goes
   where the passages of that anchor are, which are streamed through it.  (An
   automaton of the whole corpus would have to be broadcast to everyone;
   ``known_spans`` does that for a reference table, shard by shard.)
4. An anchor with more passages would fill a task: its windows, named by 128-bit
   hashes, find their first documents one by one across all tasks.
5. Each document joins the verdicts of its passages and its removed runs merge.

Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words; a text under SPAN words
stays whole; rows with one id are one document as far as "smaller" goes, each
row gets its own result; a null id comes last; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import shuffle_parts, stage, text_or_empty
from cohortkit.llm.shingles import mix, word_hashes

SPAN = 50
SEED = 8
HOT = 2000                 # passages of one anchor that one automaton takes
SHARD_WORDS = 500_000      # words of a broadcast automaton, about 100 MB as Python objects
CHUNK = 1 << 19            # characters of text worked on at once; a longer text is a chunk of its own
MAX_ID = (1 << 63) - 1
NOBODY = 1 << 63

_rnd = np.random.default_rng(50)
_BYTE = _rnd.integers(1, 1 << 63, size=256, dtype=np.uint64)
_SPREAD, _HIGH, _LOW = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF << 32), np.uint64(0xFFFFFFFF)
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_BACK = [pow(b, -1, 1 << 64) for b in _BASE]


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``first[state]`` is the least owner of the state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [NOBODY]

    def _state(self, length: int, link: int, arrows: dict) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        self.first.append(NOBODY)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of p's longest string and ``word``, cut off from q where q also has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[int], owner: int) -> None:
        arrows, link, first = self.next, self.link, self.first
        last = 0
        for word in words:
            p, q = last, arrows[last].get(word)
            if q is None:
                last = self._state(self.length[last] + 1, 0, {})
                while p >= 0 and word not in arrows[p]:
                    arrows[p][word] = last
                    p = link[p]
                if p >= 0:
                    link[last] = self._split(p, word, arrows[p][word])
            else:
                last = self._split(p, word, q)
            if owner < first[last]:
                first[last] = owner

    def settle(self) -> "SuffixAutomaton":
        """Owners pass to the states of their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.first[s] < self.first[up]:
                self.first[up] = self.first[s]
        return self

    def first_owners(self, words: list[int], span: int = SPAN) -> list[int]:
        """Of each window of ``span`` words its least owner, or NOBODY; by matching statistics held at ``span``."""
        arrows, link, length, first = self.next, self.link, self.length, self.first
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in arrows[state]:
                state = link[state]
                size = length[state]
            to = arrows[state].get(word)
            if to is not None:
                state, size = to, size + 1
                while length[link[state]] >= span:
                    state = link[state]
                size = min(size, span)
            out.append(first[state] if size == span else NOBODY)
        return out[span - 1:]


def _ranges(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the word ranges [lo, hi)."""
    powers = np.full(len(h) + 1, np.uint64(_BASE[which]))
    back = np.full(len(h) + 1, np.uint64(_BACK[which]))
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[:-1], dtype=np.uint64)))
    return mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64) * _SPREAD)


def anchors(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, anchor's hash, first and last word-place of the windows; places count over all texts."""
    none = np.empty(0, np.int64)
    if len(h) < SPAN:
        return none, np.empty(0, np.uint64), none, none
    g, m = h, 1
    while m < SEED:
        g = mix(g[:-m] * np.uint64(_BASE[0] + 2 * m) + g[m:])
        m *= 2
    # hash above, place below: the least is the smallest hash, the leftmost one if several
    low = (g & _HIGH) | np.arange(len(g), dtype=np.uint64)
    width, m = SPAN - SEED + 1, 1
    while m < width:
        k = min(m, width - m)
        low = np.minimum(low[:-k], low[k:])
        m += k
    at = (low & _LOW).astype(np.int64)
    ends = np.cumsum(counts)
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    # a run of windows is cut where a text ends; its windows end at that text's last one
    edges = np.unique(np.concatenate((begin, ends[ends < len(at)])))
    doc = np.searchsorted(ends, edges, side="right")
    last = np.minimum(np.concatenate((edges[1:], [len(at)])) - 1, ends[doc] - SPAN)
    use = last >= edges
    return doc[use], g[at[edges[use]]], edges[use], last[use]


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list]]]:
    """Word hashes of some texts, their word counts and the named columns' values."""
    held, rows, size = [], [], 0

    def out():
        return *word_hashes([t.encode() for t in held], _BYTE), [list(c) for c in zip(*rows)]

    for batch in batches:
        for text, *row in zip(*(batch.column(c).to_pylist() for c in ["text", *names])):
            if len(text) < 2 * SPAN - 1:
                continue
            held.append(text)
            rows.append(row)
            size += len(text)
            if size >= CHUNK:
                yield out()
                held, rows, size = [], [], 0
    if held:
        yield out()


INSTANCE = "key long, c long, id long, t1 long, first int, run int"


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of every text: anchor, hash, place and number of windows."""
    for h, counts, (ids, t1) in _chunks(batches, ["id", "t1"]):
        doc, key, first, last = anchors(h, counts)
        start = np.cumsum(counts) - counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(_ranges(h, first, last + SPAN).view(np.int64)),
             pa.array(np.array(ids, np.int64)[doc]), pa.array(np.array(t1, np.int64)[doc]),
             pa.array((first - start[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
            names=["key", "c", "id", "t1", "first", "run"])


PASSAGE = "key long, c long, id long, hot boolean, words binary"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages that a text was asked for, a repeated row once a task."""
    seen = set()
    for h, counts, (ids, t1, asked) in _chunks(batches, ["id", "t1", "asked"]):
        start, out = np.cumsum(counts) - counts, []
        for at, i, t, some in zip(start.tolist(), ids, t1, asked):
            if (i, t) not in seen:
                seen.add((i, t))
                out += [(s["key"], s["c"], i, s["hot"], h[at + s["first"]:at + s["first"] + s["run"] + SPAN - 1].tobytes()) for s in some]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                                             names=["key", "c", "id", "hot", "words"])


VERDICT = "key long, c long, lo int, hi int, owner long"
_VERDICT = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("owner", pa.int64())])


def _runs(owners: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first window, last window, owner) of runs with one owner."""
    at = 0
    for owner, run in groupby(owners):
        n = len(list(run))
        yield at, at + n - 1, owner
        at += n


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by anchor -> the first document of each of their windows, by the anchor's automaton."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "c", "id", "words")))

    out = []
    for key, group in groupby(rows(), key=lambda r: r[0]):
        passages = {c: (i, np.frombuffer(w, np.int64).tolist()) for _, c, i, w in group}
        automaton = SuffixAutomaton()
        for i, words in passages.values():
            automaton.add(words, i)
        automaton.settle()
        for c, (_, words) in passages.items():
            out += [(key, c, *run) for run in _runs(automaton.first_owners(words))]
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _VERDICT)], schema=_VERDICT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _VERDICT)], schema=_VERDICT)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a passage by two hashes."""
    for batch in batches:
        for key, c, i, words in zip(*(batch.column(x).to_pylist() for x in ("key", "c", "id", "words"))):
            h = np.frombuffer(words, np.uint64)
            at = np.arange(len(h) - SPAN + 1)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ranges(h, at, at + SPAN).view(np.int64)), pa.array(_ranges(h, at, at + SPAN, 1).view(np.int64)),
                 pa.array(np.full(n, key)), pa.array(np.full(n, c)), pa.array(np.full(n, i)), pa.array(at.astype(np.int32))],
                names=["w1", "w2", "key", "c", "id", "at"])


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of one name."""
    r = right.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in right.columns if c not in on))
    cond = [left[c] == r[f"__{c}"] for c in on]
    return left.join(r, cond).drop(*(f"__{c}" for c in on))


def repeats(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, t1, lo, hi) word ranges that start in an earlier document, of texts (id, t1, text)."""
    spark = texts.sparkSession
    found = stage(texts.mapInArrow(_instances, INSTANCE), "instances")
    # aggregates are staged before their joins, so that Spark can split a hot key's rows there
    shared = stage(found.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key"), "keys")
    found = stage(_joined(found, shared, ["key"]), "shared")
    distinct = found.groupBy("key", "c").agg(F.min(F.struct("id", "t1", "first", "run")).alias("f")).select("key", "c", "f.*")
    distinct = stage(distinct, "distinct")
    sizes = stage(distinct.groupBy("key").agg((F.count(F.lit(1)) > hot).alias("hot")), "sizes")
    asked = (_joined(distinct, sizes, ["key"]).groupBy("id", "t1")
             .agg(F.collect_list(F.struct("key", "c", "first", "run", "hot")).alias("asked")))  # at most a text's own anchors
    passages = stage(_joined(texts, asked, ["id", "t1"]).mapInArrow(_passages, PASSAGE), "passages")
    cold = (passages.filter("not hot").select("key", "c", "id", "words").repartition(shuffle_parts(spark), "key")
            .sortWithinPartitions("key").mapInArrow(_sharded, VERDICT))
    windows = stage(passages.filter("hot").mapInArrow(_windows, "w1 long, w2 long, key long, c long, id long, at int"), "windows")
    owners = stage(windows.groupBy("w1", "w2").agg(F.min("id").alias("owner")), "owners")
    warm = (_joined(windows, owners, ["w1", "w2"]).groupBy("key", "c", "owner", F.col("at").alias("lo")).agg(F.max("at").alias("hi"))
            .select("key", "c", "lo", "hi", "owner"))
    verdicts = stage(cold.unionByName(warm), "verdicts")
    return (_joined(found, verdicts, ["key", "c"]).filter("owner < id")
            .select("id", "t1", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + SPAN).alias("hi")))


_WHITE = b" \t\n\x0b\x0c\r"
_SPLIT = bytes.maketrans(_WHITE, b" " * len(_WHITE))


def words_of(text: str) -> list[bytes]:
    """Words of a whole text; white space is the contract's."""
    return [w for w in text.encode().translate(_SPLIT).split(b" ") if w]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for lo, hi in spans:
        out += words[at:lo]
        at = hi
    return out + words[at:]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, sha = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = words_of(text)
            kept = kept_words(words, merged((s["lo"], s["hi"]) for s in spans)) if spans else words
            n.append(len(words))
            removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("own"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["own", "n_words", "n_removed", "kept_sha256"])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("id"),
                       F.xxhash64(text).alias("t1"), text.alias("text"))


def _with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``texts`` with the list of its spans (null if it has none)."""
    s = spans.groupBy(F.col("id").alias("__id"), F.col("t1").alias("__t1")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return texts.join(s, (texts["id"] == s["__id"]) & (texts["t1"] == s["__t1"]), "left").drop("__id", "__t1")


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Automata of at most ``size`` words each; a longer text is cut into pieces that overlap by a window less one word."""
    automaton, n = SuffixAutomaton(), 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(automaton.settle(), 5)], pa.large_binary()).cast(pa.binary())], names=["blob"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = word_hashes([text.encode()], _BYTE)[0].view(np.int64).tolist()
            for at in range(0, max(1, len(words) - SPAN + 1), size - SPAN + 1):
                piece = words[at:at + size]
                if n and n + len(piece) > size:
                    yield out()
                    automaton, n = SuffixAutomaton(), 0
                automaton.add(piece, 0)
                n += len(piece)
    if n:
        yield out()


def _streamed(batches: Iterator[pa.RecordBatch], blob) -> Iterator[pa.RecordBatch]:
    """The maximal runs of words of every text that the broadcast automaton covers with whole windows."""
    automaton = pickle.loads(blob.value)
    for batch in batches:
        rows = []
        for text, i, t in zip(*(batch.column(c).to_pylist() for c in ("text", "id", "t1"))):
            words = word_hashes([text.encode()], _BYTE)[0].view(np.int64).tolist()
            rows += [(i, t, lo, hi + SPAN) for lo, hi, owner in _runs(automaton.first_owners(words)) if owner != NOBODY]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             names=["id", "t1", "lo", "hi"])


def known_spans(texts: DataFrame, reference: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, t1, lo, hi) word ranges of texts (id, t1, text) whose windows occur in ``reference`` (text).

    One automaton of at most ``shard_words`` words is broadcast at a time.
    """
    sc = texts.sparkSession.sparkContext
    automata = stage(reference.select(text_or_empty().alias("text")).mapInArrow(lambda it: _shards(it, shard_words), "blob binary"), "automata")
    empty = texts.sparkSession.createDataFrame([], "id long, t1 long, lo int, hi int")
    out = [empty]
    for row in automata.toLocalIterator():
        held = sc.broadcast(bytes(row.blob))
        out.append(stage(texts.mapInArrow(lambda it, held=held: _streamed(it, held), empty.schema), "known"))
        held.unpersist()
    return reduce(DataFrame.unionByName, out)


def remove_known(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row, without the windows that a reference table has."""
    texts = _prepared(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = known_spans(texts.select("id", "t1", "text"), reference, shard_words)
    return _with_spans(texts.select("own", "id", "t1", "text"), spans).select("own", "text", "spans").mapInArrow(
        _apply, f"own {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("own", id_col)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row."""
    texts = _prepared(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeats(texts.select("id", "t1", "text"), hot)
    return _with_spans(texts.select("own", "id", "t1", "text"), spans).select("own", "text", "spans").mapInArrow(
        _apply, f"own {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("own", id_col)
