"""Benchmark decontamination with an FM-index per shard of training documents.

A benchmark item's windows are its runs of ``window`` words (one window if it
has fewer).  Items come in blocks of bounded size; a block's vocabulary is the
index's alphabet, every other word is a separator, and so are runs of
vocabulary words shorter than the block's shortest window, which can hold no
match.  Each task cuts its documents into shards of whole documents, builds
the index, searches all windows backwards at once, locates the occurrences
and merges them into spans per document.  No shuffle; a further block of items
reads the rows of the one before with what was found so far.

Defined cases: null or empty texts and items have no words and no windows;
repeated rows are judged each for itself; a repeated item counts once; an item
with a null id marks words but is not listed; an empty table or benchmark
gives no hits; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import stage
from cohortkit.llm.fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 20       # a shard ends with the document that passes this
BLOCK_BYTES = 4 << 20       # benchmark text in one broadcast block, about
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: what [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ takes
WORD_TEXT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # the same before A-Z are lower-cased

FOUND = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
         T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
FOUND_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Block:
    """Windows of some items as codes, by window length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.code: dict[bytes, int] = {}
        self.ids = [item for item, _ in items]
        by: dict[int, tuple[list, list]] = {}
        for at, (_, text) in enumerate(items):
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in words(text)]
            size = min(window, len(codes))
            if size:
                lines, ids = by.setdefault(size, ([], []))
                lines += [codes[i:i + size] for i in range(len(codes) - size + 1)]
                ids += [at] * (len(codes) - size + 1)
        self.windows = {k: (np.array(a, np.int64), np.array(b, np.int64)) for k, (a, b) in by.items()}
        self.shortest = min(by, default=0)


def find(codes: list[np.ndarray], block: Block) -> dict[int, tuple[set[int], list[list[int]]]]:
    """Items and merged word spans [start, end) of the documents of a shard that have any."""
    doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    word = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, int)
    flat = np.concatenate(codes) if codes else np.empty(0, int)
    # runs of vocabulary words inside one document, long enough for a window
    turn = ((flat[1:] > 0) != (flat[:-1] > 0)) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(np.concatenate(([True], turn, [True]))) if len(flat) else np.empty(0, int)
    start, end = edge[:-1], edge[1:]
    use = (flat[start] > 0) & (end - start >= block.shortest) if len(start) else np.empty(0, bool)
    start, end = start[use], end[use]
    if not len(start):
        return {}
    size = end - start
    at = np.cumsum(size + 1) - size - 1                       # each run and a separator after it
    text = np.zeros(int((size + 1).sum()), np.int64)
    source = np.repeat(start - at, size + 1) + np.arange(len(text))
    inside = np.ones(len(text), bool)
    inside[at + size] = False
    text[inside] = flat[source[inside]]
    index = FMIndex(text)
    got = []
    for length, (phrases, ids) in block.windows.items():
        lo, hi = index.search(phrases)
        n = hi - lo
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if len(rows):
            place = source[index.locate(rows)]
            got.append(np.stack((doc[place], word[place], word[place] + length, np.repeat(ids, n))))
    if not got:
        return {}
    hits = np.concatenate(got, axis=1)
    hits = hits[:, np.lexsort((hits[1], hits[0]))]
    out: dict[int, tuple[set[int], list[list[int]]]] = {}
    for d, a, b, item in hits.T.tolist():
        items, spans = out.setdefault(d, (set(), []))
        items.add(block.ids[item])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return out


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(batches: Iterator[pa.RecordBatch], block: Block, keep: list[str], again: bool,
            cut: bool = False) -> Iterator[pa.RecordBatch]:
    """``keep`` and what was found; with ``cut`` the shortened text instead, null where nothing was found."""
    get = block.code.get
    for batch in batches:
        texts = batch.column("__text")
        n_words, items, spans = [], [], []
        old = (batch.column("items"), batch.column("spans")) if again else None

        def flush(codes):
            found = find(codes, block)
            for k in range(len(codes)):
                a, b = found.get(k, (set(), []))
                if old:
                    at = len(items)
                    a, b = a | set(old[0][at].as_py()), merge(b + old[1][at].as_py())
                items.append(sorted(a, key=lambda x: (x is not None, x)))
                spans.append(b)

        shard, held = [], 0
        for t in texts:
            w = words(t.as_py())
            shard.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            n_words.append(len(w))
            held += len(w)
            if held >= SHARD_WORDS:
                flush(shard)
                shard, held = [], 0
        flush(shard)
        if cut:
            new = [cut_words(t.as_py(), s) if s else None for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(new, pa.string())], names=[*keep, "__cut"])
            continue
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(x, t) for x, t in zip((n_words, items, spans), FOUND_ARROW)],
            names=[*keep, *(f.name for f in FOUND)])


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, window: int, block_bytes: int,
           cut: bool = False) -> DataFrame:
    """Columns ``keep`` as __0, __1, ..., and n_words, items and spans; with ``cut`` __text and __cut instead of these."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    names = [f"__{i}" for i in range(len(keep))]  # columns of any name pass through
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("__text"))
    for k in range(blocks):
        items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").filter(part == k).distinct().collect()]
        block = spark.sparkContext.broadcast(Block(items, window))
        last = k == blocks - 1
        hold = names if last and not cut else [*names, "__text"]
        fields = [T.StructField("__cut", T.StringType())] if last and cut else FOUND
        schema = T.StructType([rows.schema[c] for c in hold] + fields)
        rows = rows.mapInArrow(lambda it, b=block, h=hold, again=k > 0, c=last and cut: _search(it, b.value, h, again, c), schema)
        if not last:
            rows = stage(rows, "decontaminate")
            block.unpersist()
    return rows


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` of every row, n_words, items (sorted ids, a null id first) and spans (word [start, end) pairs)."""
    rows = _found(docs, benchmark, keep, text_col, window, block_bytes)
    return rows.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "n_words", "items", "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the item list and the verdict of every row of ``search``."""
    ids = F.filter("items", lambda x: x.isNotNull())
    return found.select(
        id_col, "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(F.transform(ids, lambda x: x.cast("string")))), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def cut_words(text: str, spans: list) -> str:
    """The text without the words of the spans, nor what stands between them."""
    places = [m.span() for m in WORD_TEXT.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars",
           window: int = WINDOW) -> DataFrame:
    """All rows of ``docs``; benchmark passages are cut out of the texts that hold any.

    The task that finds the passages cuts them: a second Python step would hold a second worker with texts for each core."""
    others = [c for c in docs.columns if c != text_col]
    name = {c: f"__{i}" for i, c in enumerate(others)}
    out = _found(docs, benchmark, others, text_col, window, BLOCK_BYTES, cut=True)
    hit = F.col("__cut").isNotNull()
    return out.select(*[
        F.coalesce("__cut", "__text").alias(c) if c == text_col
        else F.when(hit, F.length("__cut")).otherwise(F.col(name[c])).cast(docs.schema[c].dataType).alias(c) if c == length_col
        else F.col(name[c]).alias(c) for c in docs.columns])
