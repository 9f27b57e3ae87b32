"""Language-model scoring by cross-entropy difference (target against background).

Two bigram models of one form over all words and bigrams of the corpus; the
background is counted over every document, the target over the documents of the
target set.  Words, contexts and bigrams are known by 63 bits of their hash, so
each has a count of its own.  A token's probability is

    L * pair / context + (1 - L) * (word + A) / (total + A * V)

with the same L, A and V in both models (the pair term is left out where the
context was never seen); V is the number of distinct words of the corpus,
``WORDS`` at least.  A document's score is the mean over its tokens of the
background's loss less the target's: higher is more like the target.

Nothing of the models is held whole.  Documents are dealt into blocks of about
``BLOCK`` bytes.  Each block sends its distinct words and bigrams with their
counts once, cut into ranges of the hash; the task of a range sums them over the
blocks and sends each block the sums of its own n-grams, which score its
documents, with the range's share of V and of the totals.  A word's count as a
context travels as what it differs by from the word's count.  An n-gram has one
row per block however frequent it is, so no key is hot.

Defined cases: a null or empty text has no tokens and the score 0; without
target documents the target model is uniform; repeated rows count and are
scored each for itself; an id with a null is in no target set; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import shuffle_parts, stage
from cohortkit.llm.shingles import mix
from cohortkit.llm.slots import token_hashes

WORDS = 1 << 16            # the context of a text's first token, and the least vocabulary of the smoothing
LAMBDA = 0.6
ADD = 0.5
SLICE = 512                # texts of a batch worked on at once
BLOCK = 8 << 20            # bytes of text whose n-grams are asked for together, about
BROADCAST_IDS = 1 << 20    # target ids that may be broadcast; beyond it they are joined

_ODD, _CONTEXT, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(1)


def events(texts: list[str | None]):
    """(words, contexts, pairs, tokens per text) chunk by chunk, as hashes; a text starts after context ``WORDS``."""
    for word, counts in token_hashes(texts):
        before = np.concatenate((np.array([WORDS], np.uint64), word[:-1])) if len(word) else word
        starts = (np.cumsum(counts) - counts)[counts > 0]
        before[starts] = WORDS
        yield word, before, mix(before * _ODD + word), counts


def _keys(word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words and of contexts, which are words (odd), and of pairs (even)."""
    return word | _ONE, before | _ONE, pair & ~_ONE


def _sums(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(c[order], first, dtype=c.dtype) for c in counts)


def _deal(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows with their block, their number in it and the bytes of their text."""
    block, row, held = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        sizes = [len(t.as_py().encode()) if t.is_valid else 0 for t in batch.column("text")]
        blocks, numbers = [], []
        for s in sizes:
            if held and held + s > size:
                block, row, held = block + 1, 0, 0
            blocks.append(block)
            numbers.append(row)
            row, held = row + 1, held + s
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in (blocks, numbers, sizes))],
                                         names=[*batch.schema.names, "block", "row", "size"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, first row of the run, rows): at most SLICE following rows of a block; a run may go on over many of them."""
    last = None
    for batch in batches:
        block, row = batch.column("block").to_numpy(), batch.column("row").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(row) != 1)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, SLICE):
                to = min(SLICE, b - at)
                if last is None or (last[0], last[2]) != (block[at], row[at]):
                    last = (int(block[at]), int(row[at]), 0)
                last = (last[0], last[1], int(row[at]) + to)
                yield last[0], last[1], batch.slice(at, to)


def _counted(batches: Iterator[pa.RecordBatch]):
    """(block, first row, keys, counts) of each run: counts of the n-gram in the background and the target, and how much
    more often it is a word than a context there."""
    now, held = None, []
    for block, first, part in _runs(batches):
        if (block, first) != now and held:
            whole, held = [np.concatenate(c) for c in zip(*held)], []
            keys, *counts = _sums(*whole)
            yield *now, keys, counts
            del whole
        now = (block, first)
        target, done = part.column("target").to_numpy(zero_copy_only=False).astype(np.int32), 0
        for word, before, pair, counts in events(part.column("text").to_pylist()):
            use = np.repeat(target[done:done + len(counts)], counts)
            done += len(counts)
            one, none = np.ones(len(use), np.int32), np.zeros(len(use), np.int32)
            w, c, p = _keys(word, before, pair)
            held.append(_sums(np.concatenate((w, c)), *(np.concatenate(x) for x in (
                (one, none), (use, none), (one, -one), (use, -use)))))
            held.append(_sums(p, one, use, none, none))
    if held:
        keys, *counts = _sums(*map(np.concatenate, zip(*held)))
        yield *now, keys, counts


PACKED = "part int, block long, row long, keys binary, counts binary, shares array<long>"
ROWS = 1024  # packed rows of a batch


def _pack(x: np.ndarray) -> bytes:
    """Compressed numbers, all their lowest bytes first."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["part", "block", "row", "keys", "counts", "shares"])


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each run's distinct n-grams, cut into ``parts`` ranges of the key (empty ones too); sorted keys as steps."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    for block, row, keys, counts in _counted(batches):
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        rows = [(k, block, row, _pack(np.diff(keys[x:y], prepend=np.uint64(0))), _pack(np.concatenate([c[x:y] for c in counts])), None)
                for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        for at in range(0, len(rows), ROWS):
            yield _packed(rows[at:at + ROWS])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: the sums over all blocks of each run's n-grams, in the order of its keys, and the range's
    words, tokens of the background and tokens of the target."""
    def answers(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for _, _, k, _ in held]
        counts = [_unpack(c, np.int32).reshape(4, -1) for *_, c in held]
        known, *sums = _sums(np.concatenate(keys), *(np.concatenate([c[i] for c in counts]).astype(np.int64) for i in range(4)))
        del counts
        word = (known & _ONE) == _ONE
        shares = [int((word & (sums[0] > 0)).sum()), int(sums[0][word].sum()), int(sums[1][word].sum())]
        for at in range(0, len(held), ROWS):
            out = []
            for (block, row, *_), mine in zip(held[at:at + ROWS], keys[at:at + ROWS]):
                place = np.searchsorted(known, mine)
                out.append((part, block, row, None, _pack(np.concatenate([x[place] for x in sums])), shares))
            yield _packed(out)

    now, held = None, []
    for batch in batches:
        for part, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "row", "keys", "counts"))):
            if part != now and held:
                yield from answers(now, held)
                held = []
            now = part
            held.append(tuple(rest))
    if held:
        yield from answers(now, held)


def _loss(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    base = (word + ADD) / (total + ADD * vocabulary)
    p = np.where(context > 0, LAMBDA * np.minimum(1.0, pair / np.maximum(context, 1)) + (1 - LAMBDA) * base, base)
    return -np.log(p)


def _scored(parts: list[pa.RecordBatch], answers: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Scores of a run; its sorted distinct n-grams are those that it asked for."""
    grams = [[(_keys(*g), counts) for *g, counts in events(part.column("text").to_pylist())] for part in parts]
    keys = [_sums(k)[0] for part in grams for g, _ in part for k in g]
    keys = _sums(np.concatenate(keys))[0] if keys else np.empty(0, np.uint64)
    sums = [np.concatenate(c) for c in zip(*(_unpack(a[1], np.int64).reshape(4, -1) for a in sorted(answers)))] or [keys] * 4
    vocabulary, *totals = (sum(x) for x in zip(*(a[2] for a in answers))) if answers else (0, 0, 0)
    vocabulary = max(WORDS, vocabulary)
    assert len(keys) == len(sums[0])
    for part, texts in zip(parts, grams):
        n, scores = [], []
        for g, counts in texts:
            w, c, p = (np.searchsorted(keys, k) for k in g)
            background, target = (_loss(x[w], x[c] - more[c], x[p], total, vocabulary)
                                  for x, more, total in zip(sums[:2], sums[2:], totals))
            n.append(counts)
            scores.append(np.bincount(np.repeat(np.arange(len(counts)), counts), weights=background - target, minlength=len(counts))
                          / np.maximum(counts, 1))
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.concatenate(n).astype(np.int64)),
                                          pa.array(np.concatenate(scores))], names=["id", "n_tokens", "score"])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the answers before the texts, the texts by their number."""
    now, answers, run, held = None, {}, None, []
    for batch in batches:
        block, row, kind = (batch.column(c).to_numpy() for c in ("block", "row", "kind"))
        at = 0
        while at < len(block):
            if block[at] != now or kind[at] == 0:
                if held:
                    yield from _scored(held, answers.pop(run, []))
                    held = []
                if block[at] != now:
                    now, answers, run = block[at], {}, None
            if kind[at] == 0:
                answers.setdefault(int(row[at]), []).append(tuple(batch.column(c)[at].as_py() for c in ("part", "counts", "shares")))
                at += 1
                continue
            if row[at] in answers and row[at] != run:
                if held:
                    yield from _scored(held, answers.pop(run, []))
                    held = []
                run = int(row[at])
            to = at + 1
            while to < min(len(block), at + SLICE) and block[to] == now and row[to] not in answers:
                to += 1
            held.append(batch.slice(at, to - at).select(["id", "text"]))
            at = to
    if held:
        yield from _scored(held, answers.pop(run, []))


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          block: int = BLOCK) -> DataFrame:
    """id, n_tokens and score of every row; ``target_ids`` has one column of ids."""
    spark = docs.sparkSession
    ids = stage(target_ids.toDF("__i").dropna().distinct(), "target-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        side, F.col("id") == F.col("__i"), "left").select("id", "text", F.col("__i").isNotNull().alias("target"))
    rows = stage(rows.mapInArrow(lambda it: _deal(it, block),
                                 f"id {kind}, text string, target boolean, block long, row long, size long"), "blocks", "zstd")
    size = rows.agg(F.sum("size")).first()[0] or 0
    parts, n = 1 + size // block, shuffle_parts(spark)
    answers = (rows.select("text", "target", "block", "row").mapInArrow(lambda it: _ask(it, parts), PACKED)
               .repartition(n, "part").sortWithinPartitions("part").mapInArrow(_answer, PACKED).drop("keys")
               .select("block", F.lit(0).alias("kind"), "row", "part", "counts", "shares", F.lit(None).cast(kind).alias("id"),
                       F.lit(None).cast("string").alias("text")))
    texts = rows.select("block", F.lit(1).alias("kind"), "row", F.lit(None).cast("int").alias("part"),
                        F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("array<long>").alias("shares"), "id", "text")
    return (answers.unionByName(texts).repartition(n, "block").sortWithinPartitions("block", "kind", "row")
            .mapInArrow(_score, f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col))
