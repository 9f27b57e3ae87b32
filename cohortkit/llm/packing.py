"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces (only those over the limit are cut; the first piece
takes the remainder).  Packing needs only the number of pieces of each length,
at most ``limit`` counts: a bin is filled greedily with the longest pieces that
fit, then its shortest piece is replaced by two unpacked ones that fit the
widened gap more tightly.  The same bin is repeated as often as the counts
allow, which gives a short list of patterns.  Each piece then finds its bin
and place from its number within its length.  Whole texts never leave the
tasks; the driver sees the counts alone.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed each for itself; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm import tokens
from cohortkit.llm.common import shuffle_parts, stage

LIMIT = 1024
END = 2


def _cut(batches: Iterator[pd.DataFrame], limit: int, end: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            ids = np.append(tokens.encode(text), np.uint32(end)).astype("<u4")
            first = (len(ids) - 1) % limit + 1
            at = 0
            for k, to in enumerate(range(first, len(ids) + 1, limit)):
                rows.append((doc, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                at = to
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, limit: int = LIMIT, end: int = END, id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        lambda it: _cut(it, limit, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in a bin) by best-two-fit; every piece is in one bin.

    Each pattern uses up a length, or leaves less of it than one bin takes, so
    the list's size depends on ``limit``, not on the number of pieces.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        free, gap, bin_ = left.copy(), limit, []
        while True:
            fits = np.flatnonzero(free[:gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            bin_.append(longest)
            free[longest] -= 1
            gap -= longest
        smallest = bin_[-1]
        room = gap + smallest
        have = np.flatnonzero(free[:room + 1])
        if gap and len(have):
            below = np.maximum.accumulate(np.where(free > 0, np.arange(limit + 1), 0))
            partner = below[room - have]
            twice = (partner == have) & (free[have] < 2)  # one piece can't be its own partner
            partner = np.where(twice, below[np.maximum(have - 1, 0)], partner)
            sums = np.where(partner > 0, have + partner, 0)
            best = int(sums.argmax())
            if sums[best] > smallest:
                bin_[-1:] = sorted((int(have[best]), int(partner[best])), reverse=True)
        used = np.bincount(bin_, minlength=limit + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((times, bin_))
    return out


def slots(found: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Runs of piece numbers of a length that take one place in consecutive bins."""
    rows, seen, base = [], {}, 0
    for times, bin_ in found:
        at = 0
        for length in bin_:
            rows.append((length, seen.get(length, 0), base, at))
            seen[length] = seen.get(length, 0) + times
            at += length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "bin", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, id_col: str = "doc_id") -> DataFrame:
    """Every piece with its sequence and place.

    A piece of the full length is a sequence of its own (negative numbers).
    The others are numbered within their length over (length, bucket) groups
    and bucket offsets, so that a common length is not one group.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, limit, end, id_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    buckets = max(64, shuffle_parts(spark))
    short = cut.filter(F.col("length") < limit).withColumn(
        "bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    groups = stage(short.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("n")).collect()}  # at most limit - 1 rows
    runs = slots(patterns(counts, limit))
    by = Window.partitionBy("length").orderBy("bucket")
    before = groups.select(F.col("length").alias("__l"), F.col("bucket").alias("__b"),
                           (F.sum("n").over(by) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1
    numbered = (short.withColumn("k", within)
                .join(before, (F.col("length") == F.col("__l")) & (F.col("bucket") == F.col("__b")))
                .withColumn("number", F.col("before") + F.col("k")))
    keys = (runs["length"].to_numpy(np.int64) << 48) | runs["first"].to_numpy(np.int64)
    firsts, bins, offsets = (runs[c].to_numpy(np.int64) for c in ("first", "bin", "offset"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 48) | number.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + number.to_numpy(np.int64) - firsts[at], "offset": offsets[at]})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = numbered.withColumn("p", place("length", "number")).select(
        *columns, F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))
    full = cut.filter(F.col("length") >= limit).select(
        *columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).withColumnRenamed("doc_id", id_col)
