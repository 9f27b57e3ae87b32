"""Delta-maintained token counts by source, language and tokenizer version.

A store is a folder with two tables, each written batch by batch:

* ``counts/batch=<id>``: signed rows per document (id, tokenizer, source,
  language, documents, tokens): +new for upserted documents, -old for what an
  upsert replaces (same tokenizer version) or a delete takes away (all versions);
* ``deltas/batch=<id>``: the same rows summed by source, language and tokenizer.

A batch is committed when its ``deltas`` folder has Spark's success marker,
which is written last.  A committed batch is skipped when it comes again; a
batch that broke off is overwritten as a whole.  Totals are the sum of the
committed deltas, so they cost what the deltas hold, not what the corpus holds.
Hot sources meet map-side combined sums only; old counts are joined by document id.

Defined cases: a null or empty text counts as a document with no tokens; null
sources and languages are groups of their own; rows that repeat an id in one
batch count each, and a later delete or upsert takes them all back; deletes of
unknown ids change nothing; an id both deleted and upserted in a batch is
upserted; a null id is counted and can't be taken back; groups whose documents
are all gone have no row; empty batches are committed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import tokens

COUNTS = "doc_id long, tokenizer string, source string, lang string, n_docs long, n_tokens long"
GROUP = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
SLICE = 512

# version -> tokens of a text
TOKENIZERS: dict[str, Callable[[str], int]] = {
    "words-1": lambda t: len(t.encode().split()),
    "byte_bpe_50k": lambda t: len(tokens.encode(t)),
}


def _count(batches: Iterator[pa.RecordBatch], versions: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            texts = part.column("text").to_pylist()
            for v in versions:
                f = TOKENIZERS[v]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([v] * len(texts)), part.column("source"), part.column("lang"),
                     pa.array([1] * len(texts), pa.int64()), pa.array([f(t) if t else 0 for t in texts], pa.int64())],
                    names=[c.split()[0] for c in COUNTS.split(", ")])


class TokenStore:
    """Totals under one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.root}/deltas/batch={batch}/_SUCCESS")

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        if not self._exists(f"{self.root}/deltas"):
            return []
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        found = sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))
        return [b for b in found if self.committed(b)]

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{table}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """What each document counts for now."""
        return (self._read("counts", COUNTS).groupBy("doc_id", *GROUP)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0"))

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None,
               versions: list[str] | None = None) -> bool:
        """Apply a batch once; False if it was applied before.

        ``upserts`` has doc_id, text, source, lang; ``deletes`` has doc_id.
        """
        if self.committed(batch):
            return False
        versions = list(TOKENIZERS) if versions is None else versions
        parts, gone = [], []
        if upserts is not None:
            rows = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                  F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
            parts.append(rows.mapInArrow(lambda it: _count(it, versions), COUNTS))
            gone.append(rows.select(F.col("doc_id").alias("__id"), F.array(*[F.lit(v) for v in versions]).alias("__only")))
        if deletes is not None:
            gone.append(deletes.select(F.col("doc_id").cast("long").alias("__id"),
                                       F.lit(None).cast("array<string>").alias("__only")))
        if gone and self.batches():
            ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            ids = ids.filter("__id is not null").groupBy("__id").agg(F.max(F.col("__only").isNull()).alias("__all"))
            old = self.state()
            taken = old.join(ids, old["doc_id"] == ids["__id"]).filter(
                F.col("__all") | F.col("tokenizer").isin(versions))
            parts.append(taken.select("doc_id", "tokenizer", "source", "lang", (-F.col("n_docs")).alias("n_docs"),
                                      (-F.col("n_tokens")).alias("n_tokens")))
        signed = parts[0] if parts else self.spark.createDataFrame([], COUNTS)
        for p in parts[1:]:
            signed = signed.unionByName(p)
        signed.write.mode("overwrite").parquet(f"{self.root}/counts/batch={batch}")
        own = self.spark.read.schema(COUNTS).parquet(f"{self.root}/counts/batch={batch}")
        (own.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
         .write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}"))
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return (self._read("deltas", DELTAS).groupBy(*GROUP)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id of every document whose text a smaller id has too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    first = (rows.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b"))
             .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return rows.join(first, (rows["a"] == first["__a"]) & (rows["b"] == first["__b"])).filter(
        F.col("doc_id") > F.col("first")).select("doc_id")
