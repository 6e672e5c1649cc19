"""Token counts kept by signed deltas.

A rollup is a folder. Each batch appends a log of signed rows per document (+1 with
the new count, -1 with the count to take back) and the sums of those by source,
language and tokenizer version; totals are the sums of all committed batches. No text
is counted again: what a batch takes back is found by joining its ids with the log's
narrow rows, of which it reads the row groups that overlap the batch's range of ids (a
batch of new, higher ids reads footers only). The marker that Spark's committer puts
into a batch's sums is its commit: a batch that has it is never applied again, one
that lacks it is written anew from the same state, so retries and replays are
idempotent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import tokens
from codelode.session import materialize, release, scratch_paths, ship

KEYS = ["source", "lang", "tokenizer_version"]
LOG = "doc_id long, source string, lang string, tokenizer_version string, docs long, n_tokens long"
SUMS = "source string, lang string, tokenizer_version string, docs long, n_tokens long"


def _counted(source: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(source).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = [len(ids) // 4 for ids in encode([x or "" for x in batch.column(4).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(4)), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "op", "n_tokens"]
                )

    return run


class TokenRollup:
    """A rollup in the folder ``root`` for one tokenizer file; other versions' totals may lie in the same folder."""

    def __init__(self, spark: SparkSession, root: str, tokenizer: str | None = None):
        ship(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self.vocabulary = tokens.vocabulary(spark, tokenizer or tokens.default_path())
        self.version = hashlib.sha256(self.vocabulary.value).hexdigest()[:12]

    def committed(self) -> list[int]:
        """Numbers of the batches whose sums carry the commit marker."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/sums/*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern) or []
        return sorted(int(str(x.getPath().getParent().getName())) for x in found)

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{part}/{n}" for n in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply one batch of ``changes`` (doc_id, text, source, lang, op, ...); False if it was committed before.

        ``op`` is insert, revise or delete. Inserts of a live document revise it, revisions
        of an unknown one insert it, deletes of an unknown one do nothing. Of rows that
        repeat an id in a batch, a delete wins, then the greatest (text, source, lang).
        Rows without an id are inserted, one by one, and can't be taken back. Null and
        empty texts have no tokens, very long ones are counted whole; null sources and languages are groups of their own.
        """
        if batch in self.committed():
            return False
        rows = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.coalesce(F.lower("op"), F.lit("insert")).alias("op"), F.col("text").cast("string").alias("text"),
        ).withColumn("text", F.when(F.col("op") != "delete", F.col("text")))
        before = set(scratch_paths())
        counted = materialize(rows.mapInArrow(_counted(self.vocabulary), "doc_id long, source string, lang string, op string, n_tokens long"), "counted")
        best = F.max(F.struct((F.col("op") == "delete").alias("gone"), "n_tokens", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l"), "source", "lang"))
        new = counted.where("doc_id is not null").groupBy("doc_id").agg(best.alias("x"))
        new = new.select("doc_id", "x.source", "x.lang", "x.gone", "x.n_tokens")
        plus = new.where("not gone").select("doc_id", "source", "lang", F.lit(self.version).alias("tokenizer_version"), F.lit(1).cast("long").alias("docs"), "n_tokens")
        loose = counted.where("doc_id is null and op <> 'delete'").select(
            "doc_id", "source", "lang", F.lit(self.version).alias("tokenizer_version"), F.lit(1).cast("long").alias("docs"), "n_tokens"
        )
        log = plus.union(loose)
        low, high = counted.agg(F.min("doc_id"), F.max("doc_id")).first() if self.committed() else (None, None)
        if low is not None:
            ids = counted.select("doc_id").where("doc_id is not null").distinct()
            old = self._read("log", LOG).where((F.col("tokenizer_version") == self.version) & F.col("doc_id").between(low, high)).join(ids, "doc_id", "left_semi")
            live = old.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("n_tokens").alias("n_tokens")).where("docs > 0")
            log = log.union(live.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("n_tokens")).alias("n_tokens")))
        log.write.mode("overwrite").parquet(f"{self.root}/log/{batch}")
        release(self.spark, [x for x in scratch_paths() if x not in before])
        written = self.spark.read.schema(LOG).parquet(f"{self.root}/log/{batch}")
        sums = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sums/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all committed batches; groups without documents go."""
        sums = self._read("sums", SUMS).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
