"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``, whatever other columns there are beside them.

Rows of every stage: a null or letterless text goes in the first stage; nulls in other
columns, repeated rows and very long texts pass through; an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.decontamination import decontaminate
from codelode.llm.language_id import identify_language
from codelode.llm.ngram_join import ngram_jaccard_join
from codelode.llm.packing import best_fit_packing
from codelode.llm.secret_scan import redact_secrets
from codelode.session import load, materialize, release, scratch_folder, scratch_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders of the stage called last.
_last: list[str] = []


def stage(f: Stage) -> Stage:
    """Frees the scratch of the stage before: its result has been written by the time the next one gets its documents."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _last)
        before = set(scratch_paths())
        out = f(spark, docs, sf_dir)
        _last[:] = [x for x in scratch_paths() if x not in before]
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null, empty or letterless texts. A missing lang becomes the predicted one."""
    out = identify_language(docs, keep=True).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of 5-word Jaccard 0.8; rows that repeat it and rows without an id stay."""
    joined = ngram_jaccard_join(docs, k=5, num=80, den=100)
    gone = materialize(joined.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    small = F.broadcast(gone) if gone.count() <= 2_000_000 else gone
    return docs.join(small, "doc_id", "left_anti").select(*docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``; rows without an id stay, an empty benchmark drops none."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays, and n_chars follows its text."""
    return redact_secrets(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its place in a training sequence; no document gives no row."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: No SQL: tokenization, learned models and a genetic algorithm have no SQL form. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``. The stages' tables are deleted when the driver ends."""
    root = scratch_folder(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for number, (name, apply) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
