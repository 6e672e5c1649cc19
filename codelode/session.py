"""Session helpers shared by every operator: table loading, shared scratch space, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one Arrow batch sent to Python.
ARROW_BYTES = 4 << 20
#: Scratch folders made by this driver process, oldest first.
_made: list[str] = []
_local_root: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder; only Spark's readers ever see the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a private one in local mode.

    Only a session whose tasks run in the driver's own process may leave the setting out
    (tests, local runs); any other would write to folders that its executors don't share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _local_root:
        root = tempfile.mkdtemp(prefix="codelode-")
        _local_root.append(f"file://{root}")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return _local_root[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a way that survives the loss of any executor, and the
    reread relation has exact size statistics for the planner.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted by ``release`` or when the driver ends."""
    path = f"{shared_dir(spark)}/codelode-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)  # only a path that exists can be marked
    files.deleteOnExit(target)
    files.delete(target, True)
    return path


def settled(spark: SparkSession, build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The table that ``build`` returns, written; all other scratch folders made meanwhile are deleted."""
    before = len(_made)
    out = materialize(build(), tag)
    release(spark, _made[before:-1])
    return out


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows (narrow ones: 8 to 32 bytes each).

    Meant for materialized tables, whose count reads file footers only. A larger
    table is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= rows else df


def scratch_paths() -> list[str]:
    """The scratch folders that this driver process has made and not released."""
    return list(_made)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders. Call only when nothing lazy still reads them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in _made:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            _made.remove(path)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application; keep their Arrow batches small.

    Texts differ in length by orders of magnitude, so batches are bounded in bytes too.
    """
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(context, "_codelode_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="codelode-src-")
    archive = os.path.join(folder, "codelode_src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._codelode_shipped = True
