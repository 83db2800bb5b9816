"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
_OWN: dict[str, str] = {}
_HELD: dict[str, Any] = {}
T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a local session gets a
    folder of its own for as long as it lives; on a cluster that would be lost to the others, so there it is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = _OWN.get(context.applicationId)
        if not found:
            kept = tempfile.TemporaryDirectory(prefix="tallow-")
            atexit.register(kept.cleanup)
            found = _OWN[context.applicationId] = kept.name
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: later steps neither recompute them nor depend on
    the executor that made them. `discard` frees the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallow-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    # Rows here hold whole texts, so a batch for Python is of fewer rows than is usual; the caller's setting comes back.
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._tallow_path = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialised rows that nothing will read again: all made from them is written by now."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tallow_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """After a large step whose rows are written: lets Spark's cleaner, which follows the driver's garbage collection, delete
    shuffle files that nothing refers to now rather than half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held(owner: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps for its next tasks of one operator. Only one operator's at a time is kept."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


def give_back(all_held: bool = False) -> None:
    """Returns what a Python worker has freed to the system, with `all_held` also what it keeps. Workers outlive their tasks,
    so what one held at its peak would count against all later ones."""
    if all_held:
        _HELD.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else as it is. Text of ASCII only takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
