"""Shared folders, materialised tables and Arrow access for the operators here."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python; long texts then come a few at a time.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows, unless the session already has a tighter bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, str(ARROW_BYTES)))
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It is below spark.checkpoint.dir. Where that is unset, a local master gets a
    temporary folder and a cluster gets an error, since its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for paths in _recorded:
        paths.append(path)
    return path


#: Lists that get the path of every folder made.
_recorded: list[list[str]] = []


def written_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written; all tables that were written on the way are deleted."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        out = materialise(make())
    finally:
        _recorded.remove(paths)
    for path in paths[:-1]:
        _remove(spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to a shared folder and read it again: a cut of the lineage that lost executors don't undo.

    The shuffle files of that write go as soon as it ends, since nothing else reads them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Delete the folder of a materialised table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        _remove(df.sparkSession, files[0].rpartition("/")[0])


def give_back() -> None:
    """Return the memory of what a task has dropped; Spark keeps its Python workers, and they would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blobs(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column, null as empty."""
    for value in column:
        yield value.as_py() or b""


def text_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text as UTF-8 bytes under fixed names, whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
