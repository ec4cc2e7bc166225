"""Tables written to the folder that all machines share, where a plan is cut or read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch that goes to Python, and of the rows of it that are worked on at once.
ARROW_BYTES, SLICE_BYTES = 8 << 20, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, only a local master gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as it is now: written as Parquet and read again, so what follows doesn't work it out once more, and lost executors don't either."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows, unless the session already has a tighter bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, str(ARROW_BYTES)))
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of batches, in order, a few at a time: as many as have so many bytes on average, one at least."""
    for batch in batches:
        n = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
