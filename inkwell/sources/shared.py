"""The folder that every machine sees, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes of them, that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_written: list[str] = []
_own: dict[str, str] = {}  # folders of sessions that name none


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a local one of its own
    (tests); any other is refused, as its machines would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; it stays until ``release``."""
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that go to Python meanwhile go in Arrow batches of BATCH_ROWS and about BATCH_BYTES at most.

    A batch stands in the executor and in its worker at once, several times over
    where it grows; ten thousand texts, as many as Spark sends, are of any size.
    """
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    was = {name: spark.conf.get(name, None) for name in most}
    for name, value in most.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later jobs read the files instead of computing ``df`` again, whichever
    executors are lost meanwhile. The files stay until ``release``.
    """
    path = f"{new_folder(df.sparkSession)}/{tag}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the folders of all tables that this process has written; DataFrames that read them can't be used any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)
