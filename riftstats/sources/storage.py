"""Taking little disk while much is written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Of an execution that has ended no shuffle files stay. Partitioned writes keep a
#: writer open for each of so many partitions instead of sorting their rows, which
#: spills; a task's writers hold no more than the task's own rows. Rows that are in
#: order of a key are grouped as they are, not sorted once more.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "64", "spark.sql.execution.replaceHashWithSortAgg": "true"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """What is written within takes no disk besides what it writes, once it is there."""
    was = {k: spark.conf.get(k, None) for k in LEAN}
    try:
        for k, v in LEAN.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def taken(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of rows that a job wrote for itself, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
