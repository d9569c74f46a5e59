"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wardstream", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the jobs expect; on a cluster use spark-submit."""
    cores = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WARDSTREAM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster a
    machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="wardstream-checkpoint-")
    context.setCheckpointDir(named)
    return named


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """At most so many rows, and about so many bytes, in an Arrow batch that a Python worker gets.

    One text can have hundreds of thousands of characters, and a worker holds several copies of
    a batch.  With the usual 10,000 rows and 64 MB its memory grows with the partitions of the input.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_FOLDERS: list[str] = []


@contextmanager
def tables_together(spark: SparkSession) -> Iterator[str]:
    """What ``cut_lineage`` writes inside the block lies in one folder, for ``drop_tables``."""
    _FOLDERS.append(f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4()}")
    try:
        yield _FOLDERS[-1]
    finally:
        _FOLDERS.pop()


def drop_tables(spark: SparkSession, folder: str) -> None:
    """Removes a folder that this library has written in the checkpoint folder, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to a new folder under the checkpoint folder and reads it back.

    Later readers take only the columns they need, and a lost executor costs no
    recomputation of what went before.
    """
    folder = _FOLDERS[-1] if _FOLDERS else ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
