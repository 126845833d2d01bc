"""Places that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder that the session has been given. Without either it raises, but for a
    session that is one process: that gets a folder of its own, which ends with it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    at = sc._jsc.sc().getCheckpointDir()
    if path and at.isEmpty():
        sc.setCheckpointDir(path)
    if not path:
        if at.isEmpty():
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="remembra-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            sc.setCheckpointDir(own)
            at = sc._jsc.sc().getCheckpointDir()
        path = at.get()
    return path.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the workspace, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """For tasks that read and write files of the shared folder themselves: its file system, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def tidy(spark: SparkSession, records: int | None = None) -> Iterator[None]:
    """Spark removes the shuffle files of what is executed in here as soon as it is over, not when the driver's garbage is collected.

    records: rows that are read and go to Python at once, for those that hold much; by default Spark takes thousands.
    """
    at_once = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    settings = {_CLEANUP: "true"} | ({k: str(records) for k in at_once} if records else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, path: str, records: int | None = None) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends there, and no executor's loss can undo it. records: see tidy."""
    with tidy(df.sparkSession, records):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark's expressions have it: whatever it holds, dots too."""
    return "`" + name.replace("`", "``") + "`"


def held(names: list[str]) -> Column:
    """A struct of columns, so that they pass through Python whatever their names; see released."""
    return (F.struct(*(F.col(quoted(c)) for c in names)) if names else F.struct(F.lit(True).alias("none"))).alias("__row")


def released(names: list[str]) -> list[Column]:
    """The columns of held, by themselves."""
    return [F.col("__row").getField(c).alias(c) for c in names]
