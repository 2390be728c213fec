"""Tables that end a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one that the context was given.

    Only a session in one local process, as in tests, gets a temporary folder where none is set;
    executors on other machines would not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with the tables."""
    at = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
    _made.append((spark, at))
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    at = scratch(spark)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def newest(spark: SparkSession, folder: str) -> str | None:
    """The path in a folder that was changed last, the greatest name of equals; null if it is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return max(((x.getModificationTime(), x.getPath().toString()) for x in found), default=(0, None))[1]


def remove_tables() -> int:
    """Delete the tables that ``cut`` has written so far; call it when results are written. Runs at exit, too."""
    removed = 0
    while _made:
        spark, at = _made.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
        except (Py4JError, OSError, AttributeError):  # the session's process has ended
            return removed
    return removed


atexit.register(remove_tables)
