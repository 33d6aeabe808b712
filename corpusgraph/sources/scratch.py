"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or names that are safe to broadcast.
BROADCAST_ROWS = 1_000_000

_made: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, so that it is neither computed again
    nor lost with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    # Spark removes the shuffle files behind it, which nothing reads any more, when the driver's garbage is collected
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The written table ``df`` with a broadcast hint if it has at most ``most`` rows, so that the
    other side of a join stays where it lies; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below ``spark.checkpoint.dir``; where the session names no such
    folder, below a temporary one, which is then set; that is an error unless the session
    runs on this machine alone."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(context.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all working folders that this application made, once its results have been read (results
    are lazy and read them); returns their number."""
    context = spark.sparkContext
    made = _made.pop(context.applicationId, [])
    for path in made:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(made)
