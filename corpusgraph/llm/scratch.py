"""Shared working storage, size-checked broadcasts and private names for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long, long) width that are safe to broadcast: about 100 MB as a hash table.
BROADCAST_ROWS = 1_000_000
#: A key with more rows than this is joined apart from the others (see ``spread_join``).
HEAVY = 5_000

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests), a temporary
    folder is made and set as the checkpoint folder; on a cluster that is an error, as
    executors would not see it.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder; ``clear`` removes it."""
    path = f"{shared_dir(spark)}/corpusgraph-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: lost executors cost a reread, not a recomputation.
    """
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete one working folder that nothing reads any more."""
    _remove(spark, path)
    _made.get(spark.sparkContext.applicationId, []).remove(path)


def clear(spark: SparkSession) -> int:
    """Delete all working folders that this application made, once its results have been
    read (results are lazy and read them); returns their number."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        _remove(spark, path)
    return len(made)


def small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are at most ``most``;
    beyond that Spark's shuffle joins (with adaptive skew handling) take over."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def spread_join(rows: DataFrame, keys: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with the written table ``keys``, one row for each value of ``on``
    with the number ``n`` of rows that have it. Values of more than ``HEAVY`` rows are
    few (rows / HEAVY) and joined by broadcast, so none of them is dealt to one task."""
    many = keys.where(F.col("n") > HEAVY)
    n_many = many.count()
    rest = keys.drop("n")
    if not n_many:
        return rows.join(rest, on, how)
    heavy = small(many.drop("n"), n_many)
    light = rows.join(heavy.select(on), on, "left_anti").join(keys.where(F.col("n") <= HEAVY).drop("n"), on, how)
    return rows.join(heavy, on).unionByName(light)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, for columns that an operator adds for a while."""
    held = {x.lower() for x in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def unit(*columns: str) -> Column:
    """A 16-byte digest of the values of ``columns``, nulls apart from empty values. Rows of
    one unit are copies of one another in these columns."""
    plain = lambda x: F.coalesce(F.concat(F.lit("+"), F.md5(F.col(f"`{x}`").cast("string"))), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("|", *map(plain, columns))))
