"""Positions in a total order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small, written


def numbered(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """``df`` with ``pos``, the 0-based long position of each row among those of its ``group``
    (null is a group too, and the first) in ``order``. ``df`` is read twice and so should
    be a table.

    Rows are range-partitioned by group and order, so a group of any size is spread. Each
    partition numbers the runs of its groups while it streams through them; what precedes a
    run in other partitions is summed over one row per partition and group, and added."""
    by = [F.asc_nulls_first(group), *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    at = df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, seen = None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.asarray(batch.column(at).dictionary_encode().indices.fill_null(-1))
            new = np.concatenate([[True], code[1:] != code[:-1]])
            first = batch.column(at)[0].as_py()
            if number >= 0 and first == held:
                new[0] = False
            else:
                seen = 0
            run_no = number + np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            place = np.where(start >= 0, np.arange(len(new)) - start, np.arange(len(new)) + seen)
            held, number, seen = batch.column(at)[-1].as_py(), int(run_no[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run_no, pa.int64()), pa.array(place, pa.int64())], names=[*batch.schema.names, "__run", "__place"])

    schema = T.StructType([*sorted_.schema.fields, T.StructField("__run", T.LongType()), T.StructField("__place", T.LongType())])
    runs = written(sorted_.mapInArrow(run, schema), "numbered")
    sizes = runs.groupBy("__part", "__run").agg(F.first(group).alias("__group"), F.count("*").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select("__part", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__before")), "offsets")
    found = runs.join(small(offsets, offsets.count()), ["__part", "__run"])
    return found.select(*df.columns, (F.col("__before") + F.col("__place")).alias("pos"))
