"""Partitioned top-n cuts with an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    held = {x.lower() for x in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based row number per key (a long)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top(df: DataFrame, keys: list[str], order: list[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; Spark pushes the limit below the shuffle."""
    return ranked(df, keys, order, name).where(F.col(name) <= n)


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, without its rank."""
    name = unused(df, "rank")
    return top(df, keys, order, 1, name).drop(name)
