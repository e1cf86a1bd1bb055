"""Relational forms of the sequence steps: runs, ranks and lookups over sentence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, group: list[str], order: list[str], keys: list[str], out: str = "run") -> DataFrame:
    """Number the runs of equal keys in each group's order, from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    start = (changed | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_start", start).withColumn(out, F.sum("_start").over(w)).drop("_start")


def drop_adjacent(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Keep the first row of every run of one key."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = (F.row_number().over(w) == 1) | ~F.col(key).eqNullSafe(F.lag(key).over(w))
    return df.withColumn("_first", first).filter("_first").drop("_first")


def segment_ids(df: DataFrame, group: list[str], order: str, key: Column, out: str = "segment_id") -> DataFrame:
    """Rank keys by where they come first in their group, from 1."""
    df = df.withColumn("_key", key)
    df = df.withColumn("_first", F.min(order).over(Window.partitionBy(*group, "_key")))
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*group).orderBy("_first"))).drop("_key", "_first")


def interval_lookup(points: DataFrame, spans: DataFrame, group: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with the span of its group that holds it (both ends belong to it)."""
    return points.join(spans, group).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
