"""Running totals inside keys of any size, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(df: DataFrame, key: str, chunk: Column, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the key that come before.

    Rows come in the order of their chunk and, inside a chunk, of ``order``. A chunk
    is a long that spreads a key's rows over tasks; totals of chunks are summed first,
    rows only inside their chunk. Null keys are a key like others.
    """
    rows = df.withColumns({"_chunk": chunk, "_value": value.cast("long"), "_key": F.struct(F.col(key))})
    totals = rows.groupBy("_key", "_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_key", "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_key", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    # The rows lie by key and chunk already, and a merge needs no table in the driver.
    return summed.join(starts.hint("merge"), ["_key", "_chunk"]).withColumn(name, F.col("_start") + F.col("_inside")).drop(
        "_key", "_chunk", "_value", "_start", "_inside"
    )


def spread(columns: list, chunks: int) -> Column:
    """A chunk number by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("long")
