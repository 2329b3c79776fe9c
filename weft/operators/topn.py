"""Top-n per key without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank",
    own_n: Column | None = None, merge_tasks: int | None = None,
) -> DataFrame:
    """Rows ranked 1..n per key, in ``order``.

    ``n`` is a literal, so every task cuts each key to n rows before the shuffle
    (the plan's window group limit): a hot key sends n rows per task, however
    many it has. ``own_n`` is a smaller limit per row. Where n times the number of
    tasks is still much for one reducer, ``merge_tasks`` merges the rows of that
    many groups of tasks first.
    """
    if merge_tasks:
        local = Window.partitionBy(*keys, "_group").orderBy(*order)
        df = (
            df.withColumn("_group", F.spark_partition_id() % merge_tasks)
            .withColumn("_local", F.row_number().over(local))
            .filter(F.col("_local") <= n)
            .drop("_local", "_group")
        )
    total = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(total)).filter(F.col(rank) <= n)
    return ranked if own_n is None else ranked.filter(F.col(rank) <= own_n)
