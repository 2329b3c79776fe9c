"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weft.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node with an edge; component is the least node reachable.

    Alternating large and small stars: each round moves edges toward the least
    neighbour, so the number of rounds is logarithmic and no task holds a
    component. Nulls and self edges are ignored; direction and repeats don't matter.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    stars = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter((a != b)).distinct(),
        "edges",
    )
    before = _state(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        stars = cut_lineage(small.filter("u != v").distinct(), "edges")
        after = _state(stars)
        if after == before:
            break
        before = after
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes over edges a-b, by label passing."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label
