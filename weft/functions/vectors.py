"""Dense vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    length = norm(vector)
    return let(
        F.when(length == 0, 1.0).otherwise(length),
        lambda n: F.transform(vector, lambda x: x.cast("double") / n),
    )


def fit_length(vector: Column, length: int) -> Column:
    """Cut or zero-pad to ``length`` entries."""
    missing = F.greatest(F.lit(length) - F.size(vector), F.lit(0))
    zero = F.array_repeat(F.lit(0.0), missing)
    return F.concat(F.slice(F.transform(vector, lambda x: x.cast("double")), 1, length), zero)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine, for unit vectors."""
    return 1.0 - dot(a, b)


def densify(ids: Column, weights: Column, length: int) -> Column:
    """Sparse (sorted 0-based ids, weights) to a dense array of ``length``.

    Ids beyond the length are cut off, as ``fit_length`` does.
    """
    places = F.sequence(F.lit(0), F.lit(length - 1))
    return let(
        F.map_from_arrays(ids, weights),
        lambda lookup: F.transform(
            places, lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(0.0))
        ),
    )


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int | None:
    """Length that all vectors of a table share; None without vectors, an error if lengths differ."""
    least, most = vectors.select(F.size(column).alias("n")).agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} numbers; all need the same length")
    return least
