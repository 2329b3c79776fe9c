"""Audits over catalogs, results and check outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft import vocab
from weft.functions.vectors import norm

VALUE_COLUMNS = ("category", "brand", "gender", "color", "fit", "material")
PRICE_MARKS = (6000, 10000, 20000)


def catalog_profile(catalog: DataFrame) -> DataFrame:
    """One row: size, missing fields, duplicate ids, prices, counts above marks.

    Ids are counted per id first, so no task sees all of one id's rows.
    """
    price = F.col("price_inr")
    per_id = catalog.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in vocab.REQUIRED_COLUMNS],
        F.count_if(price <= 0).alias("bad_prices"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.sum(price).alias("sum_price"), F.count(price).alias("priced"),
        *[F.count_if(price > m).alias(f"above_{m}") for m in PRICE_MARKS],
    )
    sums = [
        *[f"missing_{c}" for c in vocab.REQUIRED_COLUMNS], "bad_prices",
        *[f"above_{m}" for m in PRICE_MARKS],
    ]
    return per_id.agg(
        F.sum("rows").alias("products"),
        (F.sum("rows") - F.count(F.lit(1))).alias("duplicate_ids"),
        F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        F.round(F.sum("sum_price") / F.sum("priced"), 2).alias("avg_price"),
        *[F.sum(c).alias(c) for c in sums],
    )


def value_counts(catalog: DataFrame, columns: tuple[str, ...] = VALUE_COLUMNS) -> DataFrame:
    """(column_name, value, products): every distinct value of the given columns."""
    # One pass: each row becomes one entry per column, summed before the shuffle.
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]
    )
    return (
        catalog.select(F.explode(entries).alias("e")).select("e.*")
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("products"))
    )


def distinct_counts(values: DataFrame) -> DataFrame:
    """Number of distinct values per column, from ``value_counts``."""
    return values.filter(F.col("value").isNotNull()).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values")
    )


def sorted_values(values: DataFrame) -> DataFrame:
    """Distinct values in order, as rows sorted across the cluster."""
    return values.orderBy("column_name", "value")


def latency_summary(timings: DataFrame, column: str) -> DataFrame:
    """Mean and interpolated 95th percentile.

    Equal timings are counted first; the percentile weighs each value by count.
    """
    counted = timings.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(
        F.sum("_n").alias("queries"),
        F.round(F.sum(F.col(column) * F.col("_n")) / F.sum("_n"), 2).alias("mean_latency"),
        F.round(F.percentile(column, F.lit(0.95), F.col("_n")), 2).alias("p95_latency"),
    )


def violations(want: str = "ask") -> dict[str, Column]:
    """Hard constraints an item breaks."""

    def wanted(name: str) -> Column:
        return F.col(f"{want}.{name}")

    broken = {
        "over_price": F.col("price_inr") > wanted("max_price"),
        "under_price": F.col("price_inr") < wanted("min_price"),
        "wrong_category": F.lower("category") != F.lower(wanted("category")),
        "wrong_gender": ~F.lower("gender").isin(vocab.ANY_GENDER)
        & (F.lower("gender") != F.lower(wanted("gender"))),
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in broken.items()}


def violation_audit(items: DataFrame, key: str = "request_id", want: str = "ask") -> DataFrame:
    """Per request: items, broken constraints of each kind, duplicate products."""
    return (
        items.groupBy(key, "product_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(test).alias(name) for name, test in violations(want).items()],
        )
        .groupBy(key)
        .agg(
            F.sum("_rows").alias("items"),
            (F.sum("_rows") == F.count(F.lit(1))).alias("unique_products"),
            *[F.sum(name).alias(name) for name in violations(want)],
        )
    )


def filter_accuracy(audit: DataFrame, tested: Column) -> DataFrame:
    """Accuracy in percent: failures are broken constraints of any kind."""
    kinds = list(violations())
    total = audit.agg(
        F.coalesce(F.sum(sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))), F.lit(0)).alias("fails"),
        tested.cast("long").alias("tested"),
    )
    share = 1 - F.col("fails") / F.greatest(F.lit(1), F.col("tested"))
    return total.select(
        "tested", "fails",
        F.when(F.col("fails") == 0, 100.0).otherwise(F.round(share * 100, 2)).alias("accuracy_pct"),
    )


def no_match_rate(diagnostics: DataFrame) -> DataFrame:
    """Share of requests without items, and of requests without any hit."""
    return diagnostics.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("count") == 0).alias("without_items"),
        F.count_if(F.col("retrieved_chunks_count") == 0).alias("without_evidence"),
        F.round(F.count_if(F.col("count") == 0) / F.count(F.lit(1)), 4).alias("no_match_rate"),
    )


def check_summary(
    checks: DataFrame, tolerated: int = 0, digits: int = 0, otherwise: str = "PARTIAL"
) -> DataFrame:
    """Totals and status of a table of checks with a boolean ``passed``."""
    counted = checks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    )
    rate = F.format_string(f"%.{digits}f%%", F.col("passed") * 100.0 / F.col("total"))
    good = F.col("passed") >= F.col("total") - tolerated
    return counted.select(
        "total", "passed", (F.col("total") - F.col("passed")).alias("failed"),
        rate.alias("pass_rate"), F.when(good, "PASS").otherwise(otherwise).alias("status"),
    )


def vector_audit(vectors: DataFrame, column: str) -> DataFrame:
    """Lengths and norms of a vector column."""
    size, length = F.size(column), norm(F.col(column))
    measured = vectors.select(size.alias("_size"), length.alias("_norm"))
    return measured.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.min("_size").alias("min_length"), F.max("_size").alias("max_length"),
        F.round(F.min("_norm"), 4).alias("min_norm"), F.round(F.max("_norm"), 4).alias("max_norm"),
        F.count_if(F.abs(F.col("_norm") - 1) > 1e-4).alias("not_unit"),
    )


def covers(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values that only one of two tables holds; no rows means both cover each other."""
    ours = left.select(column).distinct().withColumn("_left", F.lit(True))
    theirs = right.select(column).distinct().withColumn("_right", F.lit(True))
    return ours.join(theirs, column, "full").filter(
        F.col("_left").isNull() | F.col("_right").isNull()
    ).select(column, F.when(F.col("_left").isNull(), "right").otherwise("left").alias("only_in"))
