"""Joins between a table of constraints and a much larger table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weft.session import cut_lineage

BROADCAST_BYTES = 64 << 20
ANY = "*"
OWN = "="  # before a value, so that no value equals ANY
# A task pairs so many products with all asks of their category.
PRODUCTS_PER_TASK = 4096
# A key of more pairs than this, and than its share of the tasks, is cut.
PAIRS_PER_CELL = 1 << 20
CELLS_PER_TASK = 2


@dataclass(frozen=True)
class Measure:
    """Row count and text size of a table, taken once in one small job."""

    rows: int
    bytes: int
    most: int | None = None

    @property
    def small(self) -> bool:
        return 2 * self.bytes + 256 * self.rows <= BROADCAST_BYTES


def measure(df: DataFrame, most: str | None = None) -> Measure:
    """Size of a table, and the greatest value of its column ``most``."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(
            F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)
        ).alias("bytes"),
        (F.max(most) if most else F.lit(None).cast("int")).alias("most"),
    ).first()
    return Measure(row["rows"], row["bytes"], row["most"])


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that hold at most about ``rows`` of a table's rows, and at least the usual number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


#: Terms that hold by plain equality alone.
EQUAL_TERMS = ("category", "brand")


def cut_keys(asks: DataFrame, products: DataFrame, tasks: int) -> DataFrame:
    """(_key, _asks, _products): how many parts each side of a key of many pairs is cut into.

    Each part of the asks meets each part of the products in a cell of its own. Cells hold
    about equal numbers of pairs, and of their possible shapes the one that copies the
    fewest rows. Fewer than ``CELLS_PER_TASK`` times ``tasks`` keys are listed; others stay whole.
    """
    counts = [d.groupBy("_key").agg(F.count(F.lit(1)).cast("double").alias(n)) for d, n in ((asks, "_n"), (products, "_m"))]
    sizes = cut_lineage(counts[0].join(counts[1].hint("merge"), "_key").withColumn("_pairs", F.col("_n") * F.col("_m")), "keys")
    most = F.greatest(F.col("_all") / (CELLS_PER_TASK * tasks), F.lit(float(PAIRS_PER_CELL)))
    whole = sizes.agg(F.sum("_pairs").alias("_all"))
    cut = sizes.crossJoin(F.broadcast(whole)).withColumn("_most", most).filter("_pairs > _most")
    cells = cut.withColumn("_cells", F.ceil(F.col("_pairs") / F.col("_most")).cast("double"))
    parts = F.least(F.col("_cells"), F.greatest(F.lit(1.0), F.round(F.sqrt(F.col("_cells") * F.col("_m") / F.col("_n")))))
    return cells.withColumn("_products", parts.cast("int")).select(
        "_key", F.ceil(F.col("_cells") / F.col("_products")).cast("int").alias("_asks"), "_products"
    )


def join_by_category(
    asks: DataFrame, products: DataFrame, condition: Column, want: str, size: Measure,
    spread: str, salts: int | None = None, equal: tuple[str, ...] = EQUAL_TERMS, tasks: int | None = None,
) -> DataFrame:
    """Pairs of an ask and a folded product that meet ``condition``.

    An equi join on category and brand, or those of them that ``condition`` holds to
    (``equal``): products appear under their own values and under ``*`` for asks without
    one, in the combinations that the asks use. The products are spread evenly by the
    ``spread`` column first, over ``tasks``, because a few bytes of products can make many
    pairs. A measured-small ask table is then broadcast. Of a large one, a key of more pairs
    than its share of the tasks is cut on both sides, and only the rows of such a key are
    copied. ``salts`` cuts the products of every key in that many parts instead.
    """
    asked = [F.col(f"{want}.{t}") for t in equal]
    used = asks.select(*[a.isNotNull().alias(t) for a, t in zip(asked, equal)]).distinct().collect()

    def key(values: list[Column]) -> Column:
        """Length first, so that no two sets of values make one text."""
        parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(OWN), v), F.lit(ANY)) for v in values]
        return F.concat(*parts)

    none = F.lit(None).cast("string")
    keyed = asks.withColumn("_key", key(asked))
    combinations = [
        F.when(
            F.lit(True) if not any(u) else F.concat(*[F.col(t) for t, on in zip(equal, u) if on]).isNotNull(),
            key([F.col(t) if on else none for t, on in zip(equal, u)]),
        )
        for u in used
    ]
    keys = F.explode(F.array_compact(F.array(*combinations)) if used else F.array().cast("array<string>"))
    usual = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size.small:
        both = products.repartition(tasks or usual, spread).withColumn("_key", keys)
        return both.join(F.broadcast(keyed), "_key").filter(condition).drop("_key")
    both = products.withColumn("_key", keys)
    tasks = max(tasks or 0, usual)
    if salts:
        sides = [d.withColumns({"_asks": F.lit(1), "_products": F.lit(salts)}) for d in (keyed, both)]
    else:
        cut = F.broadcast(cut_keys(keyed.select("_key"), both.select("_key"), tasks))
        sides = [d.join(cut, "_key", "left").fillna(1, ["_asks", "_products"]) for d in (keyed, both)]
    row = F.pmod(F.xxhash64(*asks.columns), F.col("_asks")).cast("int") * F.col("_products")
    column = F.pmod(F.xxhash64(spread), F.col("_products")).cast("int")
    cells = [
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_products") - 1), lambda j: row + j)),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_asks") - 1), lambda i: i * F.col("_products") + column)),
    ]
    # As many tasks as asked for, however few bytes they read: their pairs take the time.
    keyed, both = (
        d.withColumn("_cell", c).drop("_asks", "_products").repartition(tasks, "_key", "_cell") for d, c in zip(sides, cells)
    )
    return both.join(keyed.hint("merge"), ["_key", "_cell"]).filter(condition).drop("_key", "_cell")
