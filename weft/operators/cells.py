"""Cells of a catalog: products that an equi join finds for a search, price bounds included.

A *cell* is a set of terms with their values (color blue and fit slim); the products
of a search are those of its cells: one, or several disjoint ones where a term also
admits a common value (unisex, all-season). Prices are cut at the bounds that the
searches ask for, and the pieces are joined pairwise into a binary tree of *nodes*; a
search's range is at most two nodes per level. So whatever is known per (cell, node),
a count or a short list, answers all searches by equality, and no search meets
products one by one.

Cells are made for the term sets that the searches use, at most 256, and only those
asked for are kept. The bounds and the subcategory words asked for travel as one row;
``plan_cells`` measures them first and gives None where they are too many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft import vocab
from weft.functions.predicates import ALL_TERMS, NUMBER_TERMS
from weft.operators.joins import measure
from weft.session import default_salts

TEXT_TERMS = tuple(t for t in ALL_TERMS if t not in NUMBER_TERMS)
COMMON_VALUES = {"gender": vocab.ANY_GENDER, "season": vocab.ANY_SEASON}
MOST_BOUNDS = 1 << 18
MOST_WORDS = 1 << 12
KEY = ("cell", "level", "node")


@dataclass(frozen=True)
class Cells:
    """What the searches ask for: one row of sorted bounds and words, and their numbers."""

    asked: DataFrame
    lows: int
    highs: int
    masks: tuple[int, ...]

    @property
    def levels(self) -> int:
        return (self.lows + self.highs).bit_length()


def term_mask(values: dict[str, Column]) -> Column:
    """Bit i is set where ``TEXT_TERMS[i]`` is asked for."""
    mask = F.lit(0)
    for i, term in enumerate(TEXT_TERMS):
        mask = mask + F.when(values[term].isNotNull(), 1 << i).otherwise(0)
    return mask


def plan_cells(asks: DataFrame, masks: Column, want: str = "used") -> Cells | None:
    """Facts of a table of folded terms; ``masks`` is an array of the term sets that each row is to meet."""
    low, high, word = (F.col(f"{want}.{t}") for t in ("min_price", "max_price", "subcategory"))
    found = asks.withColumn("_mask", F.explode(masks)).agg(
        F.count_distinct(low).alias("lows"), F.count_distinct(high).alias("highs"),
        F.count_distinct(word).alias("words"), F.collect_set("_mask").alias("masks"),  # at most 256 numbers
    ).first()
    if found["lows"] + found["highs"] > MOST_BOUNDS or found["words"] > MOST_WORDS:
        return None
    row = asks.agg(
        *[F.sort_array(F.collect_set(c)).alias(n) for c, n in ((low, "_lows"), (high, "_highs"), (word, "_words"))]
    )
    return Cells(row, found["lows"], found["highs"], tuple(sorted(found["masks"])))


def _up_to(values: Column, price: Column, count: int, strict: bool) -> Column:
    """How many of ``count`` sorted values are at most (or below) the price, by halving steps."""
    if not count:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(count.bit_length() - 1, -1, -1)])

    def step(at: Column, by: Column) -> Column:
        value = F.try_element_at(values, at + by)
        return F.when((value < price) if strict else (value <= price), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def cell_name(mask: Column, values: list[Column]) -> Column:
    """Term set and values as one text; lengths keep it unique."""
    parts = [part for v in values for part in (F.length(v).cast("string"), v)]
    return F.concat_ws(":", mask, *parts)


def price_piece(price: Column, cells: Cells) -> Column:
    """Place of a price among the pieces: low bounds at or under it and high bounds under it."""
    return _up_to(F.col("_lows"), price, cells.lows, False) + _up_to(F.col("_highs"), price, cells.highs, True)


def _range_nodes(cells: Cells) -> Column:
    """Nodes that make up pieces ``_from`` to ``_to``; level -1 holds products without a price too."""
    left = "shiftright(_from + shiftleft(1, l) - 1, l)"
    right = "shiftright(_to + 1, l)"
    inner = f"""flatten(transform(sequence(0, {cells.levels}), l -> concat(
        if({left} % 2 = 1 and {left} < {right}, array(struct(l as level, {left} as node)), array()),
        if({right} % 2 = 1 and {left} + {left} % 2 < {right}, array(struct(l as level, {right} - 1 as node)), array()))))"""
    return F.expr(f"if(_open, array(struct(-1 as level, 0 as node)), {inner})")


def ask_nodes(asks: DataFrame, values: dict[str, Column], low: Column, high: Column, cells: Cells) -> DataFrame:
    """``asks`` with a row per (cell, level, node) whose products together are the ask's.

    ``values`` gives the value of each text term, null where it is not asked for.
    """
    rows = asks.withColumns({f"_{t}": values[t] for t in TEXT_TERMS}).withColumns({"_low": low, "_high": high})
    rows = rows.withColumn("_mask", term_mask({t: F.col(f"_{t}") for t in TEXT_TERMS}).cast("string"))
    for term, common in COMMON_VALUES.items():
        own = F.col(f"_{term}")
        rows = rows.withColumn(f"_{term}", F.explode(F.when(own.isNull(), F.array(own)).otherwise(F.array_distinct(F.array(own, F.lit(common))))))
    rows = rows.withColumn("cell", cell_name(F.col("_mask"), [F.coalesce(f"_{t}", F.lit("")) for t in TEXT_TERMS]))
    rows = rows.crossJoin(F.broadcast(cells.asked)).withColumns(
        {
            "_open": F.col("_low").isNull() & F.col("_high").isNull(),
            "_from": F.when(F.col("_low").isNull(), 0).otherwise(price_piece(F.col("_low"), cells)),
            "_to": F.when(F.col("_high").isNull(), cells.lows + cells.highs).otherwise(price_piece(F.col("_high"), cells)),
        }
    )
    return rows.withColumn("_at", F.explode(_range_nodes(cells))).select(*asks.columns, "cell", "_at.level", "_at.node")


def product_nodes(products: DataFrame, asked: DataFrame, cells: Cells, *also: str) -> DataFrame:
    """Folded products with each asked (cell, level, node) that holds them, and the columns ``also`` of ``asked``.

    ``asked`` has distinct rows; it is broadcast where its measured size is small.
    """
    kept, small = products.columns, measure(asked).small
    # A few bytes of products make many rows, so they are spread first.
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = products.repartition(tasks, "product_id").crossJoin(F.broadcast(cells.asked)).withColumns(
        {
            "_piece": F.when(F.col("price_inr").isNotNull(), price_piece(F.col("price_inr"), cells)),
            "_said": F.filter("_words", lambda w: F.contains(F.col("subcategory"), w)),
        }
    ).drop("_lows", "_highs", "_words")
    rows = rows.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in cells.masks])))
    parts = []
    for i, term in enumerate(TEXT_TERMS):
        used = F.col("_mask").bitwiseAND(1 << i) != 0
        if term == "subcategory":
            rows = rows.withColumn("_word", F.explode(F.when(used, F.col("_said")).otherwise(F.array(F.lit("")))))
            parts.append(F.col("_word"))
        else:
            rows = rows.filter(~used | F.col(term).isNotNull())
            parts.append(F.when(used, F.col(term)).otherwise(""))
    rows = rows.withColumn("cell", cell_name(F.col("_mask").cast("string"), parts))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    levels = F.expr(
        f"""concat(array(struct(-1 as level, 0 as node)), if(_piece is null, array(),
        transform(sequence(0, {cells.levels}), l -> struct(l as level, shiftright(_piece, l) as node))))"""
    )
    rows = rows.join(side(asked.select("cell").distinct()), "cell", "left_semi")
    rows = rows.withColumn("_at", F.explode(levels)).select(*kept, "cell", "_at.level", "_at.node")
    return rows.join(side(asked.select(*KEY, *also)), list(KEY)).select(*kept, *KEY, *also)


def count_products(questions: DataFrame, products: DataFrame, cells: Cells, keys: list[str]) -> DataFrame:
    """(keys, products): how many products the nodes of each key hold.

    ``questions`` are ``keys`` with the columns of ``ask_nodes``.
    """
    asked = questions.select(*KEY).distinct()
    counts = product_nodes(products, asked, cells).groupBy(*KEY).agg(F.count(F.lit(1)).alias("products"))
    return questions.join(counts, list(KEY)).groupBy(*keys).agg(F.sum("products").alias("products"))


def leading_products(products: DataFrame, asked: DataFrame, cells: Cells, salts: int | None = None) -> DataFrame:
    """Products of each asked node that can be among the first ``need`` of a search there.

    ``asked`` has the node, ``style_place`` and ``need``. Products of a node agree in all
    terms of its cell, so among those that show the style, or don't, a higher boost is
    never worse, and of equal boosts the earlier position is first. Scores are rounded
    to 4 digits: a boost two steps of 0.0001 higher always wins, a nearer one may tie. So a
    product is out behind ``need`` of equal boost, or ``need`` two steps higher.
    ``place`` and ``ahead`` tell how many, for searches that need fewer. Salted groups
    are cut first, so that a node that holds all products is not one task.
    """
    salts = salts or default_salts(products.sparkSession)
    rows = product_nodes(products, asked, cells, "style_place", "need").withColumns(
        {
            "shows": F.coalesce(F.getbit("styles", "style_place") == 1, F.lit(False)),
            "_step": F.floor(F.col("boost") * 10_000), "_salt": F.pmod(F.xxhash64("position"), F.lit(salts)),
        }
    )
    group = [*KEY, "style_place", "shows"]

    def cut(df: DataFrame, *also: str) -> DataFrame:
        same = Window.partitionBy(*group, *also, "boost").orderBy("position")
        higher = Window.partitionBy(*group, *also).orderBy(F.desc("_step")).rangeBetween(Window.unboundedPreceding, -2)
        df = df.withColumn("place", F.row_number().over(same)).filter("place <= need")
        return df.withColumn("ahead", F.count(F.lit(1)).over(higher)).filter("ahead < need")

    return cut(cut(rows, "_salt").drop("place", "ahead")).drop("_step", "_salt", "need", "shows")
