"""Product catalog: CSV scan, cleaning, lookup, sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from weft import vocab
from weft.functions.text import strip

# Numbers as a CSV reader takes them; Spark's cast alone also takes '1999d'.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"

# Spark writes the same file's address with one or three slashes.
SCHEME = "^[A-Za-z0-9]+:/+"


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All-text CSV scan with normalized headers and a file-order ``ordinal``.

    Files with line breaks inside quotes need ``multi_line``; without them pass
    False, so that Spark splits large files.
    """
    try:
        raw = (
            spark.read.option("header", True)
            .option("escape", '"')
            .option("multiLine", multi_line)
            .csv(path)
        )
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no catalog at {path}") from error
        raise
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return with_file_ordinal(named, raw, multi_line)


def with_file_ordinal(named: DataFrame, raw: DataFrame, one_split: bool = False) -> DataFrame:
    """Number rows in file order: file name first, then place in the file.

    Only the list of files reaches the driver. Rows are counted per split; a split's
    rows follow those of all splits before it, by file and place in the file.
    ``one_split`` says that files are not cut.
    """
    place = raw.withColumns(
        {
            "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id(),
        }
    ).toDF(*named.columns, "_file", "_block", "_row")
    files = sorted(raw.inputFiles())
    if len(files) == 1 and one_split:
        return place.withColumn("ordinal", F.col("_row")).drop("_file", "_block", "_row")
    names = [re.sub(SCHEME, "/", f) for f in files]
    ranks = named.sparkSession.createDataFrame(list(enumerate(names)), "_rank long, _file string")
    place = place.withColumn("_file", F.regexp_replace("_file", SCHEME, "/"))
    splits = place.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_rank", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    rank = F.coalesce("_rank", F.raise_error(F.concat(F.lit("unlisted file "), "_file")).cast("long"))
    starts = splits.join(ranks, "_file", "left").withColumn("_rank", rank).withColumn(
        "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))
    )
    return (
        place.join(starts.select("_file", "_block", "_first", "_start"), ["_file", "_block"])
        .withColumn("ordinal", F.col("_start") + F.col("_row") - F.col("_first"))
        .drop("_file", "_block", "_row", "_first", "_start")
    )


def check_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in vocab.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column in dataset: {', '.join(missing)}")
    return df


def number(name: str) -> Column:
    """Text to double; null for anything that is no number."""
    text = F.col(name).cast("string")
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def text(name: str) -> Column:
    """Stripped text; missing tokens become the empty string."""
    raw = F.col(name).cast("string")
    return F.when(raw.isNull() | raw.isin(*vocab.MISSING_TOKENS), F.lit("")).otherwise(
        strip(raw)
    )


def clean_catalog(raw: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Typed catalog: rows without a positive price go, ratings default, texts strip.

    ``observation`` receives the number of rows read and dropped.
    """
    check_columns(raw)
    typed = raw.withColumns(
        {
            "price_inr": number("price_inr"),
            "rating": F.coalesce(number("rating"), F.lit(vocab.DEFAULT_RATING)),
            **{c: text(c) for c in vocab.TEXT_COLUMNS},
        }
    )
    valid = F.coalesce(F.col("price_inr") > 0, F.lit(False))
    if observation is not None:
        typed = typed.observe(
            observation,
            F.count(F.lit(1)).alias("rows_read"),
            F.count_if(~valid).alias("rows_dropped"),
        )
    return typed.filter(valid)


def load_catalog(
    spark: SparkSession, path: str, multi_line: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Read and clean a CSV catalog; extra columns are kept."""
    return clean_catalog(read_csv(spark, path, multi_line), observation)


def first_rows(catalog: DataFrame, limit: int | None) -> DataFrame:
    """First ``limit`` rows in catalog order; all rows for no positive limit."""
    if not limit or limit <= 0:
        return catalog
    return catalog.orderBy("ordinal").limit(limit)


def product_by_id(catalog: DataFrame, product_id: str) -> DataFrame:
    """First row of one product, or no row."""
    return catalog.filter(F.col("product_id") == product_id).orderBy("ordinal").limit(1)


def products_by_id(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """First row of every wanted ``product_id``.

    The semi join narrows the catalog first; the aggregate keeps one row per id
    before its shuffle, so an id that fills much of the catalog stays cheap.
    """
    rows = catalog.join(wanted.select("product_id").distinct(), "product_id", "left_semi")
    first = rows.groupBy("product_id").agg(
        F.min_by(F.struct(*[c for c in catalog.columns if c != "product_id"]), "ordinal")
        .alias("row")
    )
    return first.select("product_id", "row.*").select(*catalog.columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
