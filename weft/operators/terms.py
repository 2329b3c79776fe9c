"""Term weights: tokens, corpus frequencies, vocabulary, unit TF-IDF rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import log, sqrt

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from weft import vocab
from weft.functions.text import UNICODE
from weft.functions.vectors import densify, unit

# Whole runs of two or more word characters; plain letters are listed first, as they are told fastest.
TOKEN = UNICODE + r"[a-z0-9\w][a-z0-9\w]+"
# A task counts the terms of about this many bytes of text, and so many distinct terms at once.
TASK_BYTES = 4 << 20
MOST_COUNTED = 200_000
MERGE_TASKS = 64
# Rows that go back to Spark at once.
BATCH_ROWS = 50_000


def terms_of(text: Column, stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS) -> Column:
    """Words and word pairs of a text, stop words left out first."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def text_tasks(df: DataFrame, text: str) -> int:
    """Tasks for the terms of all texts: more with more text, so that none holds more."""
    spark = df.sparkSession
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()["bytes"]
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _words(text: Column, stop_words: tuple[str, ...]) -> Column:
    return F.coalesce(terms_of(text, stop_words), F.array().cast("array<string>")).alias("_words")


def _placed_words(
    df: DataFrame, key: str, text: str, stop_words: tuple[str, ...], tasks: int | None
) -> DataFrame:
    """(key, words), the texts of a key next to each other in one task.

    The texts move once, by key, before anything is read from them, so tokens spread
    evenly however the files were cut.
    """
    placed = df.select(key, F.col(text).alias("_text")).repartition(tasks or text_tasks(df, text), key)
    return placed.sortWithinPartitions(key).select(key, _words(F.col("_text"), stop_words))


def _values(column: pa.Array) -> list:
    """Texts or numbers without nulls as a list."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _kind(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """Type of the first column, and the batches."""
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.column(0).type, chain([first], batches))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Counter, int]]:
    """Each key of sorted rows with the counts of its words and neighbour pairs, and its number of rows."""
    key, counts, rows = None, None, 0
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            keys, words = whole.slice(start, 256).columns[:2]
            every = _values(words.flatten())
            end = 0
            for own, count in zip(keys.to_pylist(), words.value_lengths().to_pylist()):
                found, end = every[end : end + count], end + count
                if counts is None or own != key:
                    if counts is not None:
                        yield key, counts, rows
                    key, counts, rows = own, Counter(), 0
                rows += 1
                counts.update(found)
                counts.update([f"{a} {b}" for a, b in zip(found, found[1:])])
    if counts is not None:
        yield key, counts, rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Counter]]:
    """``_runs`` without the numbers of rows."""
    for key, counts, _ in _runs(batches):
        yield key, counts


def document_terms(
    df: DataFrame, key: str, text: str,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS, tasks: int | None = None,
) -> DataFrame:
    """(key, term, tf); a key without terms keeps one row with a null term.

    ``tasks`` is what ``text_tasks`` measured, where the caller knows it already.
    """
    rows = _placed_words(df, key, text, stop_words, tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind).take(pa.array(places, pa.int32())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())],
                [key, "term", "tf"],
            )

        kind, batches = _kind(batches)
        keys, places, terms, tfs = [], [], [], []
        for own, counts in _counted(batches):
            if not counts:
                counts = {None: 1}
            places.extend([len(keys)] * len(counts))
            keys.append(own)
            terms.extend(counts.keys())
            tfs.extend(counts.values())
            if len(terms) >= BATCH_ROWS:
                yield batch()
                keys, places, terms, tfs = [], [], [], []
        if keys:
            yield batch()

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(count, f"{key} {kind}, term string, tf long")


COUNTS = "term string, total long, documents long"


def _totals(found: Iterator[tuple[list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: terms, each once per text, and their counts there."""
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64()),
             pa.array([texts[t] for t in totals], pa.int64())],
            ["term", "total", "documents"],
        )

    totals, texts = {}, Counter()
    for terms, tfs in found:
        texts.update(terms)
        for term, tf in zip(terms, tfs):
            totals[term] = totals.get(term, 0) + tf
        if len(totals) >= MOST_COUNTED:
            yield batch()
            totals, texts = {}, Counter()
    if totals:
        yield batch()


def _summed(parts: DataFrame, tasks: int | None) -> DataFrame:
    if tasks:
        parts = parts.repartition(tasks, "term")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("documents").alias("documents"))


def term_statistics(terms: DataFrame, tasks: int | None = None) -> DataFrame:
    """Corpus count and number of texts per term.

    Tasks add up what they see of a term before it moves. ``tasks`` as in ``document_terms``:
    with it the sums spread over that many tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _totals((_values(b.column("term")), _values(b.column("tf"))) for b in batches)

    kept = terms.filter(F.col("term").isNotNull()).select("term", "tf")
    return _summed(kept.mapInArrow(add, COUNTS), tasks)


def text_statistics(
    df: DataFrame, key: str, text: str, stop_words: tuple[str, ...], tasks: int
) -> DataFrame:
    """``term_statistics`` of ``document_terms``, in one pass over the texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _totals((list(c.keys()), list(c.values())) for _, c in _counted(batches))

    return _summed(_placed_words(df, key, text, stop_words, tasks).mapInArrow(add, COUNTS), tasks)


def fit_vocabulary(
    df: DataFrame, key: str, text: str, max_terms: int = vocab.MAX_TERMS,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS,
) -> DataFrame:
    """(term, term_id, total, documents, idf) of the ``max_terms`` commonest terms.

    The limit bounds every later use of the vocabulary.
    """
    tasks = text_tasks(df, text)
    counts = text_statistics(df, key, text, stop_words, tasks)
    if tasks > 4 * MERGE_TASKS:
        # The last task reads the commonest terms of groups of tasks, not those of every task.
        first = Window.partitionBy("_group").orderBy(F.desc("total"), "term")
        counts = counts.withColumn("_group", F.spark_partition_id() % MERGE_TASKS).withColumn(
            "_place", F.row_number().over(first)
        ).filter(F.col("_place") <= max_terms)
    top = (
        counts.orderBy(F.desc("total"), "term").limit(max_terms)
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("total")).alias("order"), "term", "documents"))
            ).alias("kept")
        )
        .select(F.posexplode("kept").alias("term_id", "kept"))
    )
    texts = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return top.select(
        "kept.term", "term_id", (-F.col("kept.order")).alias("total"), "kept.documents",
        (F.log((1 + texts) / (1 + F.col("kept.documents"))) + 1.0).alias("idf"),
    )


def _weights(counts: Counter, places: dict) -> tuple[list[int], list[float]]:
    """Term ids, ascending, and unit weights of a text."""
    row = sorted((*places[t], tf) for t, tf in counts.items() if t in places)
    found = [(1.0 + log(tf)) * idf for _, idf, tf in row]
    length = sqrt(sum(w * w for w in found))
    return [i for i, _, _ in row], [w / length for w in found]


def _shared_terms(vocabulary: DataFrame) -> Broadcast:
    """Term ids and weights for every task. A vocabulary holds at most its ``max_terms`` rows."""
    rows = vocabulary.select("term", "term_id", "idf").toLocalIterator()
    return vocabulary.sparkSession.sparkContext.broadcast({r["term"]: (r["term_id"], r["idf"]) for r in rows})


def weigh(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS,
) -> DataFrame:
    """Unit TF-IDF row per text: key, ``ids`` (ascending), ``weights``.

    ``vocabulary`` holds at most its ``max_terms`` rows, so it is read and broadcast.
    """
    rows = _placed_words(df, key, text, stop_words, None)
    shared = _shared_terms(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(weights, pa.list_(pa.float64()))],
                [key, "ids", "weights"],
            )

        kind, batches = _kind(batches)
        keys, ids, weights, entries = [], [], [], 0
        for own, counts in _counted(batches):
            terms, values = _weights(counts, shared.value)
            keys.append(own)
            ids.append(terms)
            weights.append(values)
            entries += len(terms) + 1
            if entries >= BATCH_ROWS:
                yield batch()
                keys, ids, weights, entries = [], [], [], 0
        if keys:
            yield batch()

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(vectors, f"{key} {kind}, ids array<int>, weights array<double>")


def weigh_rows(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS,
) -> DataFrame:
    """``df`` joined with ``weigh`` of it, and whether a row is the ``first`` of its key.

    Each row moves once, with its text, so no join moves it or its weights again. Rows without
    a key join nothing; a task holds the rows of one key.
    """
    keyed = df.filter(F.col(key).isNotNull()).select(key, F.struct(*[c for c in df.columns if c != key]).alias("_row"))
    placed = keyed.repartition(text_tasks(df, text), key).sortWithinPartitions(key)
    rows = placed.select(key, _words(F.col("_row")[text], stop_words), "_row")
    shared = _shared_terms(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def read() -> Iterator[pa.RecordBatch]:
            for one in every:
                waiting.append(one.column(2))
                yield one

        def batch() -> pa.RecordBatch:
            """The rows counted so far; what has been read beyond them waits on."""
            some = pa.concat_arrays(waiting)
            waiting[:] = [some.slice(len(keys))]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), some.slice(0, len(keys)), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(weights, pa.list_(pa.float64())), pa.array(first, pa.bool_())],
                [key, "_row", "ids", "weights", "first"],
            )

        kind, every = _kind(batches)
        keys, ids, weights, first, entries = [], [], [], [], 0
        for own, counts, n in _runs(read()):
            terms, values = _weights(counts, shared.value)
            for k in range(n):
                keys.append(own)
                ids.append(terms)
                weights.append(values)
                first.append(k == 0)
                entries += len(terms) + 1
            if entries >= BATCH_ROWS:
                yield batch()
                keys, ids, weights, first, entries = [], [], [], [], 0
        if keys:
            yield batch()

    schema = StructType([
        rows.schema[key], rows.schema["_row"], StructField("ids", ArrayType(IntegerType())),
        StructField("weights", ArrayType(DoubleType())), StructField("first", BooleanType()),
    ])
    return rows.mapInArrow(vectors, schema).select(key, "_row.*", "ids", "weights", "first")


def dense_terms(vectors: DataFrame, length: int = vocab.VECTOR_LENGTH) -> DataFrame:
    """Term rows as dense arrays, cut or zero-padded to ``length``.

    The form a corpus takes that is too small to factor. A vector whose head is
    all zero stays zero; others are scaled to length one again.
    """
    return vectors.withColumn(
        "vector", densify(F.col("ids"), F.col("weights"), length)
    ).withColumn("vector", unit(F.col("vector")).cast("array<float>"))
