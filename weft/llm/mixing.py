"""Mixing sources to target weights.

The words of each source, its documents one after another, are packed into blocks of
``block_words`` words. Targets share ``share`` times all words by the weights 3, 1, 2,
repeating over the sources by code point, null last; a target stops at twice its
source's size and the excess is shared anew by weight. A source's target is a number
of slots, one block each. Output shards of ``shard_slots`` slots draw how many slots
each source gets from a multinomial; draws beyond a source's slots go to sources that
were drawn too seldom, so each source takes its slots exactly. A source's k-th slot
takes block p(k mod blocks) with p a pseudorandom permutation of that round, so no
block is taken more than once more often than another, and none more than twice.

Everything follows from the rows and the seed, so reruns agree. Documents without
words (null, empty, blank) have size 0 and are never taken. Rows with the same id and
text are interchangeable. An empty table gives an empty plan. Each task holds one
number per source; rows, blocks and slots are never held together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import bounded_batches, mix64, partitions_of, slices, text_bytes, tidy, word_spans
from weft.llm.running import running_total, spread
from weft.session import cut_lineage

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
WEIGHTS = (3, 1, 2)


def count_words(text: Column) -> Column:
    """Number of words of a text; null texts have none."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        _, _, row = word_spans(*text_bytes(texts))
        return pa.array(np.diff(row), pa.int64())

    return counted(F.coalesce(text, F.lit("")))


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = 2.0) -> np.ndarray:
    """Shares of ``total`` by weight, each at most ``most`` times its size, the excess shared anew."""
    full = np.zeros(len(sizes), bool)
    out = np.zeros(len(sizes))
    while True:
        left = total - (most * sizes[full]).sum()
        free = weights[~full].sum()
        out = np.where(full, most * sizes, left * weights / free if free else 0.0)
        above = ~full & (out > most * sizes)
        if not above.any():
            return np.minimum(out, most * sizes)
        full |= above


def permuted(index: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 .. size - 1 for each tag: Feistel rounds, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        l, r, h, m = out[todo] >> half[todo], out[todo] & low[todo], half[todo], low[todo]
        for k in range(4):
            l, r = r, l ^ (mix64(r * np.uint64(4) + np.uint64(k) + tag[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & m)
        out[todo] = (l << h) | r
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``rows``: id, source, size, source_size, target, start, rank; ``plan``: shard, rank, block."""

    rows: DataFrame
    plan: DataFrame
    block_words: int

    def blocks_taken(self) -> DataFrame:
        """(rank, block, times), about as many as there are blocks, though the plan's file is small."""
        return self.plan.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))

    def pieces(self) -> DataFrame:
        """Rows' words in taken blocks: the row's columns, from_word, n_words, times."""
        width = F.lit(self.block_words)
        end = F.col("start") + F.col("size")
        first = F.floor(F.col("start") / width).cast("long")
        last = F.floor((end - 1) / width).cast("long")
        held = self.rows.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        begin = F.greatest(F.col("start"), F.col("block") * width)
        n_words = F.least(end, (F.col("block") + 1) * width) - begin
        held = held.withColumns({"from_word": begin - F.col("start"), "n_words": n_words})
        # The draws are a few rows that make one per slot: by their size alone they would be broadcast.
        return held.join(self.blocks_taken().hint("merge"), ["rank", "block"])

    def taken(self) -> DataFrame:
        """(id, size, source, source_size, target, taken) of every row."""
        some = self.pieces().groupBy("rank", "start").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        # Rows without words share the place of the next row; they take no part in the join.
        held = self.rows.filter("size > 0").join(some.hint("merge"), ["rank", "start"], "left")
        empty = self.rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return held.unionByName(empty).select(
            "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def mix(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17,
) -> Mix:
    spark = documents.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    sized = cut_lineage(
        documents.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.xxhash64(text).alias("named"), count_words(text).alias("size"),
        ),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
    found = sorted(((r["source"], r["n"]) for r in by_source), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = np.array([n for _, n in found], np.float64)
    weights = np.array([WEIGHTS[k % 3] for k in range(len(found))], np.float64)
    goal = targets(sizes, weights, share * sizes.sum()) if len(found) else sizes
    blocks = np.ceil(sizes / block_words).astype(np.int64)
    slots = np.where(sizes > 0, np.rint(goal * blocks / np.maximum(sizes, 1)), 0).astype(np.int64)
    slots = np.minimum(slots, 2 * blocks)
    known = spark.createDataFrame(
        [(s, int(n), k, float(t)) for k, ((s, n), t) in enumerate(zip(found, goal))],
        "source string, source_size long, rank long, target double",
    ).withColumnRenamed("source", "_source")
    rows = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["_source"])).drop("_source")
    rows = cut_lineage(
        running_total(
            rows, "rank", spread(["id", "named"], partitions_of(spark)), [F.col("id").asc_nulls_last(), "named"],
            F.col("size"), "start",
        ),
        "offsets",
    )
    total = int(slots.sum())
    shards = -(-total // shard_slots)
    chance = slots / max(1, total)

    def draw(frames):
        for frame in frames:
            out = []
            for shard in frame["id"].tolist():
                n = min(shard_slots, total - shard * shard_slots)
                counts = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(n, chance)
                ranks = np.flatnonzero(counts)
                out.append(pd.DataFrame({"shard": shard, "rank": ranks, "n": counts[ranks]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "rank": [], "n": []}).astype("int64")

    tasks = max(1, min(partitions_of(spark), shards))
    drawn = spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, rank long, n long")
    drawn = cut_lineage(
        running_total(drawn, "rank", F.floor(F.col("shard") / 256).cast("long"), ["shard"], F.col("n"), "first"), "draws"
    )
    totals = np.zeros(len(found), np.int64)
    for r in drawn.groupBy("rank").agg(F.sum("n").alias("n")).collect():  # one row per source
        totals[r["rank"]] = r["n"]
    extra, missing = np.maximum(totals - slots, 0), np.maximum(slots - totals, 0)
    extra_at, missing_at = np.cumsum(extra) - extra, np.cumsum(missing) - missing

    def place(frames):
        for frame in frames:
            n = frame["n"].to_numpy(np.int64)
            shard = np.repeat(frame["shard"].to_numpy(np.int64), n)
            rank = np.repeat(frame["rank"].to_numpy(np.int64), n)
            k = np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(frame["first"].to_numpy(np.int64), n)
            over = np.flatnonzero(k >= slots[rank])
            if len(over):
                number = extra_at[rank[over]] + k[over] - slots[rank[over]]
                to = np.searchsorted(missing_at + missing, number, side="right")
                k[over] = totals[to] + number - missing_at[to]
                rank[over] = to
            turn, at = np.divmod(k, blocks[rank])
            block = permuted(at, blocks[rank], (rank * 4 + turn) * 1_000_003 + seed)
            yield pd.DataFrame({"shard": shard, "rank": rank, "block": block})

    plan = drawn.select("shard", "rank", "n", "first").mapInPandas(place, "shard long, rank long, block long")
    return Mix(rows, plan, block_words)


def mixed_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    chars_col: str | None = None, **settings,
) -> DataFrame:
    """The mix as documents: for each document one row per time that it is taken, with the words taken.

    Words keep the white space that follows them; a document taken whole keeps its text.
    ``chars_col`` is set to the length of the new text. Each of several rows of equal id, text
    and source is taken by itself; in further columns all of them carry the values of one of them.
    """
    made = mix(documents, id_col, text_col, source_col, **settings)
    pieces = made.pieces().select(
        "id", "named", "source", "rank", "start", "from_word", "n_words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn")
    )
    # Equal rows differ by their place in the source, so each keeps its own words.
    lists = pieces.groupBy("id", "named", "source", "rank", "start", "turn").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("_spans")
    )
    text = F.col(text_col).cast("string")
    lists = lists.select(
        F.col("id").alias("_list_id"), F.col("named").alias("_list_named"), F.col("source").alias("_list_source"), "_spans"
    )
    docs = documents.withColumns({"_id": F.col(id_col), "_named": F.xxhash64(text), "_source": F.col(source_col).cast("string")})
    same = F.struct("id", "named", "source")
    counts = made.rows.filter("size > 0").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(same).alias("d")).first()
    if counts["n"] != counts["d"]:
        docs = docs.dropDuplicates(["_id", "_named", "_source"])
    both = docs.join(
        lists,
        docs["_id"].eqNullSafe(lists["_list_id"]) & (docs["_named"] == lists["_list_named"])
        & docs["_source"].eqNullSafe(lists["_list_source"]),
    )
    both = both.select(*documents.columns, "_spans")
    names = list(documents.columns)
    at = names.index(text_col)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                raw, offsets = text_bytes(part.column(at))
                starts, _, row = word_spans(raw, offsets)
                out = []
                for k, spans in enumerate(part.column(len(names)).to_pylist()):
                    edges = np.append(starts[row[k] : row[k + 1]], offsets[k + 1])
                    edges[0] = offsets[k]
                    runs: list = []
                    for s in spans:
                        a, b = s["from_word"], s["from_word"] + s["n_words"]
                        if runs and runs[-1][1] == a:
                            runs[-1][1] = b
                        else:
                            runs.append([a, b])
                    out.append(b"".join(raw[edges[a] : edges[b]].tobytes() for a, b in runs).decode("utf-8"))
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = both.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in documents.columns]).schema
    mixed = both.mapInArrow(tidy(cut), schema)
    if chars_col:
        mixed = mixed.withColumn(chars_col, F.length(text_col).cast(documents.schema[chars_col].dataType))
    return mixed
