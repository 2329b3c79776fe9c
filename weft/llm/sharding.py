"""Sharding by longest-processing-time scheduling.

Documents of equal text stay together. Groups are sorted by size, equal sizes by their
place among the groups of that size, and each goes to the least-loaded shard, ties to
the smallest shard number, at any input size and for groups of any size.

Groups of equal size are interchangeable, so the driver gets one row per distinct size
with the number of its groups. Distinct sizes add up to at most all bytes, so there are
at most sqrt(2 * bytes) of them: 245,000 at 30 GB, 14 million at 100 TB, 16 bytes each.
The heap deals such a run of equal sizes in turns: the shards whose loads lie within one
size of the least take groups in a fixed order, over and over, until the load of a
further shard is reached. A turn is one entry (first place, order of shards), and a run
has at most as many turns as there are shards. Every group finds its shard in the tasks,
from its size and its place within the size.

Null texts have size ``overhead``, no crc32, and form one group; empty texts another.
Equal rows are kept, each with its own slot. Slots number a shard's rows without gaps.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import partitions_of
from weft.llm.running import running_total, spread
from weft.session import cut_lineage

#: Distinct sizes up to which the turns are broadcast (at most 2 shards * 4 bytes a turn);
#: beyond it they are joined by shuffle, copied to this many salts.
SIZES_BROADCAST = 50_000
SALTS = 16


def deal(heap: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Turns (first place, order of shards) of ``count`` groups of one size; ``heap`` of (load, shard) is updated."""
    turns, place = [], 0
    if count == 1:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        return [(0, [shard])]
    if size == 0:
        return [(0, [heap[0][1]])]
    while place < count:
        least, first = heap[0]
        taking = []
        while heap and heap[0] < (least + size, first):
            taking.append(heapq.heappop(heap))
        rest = count - place
        rounds, more = divmod(rest, len(taking))
        if heap:
            # The next shard waits as long as every load given so far stays before its own.
            waiting, other = heap[0]
            until = (waiting - least) // size
            if (least + until * size, first) > (waiting, other):
                until -= 1
            if until <= rounds:
                rounds, more = until, 0
        turns.append((place, [s for _, s in taking[: min(rest, len(taking))]]))
        for k, (load, shard) in enumerate(taking):
            heapq.heappush(heap, (load + size * (rounds + (k < more)), shard))
        place += rounds * len(taking) + more
    return turns


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, list[int]]]]:
    """Turns per size from (size, number of groups): largest size first, least-loaded shard first."""
    heap = [(0, s) for s in range(shards)]
    return {size: deal(heap, size, count) for size, count in sorted(sizes, reverse=True)}


def shard_documents(
    documents: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8
) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row."""
    if shards < 1:
        raise ValueError("need at least one shard")
    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    # Texts that differ may share a name by chance; then they also stay together.
    rows = cut_lineage(
        documents.select(
            F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text, F.octet_length(text))).cast("long").alias("_group"),
        ),
        "sizes",
    )
    groups = cut_lineage(rows.groupBy("_group").agg(F.sum("size").alias("_size")), "groups")
    turns = size_turns(groups, shards)
    placed_in_size = running_total(
        groups, "_size", spread(["_group"], partitions_of(spark)), [F.col("_group")], F.lit(1), "_place"
    )
    if turns.num_rows <= SIZES_BROADCAST:
        named = placed_in_size.join(F.broadcast(spark.createDataFrame(turns)), "_size")
    else:
        salted = spark.createDataFrame(turns).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = placed_in_size.withColumn("_salt", F.pmod("_place", F.lit(SALTS)).cast("int")).join(salted, ["_size", "_salt"])
    turn = F.element_at(F.filter("_turns", lambda t: t["first"] <= F.col("_place")), -1)
    named = named.select("_group", "_place", turn.alias("_turn")).select(
        "_group",
        F.get("_turn.shards", F.pmod(F.col("_place") - F.col("_turn.first"), F.size("_turn.shards")).cast("int")).alias("shard"),
    )
    placed = rows.join(named, "_group")
    order = [F.col("_id").asc_nulls_last(), "_group"]
    numbered = running_total(
        placed, "shard", spread(["_id", "_group"], partitions_of(spark)), order, F.lit(1), "slot"
    )
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def size_turns(groups: DataFrame, shards: int) -> pa.Table:
    """(_size, _turns): one row per distinct size of a group."""
    counted = groups.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).toArrow()
    made = longest_first(list(zip(counted["_size"].to_pylist(), counted["n"].to_pylist())), shards)
    turn = pa.list_(pa.struct([("first", pa.int64()), ("shards", pa.list_(pa.int32()))]))
    return pa.table(
        {
            "_size": pa.array(made, pa.int64()),
            "_turns": pa.array([[{"first": f, "shards": s} for f, s in turns] for turns in made.values()], turn),
        }
    )


def write_shards(documents: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Documents as files in one folder per shard; ids must be unique here."""
    documents.join(placed.select(id_col, "shard", "slot"), id_col).write.partitionBy("shard").parquet(path)
