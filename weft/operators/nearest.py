"""Exact nearest chunks of many queries.

Both sides are cut into blocks by a hash of their id and meet block by block in
a cogroup: every task holds one block of each, multiplies them with numpy and
passes on only the n best chunks per query. Nothing is broadcast or collected,
no key can grow hot (ids are unique), and pairs are never rows.

Where the chunks are more than a block and dense, and the queries' vectors are measured
small, the chunks stay where they are: every task holds the queries, reads its chunks a
tile at a time and passes on the same n best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.operators.topn import top_n

MOST_CHUNKS_PER_BLOCK = 131072
LEAST_CHUNKS_PER_BLOCK = 16384
MOST_QUERIES_PER_BLOCK = 32768
LEAST_QUERIES_PER_BLOCK = 128
# One product matrix holds this many queries and chunks.
QUERY_TILE = 256
CHUNK_TILE = 16384
DIGITS = 6
# Queries are sent to the tasks of dense chunks if their vectors take no more than this, and their hits four times as much.
QUERY_BYTES = 64 << 20
ROWS_PASSED_ON = 1 << 16
# Chunks of a block are kept in double precision up to this.
READY_BYTES = 64 << 20


@dataclass(frozen=True)
class Blocks:
    """How many blocks the queries and the chunks are cut into."""

    queries: int
    chunks: int

    @staticmethod
    def plan(queries: int, chunks: int, parallelism: int) -> "Blocks":
        """Blocks that fit a task's memory and give every core some.

        A chunk block costs n rows per query, a query block one copy of the
        chunks. So both are as large as memory allows, and smaller only where
        there would be fewer blocks than cores.
        """
        few = int(np.ceil(np.sqrt(2 * parallelism)))
        by_chunks = max(
            1, -(-chunks // MOST_CHUNKS_PER_BLOCK),
            min(few, -(-chunks // LEAST_CHUNKS_PER_BLOCK)),
        )
        by_queries = max(
            1, -(-queries // MOST_QUERIES_PER_BLOCK),
            min(-(-2 * parallelism // by_chunks), -(-queries // LEAST_QUERIES_PER_BLOCK)),
        )
        return Blocks(by_queries, by_chunks)


def _flat(arrays: pd.Series, dtype: type) -> np.ndarray:
    return np.concatenate([np.asarray(a, dtype) for a in arrays]) if len(arrays) else np.empty(0, dtype)


class SparseBlock:
    """Sparse unit rows of one block, ready for products of tiles."""

    def __init__(self, q: pd.DataFrame, c: pd.DataFrame):
        self.q = q
        wanted = np.unique(_flat(q["ids"], np.int64))
        self.tiles = [
            self._postings(c.iloc[start : start + CHUNK_TILE], wanted)
            for start in range(0, len(c), CHUNK_TILE)
        ]

    @staticmethod
    def _postings(rows: pd.DataFrame, wanted: np.ndarray | None):
        """Rows, term ids and weights in term order, and the number of rows."""
        places = np.repeat(np.arange(len(rows)), rows["ids"].map(len).to_numpy(np.int64))
        ids, weights = _flat(rows["ids"], np.int64), _flat(rows["weights"], np.float64)
        used = np.flatnonzero(np.isin(ids, wanted)) if wanted is not None else np.arange(len(ids))
        order = used[np.argsort(ids[used], kind="stable")]
        return places[order], ids[order], weights[order], len(rows)

    def products(self, start: int) -> Iterator[np.ndarray]:
        """Products of one query tile with every chunk tile."""
        tile = self._postings(self.q.iloc[start : start + QUERY_TILE], None)
        q_rows, q_ids, q_weights, n_queries = tile
        terms = np.unique(q_ids)
        for c_rows, c_ids, c_weights, n_chunks in self.tiles:
            out = np.zeros((n_queries, n_chunks))
            ends = zip(
                np.searchsorted(q_ids, terms), np.searchsorted(q_ids, terms, "right"),
                np.searchsorted(c_ids, terms), np.searchsorted(c_ids, terms, "right"),
            )
            for q_lo, q_hi, c_lo, c_hi in ends:
                if c_lo < c_hi:
                    out[np.ix_(q_rows[q_lo:q_hi], c_rows[c_lo:c_hi])] += np.outer(
                        q_weights[q_lo:q_hi], c_weights[c_lo:c_hi]
                    )
            yield out


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one."""
    rows = rows.astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    lengths[lengths == 0] = 1.0
    rows /= lengths
    return rows


class DenseBlock:
    """Dense rows of one block; many are kept as they came and scaled to length one tile by tile."""

    def __init__(self, q: pd.DataFrame, c: pd.DataFrame):
        self.left, self.right = (np.stack([np.asarray(v) for v in side["vector"]]) for side in (q, c))
        self.ready = 8 * self.right.size <= READY_BYTES
        if self.ready:
            self.right = _units(self.right)

    def products(self, start: int) -> Iterator[np.ndarray]:
        tile = _units(self.left[start : start + QUERY_TILE])
        for at in range(0, len(self.right), CHUNK_TILE):
            right = self.right[at : at + CHUNK_TILE]
            yield tile @ (right if self.ready else _units(right)).T


def _best(distances: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n least distances; ties go to the lower position."""
    if len(distances) <= n:
        return np.arange(len(distances))
    last = np.partition(distances, n - 1)[n - 1]
    below = np.flatnonzero(distances < last)
    ties = np.flatnonzero(distances == last)[: n - len(below)]
    return np.concatenate([below, ties])


def _better(
    places: np.ndarray, distances: np.ndarray, line: np.ndarray, offset: int, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """The n best of those found so far and of a later tile's line.

    A full list is beaten only by lesser distances: later chunks lose ties.
    """
    if len(places) < n:
        new = _best(line, n)
    else:
        lesser = np.flatnonzero(line < distances.max())
        new = lesser[_best(line[lesser], n)]
    places = np.concatenate([places, new + offset])
    distances = np.concatenate([distances, line[new]])
    if len(places) > n:
        kept = np.lexsort((places, distances))[:n]
        places, distances = places[kept], distances[kept]
    return places, distances


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _beside_queries(shared, n: int, digits: int):
    """Task: the n best of its chunks for each query, read a tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        left, limits = _units(_matrix(queries["vector"])), queries["_n"].to_numpy()
        best: list[list[tuple]] = [[] for _ in limits]
        worst = np.where(limits > 0, np.inf, -np.inf)
        kind = None
        for whole in batches:
            kind = whole.column(0).type
            for start in range(0, whole.num_rows, CHUNK_TILE):
                batch = whole.slice(start, CHUNK_TILE)
                batch = batch.take(pc.sort_indices(batch.column(0)))
                names, right = np.array(batch.column(0).to_pylist(), object), _units(_matrix(batch.column(1))).T
                for at in range(0, len(left), QUERY_TILE):
                    distances = np.round(1.0 - left[at : at + QUERY_TILE] @ right, digits) + 0.0
                    near = distances <= worst[at : at + QUERY_TILE, None]
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        # Chunks as far as the last one may come before it by their id.
                        m, line, places = int(limits[at + i]), distances[i], np.flatnonzero(near[i])
                        places = places[_best(line[places], m)]
                        mine = sorted([*best[at + i], *zip(line[places].tolist(), names[places])])[:m]
                        best[at + i] = mine
                        if len(mine) == m:
                            worst[at + i] = mine[-1][0]
        step = max(1, ROWS_PASSED_ON // max(1, n))
        for at in range(0, len(best), step):
            part = best[at : at + step]
            hits = [hit for found in part for hit in found]
            places = np.repeat(np.arange(at, at + len(part)), [len(found) for found in part])
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [
                        queries["_query"].take(pa.array(places)), pa.array([name for _, name in hits], kind),
                        pa.array([distance for distance, _ in hits], pa.float64()),
                    ],
                    ["_query", "_chunk", "distance"],
                )

    return run


def _few_queries(q_side: DataFrame, queries: int, chunks: int, n: int) -> dict | None:
    """The queries as arrays, if they may travel to the chunks: few bytes beside more than a block of chunks."""
    if chunks <= MOST_CHUNKS_PER_BLOCK or not queries:
        return None
    one = q_side.select(F.size("_q_vector")).first()
    length = one[0] if one else 0
    # A hit held by a task is a tuple of two objects, the chunk's id among them.
    if length < 1 or queries * 8 * length > QUERY_BYTES or queries * 160 * min(n, chunks) > 4 * QUERY_BYTES:
        return None
    found = q_side.select("_query", "_q_vector", F.coalesce("_n", F.lit(0)).alias("_n")).toArrow()
    return {
        "_query": found.column(0).combine_chunks(), "vector": found.column(1).combine_chunks(), "_n": found.column(2).combine_chunks()
    }


def nearest_chunks(
    queries: DataFrame, chunks: DataFrame, n: int, sparse: bool, query: str = "query_id",
    chunk: str = "chunk_id", own_n: str | None = None, blocks: Blocks | None = None,
    digits: int = DIGITS, counts: tuple[int, int] | None = None,
) -> DataFrame:
    """(query, chunk, distance, hit_rank): the n nearest chunks per query.

    Rows carry ``ids`` and ``weights`` (sparse, unit length) or ``vector`` (dense).
    Distances are rounded before they are compared and ties go to the lower chunk
    id, so the result does not depend on the order of float sums. ``own_n`` names
    a query column with a smaller n; it holds inside the tasks, so one search for
    many chunks makes no other send more than it asked for. ``counts`` are the rows of both
    sides, where the caller knows them.
    """
    spark = queries.sparkSession
    cores, few = spark.sparkContext.defaultParallelism, None
    own = F.coalesce(F.col(own_n).cast("long"), F.lit(0)) if own_n else F.lit(n).cast("long")
    limit = F.least(own, F.lit(n))
    if blocks is None:
        many = counts or (queries.count(), chunks.count())
        blocks = Blocks.plan(*many, cores)
        if not sparse:
            asked = queries.select(F.col(query).alias("_query"), F.col("vector").alias("_q_vector"), limit.alias("_n"))
            few = _few_queries(asked, *many, n)
    values = ["ids", "weights"] if sparse else ["vector"]
    block = SparseBlock if sparse else DenseBlock

    def block_of(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def own_values(side: str) -> list[Column]:
        # A cogroup loses columns that both sides share, as they do where a table is searched for itself.
        return [F.col(v).alias(side + v) for v in values]

    tasks = min(2 * blocks.queries * blocks.chunks, 20000)
    q_side = queries.select(
        F.col(query).alias("_query"), *own_values("_q_"), limit.alias("_n"),
        block_of(query, blocks.queries).alias("_qb"),
    ).withColumn("_cb", every(blocks.chunks)).repartition(tasks, "_qb", "_cb")
    c_side = chunks.select(
        F.col(chunk).alias("_chunk"), *own_values("_c_"), block_of(chunk, blocks.chunks).alias("_cb")
    ).withColumn("_qb", every(blocks.queries)).repartition(tasks, "_qb", "_cb")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if n < 1 or q.empty or c.empty:
            none = np.empty(0, object)
            return pd.DataFrame({"_query": none, "_chunk": none, "distance": np.empty(0)})
        c = c.sort_values("_chunk", ignore_index=True)
        ids, names, limits = q["_query"].to_numpy(), c["_chunk"].to_numpy(), q["_n"].fillna(0).to_numpy(np.int64)
        joined = block(
            q.rename(columns={f"_q_{v}": v for v in values}), c.rename(columns={f"_c_{v}": v for v in values})
        )
        del q, c  # the block holds what it needs of them
        rows, picks, found = [], [], []
        for start in range(0, len(ids), QUERY_TILE):
            size = min(QUERY_TILE, len(ids) - start)
            best = [(np.empty(0, np.int64), np.empty(0))] * size
            offset = 0
            for products in joined.products(start):
                distances = np.round(1.0 - products, digits) + 0.0
                best = [
                    _better(*b, line, offset, m) if m > 0 else b
                    for b, line, m in zip(best, distances, limits[start : start + size])
                ]
                offset += products.shape[1]
            for i, (places, distances) in enumerate(best):
                rows.append(np.full(len(places), start + i))
                picks.append(places)
                found.append(distances)
        return pd.DataFrame(
            {
                "_query": ids[np.concatenate(rows)],
                "_chunk": names[np.concatenate(picks)],
                "distance": np.concatenate(found),
            }
        )

    schema = (
        f"_query {queries.schema[query].dataType.simpleString()}, "
        f"_chunk {chunks.schema[chunk].dataType.simpleString()}, distance double"
    )
    if few is not None:
        # Each task sends n rows for a query, so there are no more of them than the cores need.
        shared = spark.sparkContext.broadcast(few)
        near = chunks.select(F.col(chunk).alias("_chunk"), "vector").coalesce(2 * cores)
        local = near.mapInArrow(_beside_queries(shared, n, digits), schema)
    else:
        local = (
            q_side.groupBy("_qb", "_cb").cogroup(c_side.groupBy("_qb", "_cb"))
            .applyInPandas(search, schema)
        )
    local = local.withColumnRenamed("_query", query)
    if own_n is None:
        ranked = top_n(
            local, [query], [F.col("distance"), F.col("_chunk")], n, rank="hit_rank",
            merge_tasks=64 if blocks.chunks > 1024 else None,
        )
    else:
        # Tasks have cut each query to its own n already; a window limit for the greatest n would cut nothing.
        order = Window.partitionBy(query).orderBy("distance", "_chunk")
        limited = local.join(queries.select(query, limit.alias("_n")), query)
        if blocks.chunks > 1024:
            part = Window.partitionBy(query, "_group").orderBy("distance", "_chunk")
            limited = limited.withColumn("_group", F.spark_partition_id() % 64)
            limited = limited.withColumn("_local", F.row_number().over(part)).filter("_local <= _n")
        ranked = limited.withColumn("hit_rank", F.row_number().over(order)).filter("hit_rank <= _n")
    return ranked.select(query, F.col("_chunk").alias(chunk), "distance", "hit_rank")
