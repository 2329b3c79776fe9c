"""Exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments of about log2(n) bits. Two codes within Hamming
distance m * (s + 1) - 1 + a agree to within s + 1 bits in one of the first a segments or
to within s bits in one of all. So after all segments were searched to radius s, and
the first a to radius s + 1, every code nearer than that has been verified. Each round
raises s for the queries whose k-th verified distance is not yet covered, and only in
as many segments as that distance needs.

Equal codes are one index entry with its k + 1 least ids, and equal query codes are
searched once, so a code that a third of all rows share costs one entry. Entries are
dealt by (segment, leading bits of its value); queries go only to leading bits within
their radius. A block's answer is at most k + 1 codes a query. A block of more than
``BLOCK_MOST`` codes, as near copies that agree in a segment make it, is salted by a
hash of the code and its queries go to every salt. A task compares at most
``CANDIDATES`` pairs of query and code at once and keeps the k + 1 best of each query.
Every pair that shares a bucket is still compared, so the work grows with the square
of a group of distinct near copies.

Ties go to the lesser id. A query is not its own neighbour; rows repeated under one id
are one row. Fewer than k other rows give fewer results. Null ids, null vectors and
vectors with null, NaN or infinite components are neither indexed nor queries. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.llm.common import ranges
from weft.session import cut_lineage

BITS = 64
BLOCK_CODES = 1 << 14
BLOCK_MOST = 1 << 16
PROBES = 1 << 21
CANDIDATES = 1 << 20


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i of the code is set where component i is above 0; at most 64 components."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(whole, code).alias("code")).filter(
        "id is not null and code is not null"
    ).distinct()


def segments(entries: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment: widths near log2 of the number of codes."""
    m = int(np.clip(round(BITS / max(1.0, np.log2(max(2, entries)))), 2, 16))
    cuts = np.linspace(0, BITS, m + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def flips(width: int, ones: int) -> np.ndarray:
    """All masks of ``width`` bits with that many ones."""
    if ones < 0 or ones > width:
        return np.zeros(0, np.int64)
    if ones == 0:
        return np.zeros(1, np.int64)
    picks = np.array(list(combinations(range(width), ones)), np.int64)
    return (1 << picks).sum(axis=1)


def _best(query: np.ndarray, distance: np.ndarray, first: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` least (distance, first id) of each query, in order."""
    order = np.lexsort((first, distance, query))
    q = query[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    return order[rank < keep]


def _steps(begin: np.ndarray, count: np.ndarray):
    """(range, begin, count) of the ranges begin .. begin + count - 1, cut so that each step has at most CANDIDATES places."""
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
        high = min(low + CANDIDATES, int(ends[-1]))
        some = np.arange(np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left") + 1)
        start = ends[some] - count[some]
        skipped = np.maximum(low - start, 0)
        yield some, begin[some] + skipped, np.minimum(high, ends[some]) - start - skipped


def _near_enough(row: np.ndarray, distance: np.ndarray, keep: int) -> np.ndarray:
    """Places whose distance is not above the ``keep``-th least of their query; rows ascend."""
    local = np.cumsum(np.r_[0, row[1:] != row[:-1]])
    within = np.bincount(local * (BITS + 1) + distance, minlength=(local[-1] + 1) * (BITS + 1)).reshape(-1, BITS + 1).cumsum(axis=1)
    limit = (within < keep).sum(axis=1)
    return np.flatnonzero(distance <= limit[local])


def _search(cut: list[tuple[int, int]], lead: int, radius: int, keep: int):
    """Task: codes of one (segment, leading bits) block, or of one salt of it, at exactly ``radius`` in that segment."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out, held, first, best = [], 0, none, (none, none, none)

        def reduced():
            row, entry, distance = (np.concatenate([best[k], *(o[k] for o in out)]) for k in range(3))
            kept = _best(row, distance, first[entry], keep)
            return row[kept], entry[kept], distance[kept]

        if left.num_rows and right.num_rows:
            block = right.column("block")[0].as_py()
            segment, head = block >> 32, block & 0xFFFFFFFF
            shift, width = cut[segment]
            tail = width - min(lead, width)
            codes = left.column("code").to_numpy().view(np.uint64)
            first, many = left.column("first").to_numpy(), left.column("n").to_numpy()
            value = ((codes >> np.uint64(shift)) & np.uint64((1 << tail) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            codes, first, many, value = codes[order], first[order], many[order], value[order]
            starts = np.searchsorted(value, np.arange((1 << tail) + 1))
            asked = right.column("q").to_numpy().view(np.uint64)
            bound = right.column("bound").to_numpy()
            own = ((asked >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            used = np.bitwise_count((own >> tail) ^ head).astype(np.int64)
            for spent in np.unique(used):
                masks = flips(tail, radius - int(spent))
                if not len(masks):
                    continue
                some = np.flatnonzero(used == spent)
                step = max(1, PROBES // len(masks))
                for at in range(0, len(some), step):
                    q = some[at : at + step]
                    probes = ((own[q] & ((1 << tail) - 1))[:, None] ^ masks[None, :]).ravel()
                    begin, count = starts[probes], starts[probes + 1] - starts[probes]
                    for part, begins, counts in _steps(begin, count):
                        row = np.repeat(q[part // len(masks)], counts)
                        entry = ranges(begins, counts)
                        distance = np.bitwise_count(codes[entry] ^ asked[row]).astype(np.int64)
                        near = np.flatnonzero(distance <= bound[row])
                        if not len(near):
                            continue
                        near = near[_near_enough(row[near], distance[near], keep)]
                        row, entry, distance = row[near], entry[near], distance[near]
                        kept = _best(row, distance, first[entry], keep)
                        out.append((row[kept], entry[kept], distance[kept]))
                        held += len(kept)
                        if held > CANDIDATES:
                            best, out, held = reduced(), [], 0
        if not out and not len(best[0]):
            none = pa.array([], pa.int64())
            return pa.table({"q": none, "code": none, "distance": none, "first": none, "n": none})
        row, entry, distance = reduced()
        return pa.table(
            {
                "q": asked[row].view(np.int64), "code": codes[entry].view(np.int64), "distance": distance,
                "first": first[entry], "n": many[entry],
            }
        )

    return run


FOUND = "q long, code long, distance long, first long, n long"


def _probes(cut: list[tuple[int, int]], lead: int, radius: int, covered: int, salts: dict):
    """Task: blocks, with each of their salts, that each query must visit in this round."""
    m = len(cut)

    def run(batches):
        for batch in batches:
            q = batch.column("q").to_numpy()
            bound = batch.column("bound").to_numpy()
            blocks, rows = [], []
            wanted = np.clip(bound - covered, 0, m)
            for k, (shift, width) in enumerate(cut):
                use = np.flatnonzero(wanted > k)
                if not len(use) or radius > width:
                    continue
                bits = min(lead, width)
                head = ((q[use].view(np.uint64) >> np.uint64(shift + width - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                for ones in range(max(0, radius - (width - bits)), min(bits, radius) + 1):
                    for mask in flips(bits, ones).tolist():
                        blocks.append((k << 32) | (head ^ mask))
                        rows.append(use)
            if blocks:
                row, block = np.concatenate(rows), np.concatenate(blocks)
                copies = np.ones(len(block), np.int64)
                for hot, n in salts.items():
                    copies[block == hot] = n
                row, block, salt = np.repeat(row, copies), np.repeat(block, copies), ranges(np.zeros(len(copies), np.int64), copies)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(salt), pa.array(q[row]), pa.array(bound[row])], names=["block", "salt", "q", "bound"]
                )

    return run


def search_codes(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest other ids of ``index`` to each id of ``queries``.

    Both tables are (id long, code long); rows without id are left out. An id with several
    codes counts once, at the least distance between any code of it and any of the query's.
    Then k + 1 times as many rows as one id has codes are held per query.
    """
    if k < 1:
        raise ValueError("need k >= 1")
    spark = index.sparkSession
    index, queries = (t.select("id", "code").filter(F.col("id").isNotNull()) for t in (index, queries))
    index = cut_lineage(index.distinct(), "index")
    repeated = index.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    alone = repeated == 1 and queries.distinct().groupBy("id").count().filter("count > 1").isEmpty()
    keep = (k + 1) * repeated  # a query's own rows may be among the nearest
    ranked = index.withColumn("_rank", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("_rank") <= keep)
    entries = cut_lineage(
        ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
            "code", "ids", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n")
        ),
        "codes",
    )
    size = entries.count()
    cut = segments(size)
    m, lead = len(cut), int(np.clip(np.ceil(np.log2(max(1, size / BLOCK_CODES))), 1, min(w for _, w in cut)))

    def head(code: Column, shift: int, width: int) -> Column:
        bits = min(lead, width)
        return F.shiftrightunsigned(code, shift + width - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    keys = F.array(*[F.lit(k << 32).cast("long") + head(F.col("code"), s, w) for k, (s, w) in enumerate(cut)])
    blocks = cut_lineage(entries.select(F.explode(keys).alias("block"), "code", "first", "n"), "blocks")
    # At most segments * codes / BLOCK_MOST hot blocks.
    hot = blocks.groupBy("block").count().filter(F.col("count") > BLOCK_MOST)
    salts = {r["block"]: -(-r["count"] // (BLOCK_MOST // 2)) for r in hot.collect()}
    salt = F.lit(0).cast("long")
    if salts:
        sizes = spark.createDataFrame(list(salts.items()), "block long, salts long")
        blocks = blocks.join(F.broadcast(sizes), "block", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("code"), F.col("salts")), salt)
    blocks = blocks.select("block", salt.alias("salt"), "code", "first", "n")
    active = cut_lineage(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS).cast("long")), "queries")
    found, radius, covered, done = None, 0, -1, None
    while True:
        probes = active.mapInArrow(_probes(cut, lead, radius, covered, salts), "block long, salt long, q long, bound long")
        new = blocks.groupBy("block", "salt").cogroup(probes.groupBy("block", "salt")).applyInArrow(_search(cut, lead, radius, keep), FOUND)
        merged = new if found is None else new.union(found.drop("held"))
        order = Window.partitionBy("q").orderBy("distance", "first")
        top = merged.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
        found = cut_lineage(top.withColumn("held", F.sum("n").over(order)).drop("place"), "found")
        covered = m * (radius + 1) - 1
        # The least distance at which k + 1 ids are held; a query that has every code is finished too.
        state = found.groupBy("q").agg(
            F.min(F.when(F.col("held") >= keep, F.col("distance"))).alias("near"), F.count(F.lit(1)).alias("codes")
        )
        state = active.select("q", F.col("bound").alias("_before")).join(state, "q", "left").select(
            "q", F.coalesce("near", F.when(F.coalesce("codes", F.lit(0)) >= size, F.lit(-1)), F.lit(BITS)).cast("long").alias("bound"),
            "_before",
        )
        # All its segments that the bound needed were searched: covered up to the bound it had.
        state = state.withColumn("_upto", F.least(F.lit(covered), F.greatest("_before", F.lit(covered - m))))
        closed = state.filter(F.col("bound") <= F.col("_upto")).select("q")
        rest = cut_lineage(state.filter(F.col("bound") > F.col("_upto")).select("q", "bound"), "queries")
        ended = found.join(closed, "q", "left_semi")
        done = ended if done is None else done.union(ended)
        if covered >= BITS or rest.isEmpty():
            done = done.union(found.join(rest, "q", "left_semi"))
            break
        found, active = found.join(rest, "q", "left_semi"), rest
        radius += 1
    near = done.select("q", "code", "distance").join(entries.select("code", "ids"), "code")
    near = near.select("q", "distance", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    near = near.withColumn("_place", place).filter(F.col("_place") <= keep)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    rows = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct().join(lists, "q")
    others = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    if alone:
        hits = rows.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
    else:
        least = rows.select("query_id", F.explode(others).alias("hit")).groupBy("query_id", F.col("hit.id").alias("id"))
        ordered = least.agg(F.min("hit.distance").alias("distance")).withColumn(
            "place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")) - 1
        )
        hits = ordered.filter(F.col("place") < k).select("query_id", "place", F.struct("distance", "id").alias("hit"))
    return hits.select(
        "query_id", (F.col("place") + 1).cast("long").alias("rank"), F.col("hit.id").alias("vec_id"), "hit.distance"
    )
