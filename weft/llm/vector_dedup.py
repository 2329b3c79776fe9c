"""Near duplicates of vectors by comparing tiles of them, whole pairs only where a part is near.

Vectors are scaled to length 1 and rotated by a Hadamard transform after fixed
pseudorandom sign changes, then split into blocks of ``block_dims`` components. Unit
vectors with cosine c lie sqrt(2 - 2c) apart, and no farther in any part of their
components. The rotation spreads a difference evenly, so the first few blocks already
tell most pairs apart: a pair is a candidate if it is within that distance there.
Candidates are verified by their cosine in double precision.

Equal vectors are one row with a multiplicity and a number of its own. Rows are cut into
tiles by a hash of their number; a task holds two tiles, tests every pair between them
and returns link counts and a spanning forest of its links, folded in as they are found,
never pairs. Each two tiles meet once. A row travels once for each tile, in the type it
came in; tiles lying d apart meet in round d, several rounds at once where they are small,
and the shuffle of a round is removed before the next, so the disk holds about two copies
of the vectors beside the tables whatever their number.

Vectors are compared with those of the same length. Vectors that are null, empty, zero
or hold null or non-finite components link with nothing. Rows without an id are not
compared; they have n_links 0 and no component. Repeated rows count as other vectors.
Rows of one id and different vectors are told apart; of those that are linked, the
vector that comes first by its name is kept. Other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import mix64
from weft.llm.graph import components, local_components
from weft.session import cut_lineage

BLOCK_DIMS = 8
TILE = 4096
TILE_BYTES = 32 << 20
#: Bytes that the rounds of one shuffle may move together; a round of more has its own.
ROUND_BYTES = 256 << 20
ROTATED_ROWS = 1 << 14
CHUNK = 1 << 17
# Rows of each side whose products a task holds at once.
ROWS, COLUMNS = 1024, 4096
#: Sums of products err by less than this in single precision, for each product.
SLACK_SINGLE = 1e-6


def rotated(vectors: np.ndarray, seed: int = 5) -> np.ndarray:
    """Unit vectors after sign changes and a Hadamard transform; adds row by row, so equal in every task."""
    n, dims = vectors.shape
    width = 1 << max(0, int(np.ceil(np.log2(dims))))
    width = max(width, BLOCK_DIMS)
    sign = np.where(np.random.Generator(np.random.Philox(seed)).random(width) < 0.5, -1.0, 1.0)
    out = np.zeros((n, width))
    # By a power of two first, so that squares of very small or large components neither vanish nor overflow.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])
    length = np.sqrt((vectors * vectors).sum(axis=1))
    out[:, :dims] = vectors / length[:, None]
    out *= sign
    step = 1
    while step < width:
        pair = out.reshape(n, -1, 2, step)
        a, b = pair[:, :, 0, :] + pair[:, :, 1, :], pair[:, :, 0, :] - pair[:, :, 1, :]
        out = np.stack([a, b], axis=2).reshape(n, width)
        step *= 2
    return out / np.sqrt(width)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of lists of one length as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(whole), -1)


class Plan:
    """How vectors of one length are compared: tiles, components of the first test and its squared distance."""

    def __init__(self, dims: int, size: int, threshold: float, cores: int = 1):
        self.width = max(BLOCK_DIMS, 1 << max(0, int(np.ceil(np.log2(dims)))))
        self.budget = 2 - 2 * threshold
        # Components in which two vectors without relation lie at about twice the distance.
        blocks = int(np.ceil(np.clip(2 * self.budget, 0.0, 1.0) * self.width / BLOCK_DIMS))
        self.first = BLOCK_DIMS * max(1, blocks)
        most = max(TILE, TILE_BYTES // (8 * self.width))
        # No more rows than a task may hold, and a task for each core where there are enough.
        few = int(np.ceil(np.sqrt(2 * cores)))
        self.tiles = max(1, -(-size // most), min(few, -(-size // TILE)))
        self.rounds = [(d, size * (self.width * 8 + 64) * (2 if 0 < 2 * d != self.tiles else 1)) for d in range(self.tiles // 2 + 1)]


def _rounds(plans: dict) -> list[dict]:
    """The distances of the tiles that meet in each shuffle, by length."""
    out, held = [], 0
    for dims, plan in plans.items():
        for d, size in plan.rounds:
            if not out or held + size > ROUND_BYTES:
                out.append({})
                held = 0
            held += size
            out[-1].setdefault(dims, []).append(d)
    return out


def _by_length(batch: pa.RecordBatch):
    """(number of components, rows) of a batch."""
    lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        yield dims, batch.filter(pa.array(lengths == dims))


def _deal(plans: dict, meeting: dict):
    """Task: each vector to the pairs of tiles of this round that its own tile is in."""

    def run(batches):
        for batch in batches:
            for dims, rows in _by_length(batch):
                m = plans[dims].tiles
                own = ((mix64(rows.column("node").to_numpy().view(np.uint64)) >> np.uint64(1)) % np.uint64(m)).astype(np.int64)
                for d in meeting.get(dims, ()):
                    for left, right in ((own, (own + d) % m), ((own - d) % m, own))[: 2 if d else 1]:
                        # Half the circle apart, tiles would meet twice.
                        met = np.flatnonzero((left < d) | (2 * d != m) | (d == 0))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(met), dims, np.int32)), pa.array(left[met].astype(np.int32)), pa.array(right[met].astype(np.int32)),
                                pa.array(own[met].astype(np.int32)), *[rows.column(c).take(pa.array(met)) for c in ("node", "w", "v")],
                            ],
                            names=["dims", "left", "right", "home", "node", "w", "v"],
                        )

    return run


def _turned(group: pa.Table, order: np.ndarray) -> np.ndarray:
    """Rotated vectors of a group's rows in that order."""
    if "y" in group.column_names:
        return _matrix(group.column("y"))[order]
    column = group.column("v").combine_chunks()
    out = None
    for at in range(0, len(order), ROTATED_ROWS):
        part = rotated(_matrix(column.take(pa.array(order[at : at + ROTATED_ROWS]))))
        if out is None:
            out = np.empty((len(order), part.shape[1]))
        out[at : at + len(part)] = part
    return out


def _near(mine: np.ndarray, theirs: np.ndarray, most: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Places of the products that are at most ``most``; few are, so eight are passed over at a time."""
    found = mine @ theirs <= most
    pad = -found.shape[1] % 8
    if pad:
        found = np.pad(found, ((0, 0), (0, pad)))
    words = np.flatnonzero(found.reshape(-1).view(np.uint64))
    hit, bit = np.nonzero(found.reshape(-1, 8)[words])
    return np.divmod(words[hit] * 8 + bit, found.shape[1])


def _join(plans: dict, threshold: float):
    """Task: links between the rows of two tiles."""

    def run(group: pa.Table) -> pa.Table:
        tile, other = (group.column(c)[0].as_py() for c in ("left", "right"))
        plan = plans[group.column("dims")[0].as_py()]
        nodes, home = group.column("node").to_numpy(), group.column("home").to_numpy()
        # The left tile first; paired with itself, a row meets only rows behind it, so each pair is met once.
        order = np.lexsort((nodes, home != tile))
        nodes, weight = nodes[order], group.column("w").to_numpy()[order]
        y = _turned(group, order)
        left = int((home == tile).sum())
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        sub = y[:, : plan.first]
        square, one = (sub * sub).sum(axis=1)[:, None], np.ones((len(nodes), 1))
        # |a - b|^2 as one product, in single precision; what its error lets through is tested in double.
        mine = np.hstack([-2 * sub, square, one]).astype(np.float32)
        theirs = np.ascontiguousarray(np.hstack([sub, one, square]).astype(np.float32).T)
        most = np.float32(plan.budget + SLACK_SINGLE * (plan.first + 2))
        waiting: list = []

        def fold() -> None:
            """Waiting links into the labels."""
            nonlocal label
            if waiting:
                p, q = (np.concatenate(x) for x in zip(*waiting))
                label = local_components(len(nodes), label[p], label[q])[label]
                waiting.clear()

        for at in range(0, left, ROWS):
            first = at if tile == other else left
            for start in range(first, len(nodes), COLUMNS):
                a, b = _near(mine[at : min(at + ROWS, left)], theirs[:, start : start + COLUMNS], most)
                a, b = a + at, b + start
                behind = b > a
                a, b = a[behind], b[behind]
                for part in range(0, len(a), CHUNK):
                    p, q = a[part : part + CHUNK], b[part : part + CHUNK]
                    linked = (y[p] * y[q]).sum(axis=1) >= threshold
                    p, q = p[linked], q[linked]
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                    apart = label[p] != label[q]
                    if apart.any():
                        waiting.append((p[apart], q[apart]))
                        if sum(len(x) for x, _ in waiting) >= CHUNK // 4:
                            fold()
        fold()
        some = np.flatnonzero(links)
        return pa.table({"node": nodes[some], "links": links[some], "with": nodes[label[some]]})

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    whole = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Kept in single precision where they came so; every task reads the same numbers from it.
    held = F.col(vector_col) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else v
    rows = cut_lineage(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.when(whole, held).alias("v"), F.when(whole, v).alias("_long")).select(
            "id", "v",
            F.when(F.col("v").isNotNull() & F.col("id").isNotNull(), F.sha2(F.concat_ws(",", F.col("_long").cast("array<string>")), 256)).alias("named"),
        ),
        "vectors",
    )
    alone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    named = rows.filter("named is not null").groupBy("named").agg(F.min_by("v", "id").alias("v"), F.count(F.lit(1)).alias("w"), F.min("id").alias("id"))
    # The number is written once; an id can stand for several vectors.
    classes = cut_lineage(named.withColumn("node", F.monotonically_increasing_id()), "classes", drop_shuffles=True)
    sizes = classes.groupBy(F.size("v").alias("dims")).count().collect()
    if not sizes:
        return alone.withColumn("kept", F.col("component_id").isNotNull())
    cores = spark.sparkContext.defaultParallelism
    plans = {r["dims"]: Plan(r["dims"], r["count"], threshold, cores) for r in sizes}
    kind = classes.schema["v"].dataType.simpleString()
    parts = []
    for meeting in _rounds(plans):
        dealt = classes.select("node", "w", "v").mapInArrow(
            _deal(plans, meeting), f"dims int, left int, right int, home int, node long, w long, v {kind}"
        )
        joined = dealt.groupBy("dims", "left", "right").applyInArrow(_join(plans, threshold), "node long, links long, with long")
        parts.append(cut_lineage(joined, "links", drop_shuffles=True))
    found = functools.reduce(DataFrame.unionAll, parts)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("with").alias("v")))
    placed = classes.select("named", "id", "w", "node").join(links, "node", "left").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    first = placed.groupBy("component").agg(F.min(F.struct("id", "named")).alias("first"))
    per_class = placed.join(first, "component").select(
        "named", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("first.id").alias("component_id"),
        (F.col("first.named") == F.col("named")).alias("is_first"),
    )
    out = rows.join(per_class, "named", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), "is_first",
    )
    kept = F.coalesce((F.col(id_col) == F.col("component_id")) & F.coalesce("is_first", F.lit(True)), F.lit(False))
    return out.withColumn("kept", kept).drop("is_first")
