"""Toxicity: character n-gram linear classifier with naive Bayes log-count ratios.

A document's features say which n-grams of 2 to 5 characters (lower-cased) it holds,
hashed into a fixed number of cells. Each feature is scaled by the naive Bayes
log-count ratio of its cell over labelled texts, and a logistic regression on the
scaled features gives the score.

``fit`` learns from at most about ``max_rows`` labelled rows, half of them positive
where there are as many; the bias is then moved to the share of positives among all
labelled rows. Labels other than 0 and 1 and null labels are not learned from. With
no labelled rows, or rows of one label only, the score is that share (0.5 without
rows) for every text.

Null and empty texts are scored as texts without n-grams. Every input row gives one
row, so repeated rows and ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import bounded_batches, pack, tidy, unpack

ORDERS = (2, 3, 4, 5)
CELL_BITS = 20
FEATURES = 4096
MAX_ROWS = 6_000
LEAST_COUNT = 4
SLICE_CHARS = 1 << 19


@dataclass(frozen=True)
class Model:
    """``slot`` maps a cell to its feature or -1; ``weight`` is regression weight times ratio."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def grams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of every n-gram, one order at a time; no n-gram spans two rows."""
    gap = max(ORDERS)
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    joined = ("\0" * gap).join(lowered) + "\0" * gap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes + gap)
    held = np.cumsum(sizes + gap)
    left = held[row] - gap - np.arange(len(points))  # characters from here to the end of the row
    value = points * np.uint32(0x9E3779B1)
    for n in range(2, gap + 1):
        value = value[:-1] * np.uint32(0x85EBCA6B) ^ (points[n - 1 :] * np.uint32(0xC2B2AE35))
        value ^= value >> np.uint32(13)
        if n in ORDERS:
            keep = left[: len(value)] >= n
            mixed = (value * np.uint32(0x27D4EB2F)) ^ np.uint32(n * 0x165667B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield row[: len(value)][keep], (mixed >> np.uint32(32 - CELL_BITS))[keep].astype(np.int64)


def text_groups(texts: list) -> Iterator[tuple[int, list]]:
    """Consecutive texts of at most SLICE_CHARS characters together, or one text."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > SLICE_CHARS:
            yield start, texts[start:k]
            start, size = k, 0
        size += n
    if texts:
        yield start, texts[start:]


def _held_cells(texts: list) -> Iterator[np.ndarray]:
    """Distinct cells of each text."""
    for _, group in text_groups(texts):
        found = list(grams(group))
        row = np.concatenate([r for r, _ in found])
        cell = np.concatenate([c for _, c in found])
        both = np.unique((row << CELL_BITS) | cell)
        cuts = np.searchsorted(both, np.arange(len(group) + 1) << CELL_BITS)
        for k in range(len(group)):
            yield both[cuts[k] : cuts[k + 1]] & ((1 << CELL_BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]):
    counts = np.zeros((2, 1 << CELL_BITS), np.int64)
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for label, cells in zip(labels, _held_cells(batch.column(0).to_pylist())):
            counts[label, cells] += 1
    parts = counts.astype(np.uint32).reshape(2, 16, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(16), pa.int32()), pa.array([pack(parts[0, k], parts[1, k]) for k in range(16)], pa.binary())],
        names=["chunk", "payload"],
    )


def _add(group: pa.Table) -> pa.Table:
    zero, one = 0, 0
    for value in group.column("payload").to_pylist():
        a, b = unpack(value)
        zero, one = zero + a.astype(np.int64), one + b.astype(np.int64)
    return pa.table({"chunk": group.column("chunk")[:1], "payload": pa.array([pack(zero, one)], pa.binary())})


def _regression(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, l2: float = 0.2, steps: int = 400):
    """Logistic regression on present features times ``scale``, by accelerated gradient steps."""
    sizes = np.array([len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.intp)
    owner = np.repeat(np.arange(len(rows)), sizes)
    n, width = len(rows), len(scale)
    value = scale[feature]
    bound = 0.25 * (np.bincount(owner, value**2, n).max() + 1) + l2 / n
    w, b, pw, pb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for k in range(steps):
        momentum = k / (k + 3)
        yw, yb = w + momentum * (w - pw), b + momentum * (b - pb)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * yw[feature], n) + yb, -500, 500)))
        error = (p - label) / n
        pw, pb = w, b
        w = yw - (np.bincount(feature, value * error[owner], width) + l2 / n * yw) / bound
        b = yb - error.sum() / bound
    return w, b


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", max_rows: int = MAX_ROWS) -> Model:
    """Model from a table of texts and 0/1 labels, small enough to be read twice (see ``sample``)."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    data = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))
    data = data.filter("label in (0, 1)")
    added = data.mapInArrow(tidy(_count), "chunk int, payload binary").groupBy("chunk").applyInArrow(
        _add, "chunk int, payload binary"
    )
    parts = [unpack(bytes(r["payload"])) for r in sorted(added.collect(), key=lambda r: r["chunk"])]
    size = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    slot = np.full(1 << CELL_BITS, -1, np.int32)
    if len(size) < 2:
        share = size.get(1, 0) / max(1, sum(size.values())) if size else 0.5
        return Model(slot, np.zeros(0, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    q, p = (np.concatenate([x[k] for x in parts]).astype(np.float64) for k in (0, 1))
    ratio = np.log((p + 1) / (size[1] + 2)) - np.log((q + 1) / (size[0] + 2))
    spread = np.sqrt(1 / (p + 1) + 1 / (q + 1))
    rank = np.where(p + q >= LEAST_COUNT, np.abs(ratio) / spread, 0)
    best = np.sort(np.argsort(-rank, kind="stable")[:FEATURES])
    best = best[rank[best] > 0]
    slot[best] = np.arange(len(best))
    shared = spark.sparkContext.broadcast(slot)

    def present(batches):
        for batch in batches:
            rows = []
            for cells in _held_cells(batch.column(0).to_pylist()):
                found = shared.value[cells]
                rows.append(found[found >= 0].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], names=["label", "held"])

    # At most about max_rows rows of at most FEATURES two-byte numbers.
    rows = data.mapInArrow(tidy(present), "label int, held binary").toArrow()
    label = rows.column("label").to_numpy().astype(np.float64)
    held = [np.frombuffer(v, np.uint16) for v in rows.column("held").to_pylist()]
    order = sorted(range(len(held)), key=lambda k: (label[k], held[k].tobytes()))
    weight, bias = _regression([held[k] for k in order], label[order], ratio[best])
    return Model(slot, (weight * ratio[best]).astype(np.float32), float(bias))


def sample(
    documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS
) -> tuple[DataFrame, float]:
    """(text, label) of about max_rows / 2 rows of each label, and the bias that undoes the choice."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter(
        "label in (0, 1) and _id is not null"
    )
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keep = F.lit(False)
    share = {}
    for label, n in size.items():
        share[label] = min(1.0, max_rows / 2 / n)
        keep = keep | ((F.col("label") == label) & (place < share[label]))
    chosen = F.broadcast(known.filter(keep))  # about max_rows rows
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id")
    shift = float(np.log(share[0] / share[1])) if len(share) == 2 else 0.0
    return texts.select("text", "label"), shift


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_rows: int = MAX_ROWS,
) -> Model:
    """Model of the texts whose ids ``labels`` marks."""
    data, shift = sample(documents, labels, id_col, text_col, label_col, max_rows)
    model = fit(data, "text", "label", max_rows)
    return Model(model.slot, model.weight, model.bias + shift)


def score_texts(texts: list, slot: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(texts))
    for start, group in text_groups(texts):
        keys = []
        for row, cell in grams(group):
            found = slot[cell]
            hit = np.flatnonzero(found >= 0)
            keys.append(row[hit] * FEATURES + found[hit])
        both = np.unique(np.concatenate(keys))
        total = np.bincount(both // FEATURES, weight[both % FEATURES], len(group)) if len(both) else 0
        out[start : start + len(group)] = total
    return 1 / (1 + np.exp(-np.clip(out + bias, -500, 500)))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents' other columns with ``score`` and ``predicted``, without the text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.slot, model.weight, model.bias))
    others = [c for c in documents.columns if c not in (text_col, "score", "predicted")]
    docs = documents.select(*others, F.col(text_col).cast("string").alias("_text"))
    schema = docs.select(*others, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        for batch in batches:
            found = score_texts(batch.column(len(others)).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=[*others, "score", "predicted"],
            )

    return docs.mapInArrow(tidy(run), schema)


def without_toxic(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = score_texts(batch.column(at).cast(pa.string()).to_pylist(), *shared.value)
            yield batch.filter(pa.array(found < 0.5))

    return documents.mapInArrow(tidy(run), documents.schema)
