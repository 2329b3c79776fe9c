"""Removal of repeated byte strings by bucket-pointer refinement.

Texts are UTF-8 bytes. A byte goes if a string of ``WIDTH`` bytes that covers it also
starts anywhere else, in the same text or another; matches never cross texts.

Suffixes are put into buckets by their first bytes, and buckets are refined by the
bucket identifiers that the same suffixes have at later offsets: the bucket of 2 L
bytes follows from the buckets of L bytes at offsets 0 and L, and each result is used
again for the next length. A bucket of one is done, as a string that holds a unique
one is unique.

1. Each start of ``WIDTH`` bytes has an anchor: the first of the least ``GRAM``-grams
   (by identifier) that begin in it. Equal strings have equal anchors at equal offsets,
   so only suffixes at anchors, about 1.4 % of all, are put into buckets. An anchor
   stands for its run of starts.
2. A bucket of anchors is refined by the identifiers of ``WIDTH`` bytes at both ends of
   the run: equal ones have equal bytes over the whole run (a class). All starts of a
   class of two or more are repeated. Classes are counted inside each batch first.
3. Buckets that still hold a class of one are refined start by start: bytes of its
   anchors and of one anchor per other class meet in bins of many buckets and are
   refined there by exact ranks, 8, 16, ... ``WIDTH`` bytes. A bucket over ``MOST``
   anchors is refined by counting its starts' identifiers over all tasks instead.

Anchors travel with two hashes of their text and their place in it, so repeated rows
and ids, null ids among them, need no key: equal texts share results. Identifiers of
stages 1 and 2 are 64-bit hashes (a wrong match needs equal hashes of different
strings); stage 3 compares bytes, or 128 bits.

Null texts are empty; texts under ``WIDTH`` bytes stay whole. All columns of the input
are returned, whatever their names, but for those that ``marks`` names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from weft.llm.common import SLICE_BYTES, bounded_batches, mix64, ranges, slices, text_bytes, tidy
from weft.session import cut_lineage

WIDTH = 200
GRAM = 32
#: Anchors of one bucket that one task may refine, and anchors aimed at per bin.
MOST = 4096
PER_BIN = 4096
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = 1 << 13


def later(a: np.ndarray, offset: int) -> np.ndarray:
    """Values ``offset`` places later; zeros behind the end."""
    out = np.zeros_like(a)
    if offset < len(a):
        out[: len(a) - offset] = a[offset:]
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a pair of bucket identifiers."""
    return mix64((a * _FIRST) ^ (b + _SECOND))


def identifiers(raw: np.ndarray, length: int, also: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of ``length`` and of ``also`` bytes (a power of two from 8 to ``length``) at each position.

    They are of use where so many bytes follow.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    now = mix64(np.ndarray((len(raw),), dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64))
    known, kept = 8, now
    while known < length:
        step = min(known, length - known)
        now = joined(now, later(now, step))
        known += step
        if known == also:
            kept = now
    return now, kept


def windows_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each position on, fewer at the end."""
    out, known = values.copy(), 1
    while known < width:
        step = min(known, width - known)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        known += step
    return out


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start, bucket, class) of each anchor's run, places in ``raw``."""
    none = np.zeros(0, np.int64)
    if len(raw) < WIDTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    whole, gram = identifiers(raw, WIDTH, GRAM)
    width = WIDTH - GRAM + 1
    least = windows_least(gram, width)
    length = np.diff(at)
    # A start holds WIDTH bytes of its own text.
    starts = np.zeros(len(raw) + 1, np.int8)
    full = length >= WIDTH
    np.add.at(starts, at[:-1][full], 1)
    np.add.at(starts, (at[1:] - WIDTH + 1)[full], -1)
    start = np.cumsum(starts[:-1]).astype(bool)
    last = start.copy()
    last[:-1] &= (gram[:-1] == least[:-1]) | (least[1:] != least[:-1]) | ~start[1:]
    last = np.flatnonzero(last)
    if not len(last):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    row = np.searchsorted(at, last, side="right") - 1
    first = np.maximum(np.r_[0, last[:-1] + 1], at[row])
    # The anchor lies at the last start itself or behind it.
    anchor = last.copy()
    away = np.flatnonzero(gram[last] != least[last])
    for k in range(0, len(away), _PIECE):
        some = last[away[k : k + _PIECE]]
        anchor[away[k : k + _PIECE]] += np.argmax(gram[some[:, None] + np.arange(width)] == least[some][:, None], axis=1)
    place = ((anchor - first) * 512 + (anchor - last)).astype(np.uint64)
    return row, first, last, least[last], joined(joined(whole[first], whole[last]), place)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(rows, row, first, last, bucket, class) of the anchors of each slice; starts are places within the text.

    A text over ``SLICE_BYTES`` is read in pieces; a run that a piece's end cuts is two runs.
    """
    for part in slices(batch, "text"):
        raw, at = text_bytes(part.column(part.schema.get_field_index("text")))
        if part.num_rows > 1 or len(raw) <= SLICE_BYTES:
            row, first, last, bucket, kind = anchors(raw, at)
            yield part, row, first - at[row], last - at[row], bucket, kind
            continue
        for k in range(0, len(raw) - WIDTH + 1, SLICE_BYTES):
            piece = raw[k : k + SLICE_BYTES + WIDTH - 1]
            row, first, last, bucket, kind = anchors(piece, np.array([0, len(piece)]))
            yield part, row, first + k, last + k, bucket, kind


def _count_classes(incoming):
    """Task: (bucket, kind, n) of the distinct classes of each slice."""
    for batch in incoming:
        for _, _, _, _, bucket, kind in _sliced(batch):
            order = np.lexsort((kind, bucket))
            bucket, kind = bucket[order], kind[order]
            new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])][: len(bucket)])
            n = np.diff(np.r_[new, len(bucket)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[new].view(np.int64)), pa.array(kind[new].view(np.int64)), pa.array(n, pa.int64())],
                names=["bucket", "kind", "n"],
            )


def place_of(k2: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Part of the second hash (24 bits), first start (32 bits) and further starts (8 bits) as one long."""
    return ((k2.view(np.uint64) >> np.uint64(40)) << np.uint64(40) | (first << 8 | (last - first)).astype(np.uint64)).view(np.int64)


def starts_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of places."""
    first = (place >> 8) & 0xFFFFFFFF
    return first, first + (place & 0xFF)


def _send_anchors(incoming):
    """Task: (kind, k1, place) of each anchor."""
    for batch in incoming:
        for part, row, first, last, _, kind in _sliced(batch):
            k1, k2 = _column(part, "k1"), _column(part, "k2")
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind.view(np.int64)), pa.array(k1[row]), pa.array(place_of(k2[row], first, last))],
                names=["kind", "k1", "place"],
            )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null lists are empty."""
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _column(part, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _send_bytes(incoming):
    """Task: the bytes of the wanted runs of each text; equal texts lie together and count once."""
    before = None
    for batch in incoming:
        for part in slices(batch, "text"):
            key = np.stack([_column(part, "k1"), _column(part, "k2")], axis=1)
            new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
            new[0] = before is None or bool((key[0] != before).any())
            before = key[-1]
            part = part.filter(pa.array(new))
            raw, at = text_bytes(part.column(part.schema.get_field_index("text")))
            asked = part.column(part.schema.get_field_index("asked"))
            counts = np.diff(asked.offsets.to_numpy())
            asked = asked.flatten()
            place = asked.field("place").to_numpy()
            row = np.repeat(np.arange(part.num_rows), counts)
            first, last = starts_of(place)
            size = last - first + WIDTH
            data = raw[ranges(first + at[row], size)]
            runs = pa.Array.from_buffers(
                pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(data)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [asked.field("bucket"), asked.field("size"), pa.array(_column(part, "k1")[row]), asked.field("place"), asked.field("wanted"), runs],
                names=["bucket", "size", "k1", "place", "wanted", "run"],
            )


def repeated_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in ``raw`` of the starts whose ``WIDTH`` bytes, within one run, occur twice or more.

    Initial buckets of 8 bytes are refined by the buckets at a later offset until they
    cover ``WIDTH`` bytes; exact ranks name the buckets, and a bucket of one is dropped.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    values = np.ndarray((len(raw),), dtype="<u8", buffer=padded, strides=(1,))
    length = np.diff(at)
    live = ranges(at[:-1], np.maximum(length - 7, 0))
    end = np.repeat(at[1:], np.maximum(length - 7, 0))
    rank = np.full(len(raw), -1, np.int64)
    known, keys = 8, values[live]
    while True:
        _, bucket, n = np.unique(keys, return_inverse=True, return_counts=True)
        several = n[bucket] > 1
        live, end, bucket = live[several], end[several], bucket[several]
        if known == WIDTH or not len(live):
            return live
        rank[:] = -1
        rank[live] = bucket
        step = min(known, WIDTH - known)
        # Both halves must have a bucket, and the text so many bytes.
        here = np.flatnonzero(live + known + step <= end)
        here = here[rank[live[here] + step] >= 0]
        live, end = live[here], end[here]
        keys = rank[live].astype(np.uint64) * np.uint64(len(n)) + rank[live + step].astype(np.uint64)
        known += step


def _runs(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of maximal runs of sorted places of one owner."""
    new = np.r_[True, (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])][: len(places)]
    cuts = np.flatnonzero(new)
    return owner[cuts], places[cuts], places[np.r_[cuts[1:], len(places)] - 1] if len(cuts) else places


def _bytes_of(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array."""
    runs = runs.cast(pa.large_binary())
    _, offsets, data = runs.buffers()
    at = np.frombuffer(offsets, np.int64)[runs.offset : runs.offset + len(runs) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


SPANS = "k1 long, place long, first long, last long"


def _refine_bin(group: pa.Table) -> pa.Table:
    """Runs of repeated starts, within their text, of the anchors of one bin."""
    pair = np.stack([group.column(k).to_numpy() for k in ("k1", "place")], axis=1)
    group = group.take(pa.array(np.unique(pair, axis=0, return_index=True)[1]))
    raw, at = _bytes_of(group.column("run").combine_chunks())
    found = repeated_starts(raw, at)
    owner = np.searchsorted(at, found, side="right") - 1
    wanted = group.column("wanted").to_numpy()
    found, owner = found[wanted[owner]], owner[wanted[owner]]
    owner, low, high = _runs(found, owner)
    k1, place = (group.column(k).to_numpy() for k in ("k1", "place"))
    first, _ = starts_of(place[owner])
    return pa.table({"k1": k1[owner], "place": place[owner], "first": low - at[owner] + first, "last": high - at[owner] + first})


def _send_starts(incoming):
    """Task: (one, two, k1, place, start, wanted) of each start of large buckets' anchors."""
    for batch in incoming:
        for k in range(0, batch.num_rows, MOST):
            part = batch.slice(k, MOST)
            raw, at = _bytes_of(part.column(part.schema.get_field_index("run")))
            count = np.diff(at) - WIDTH + 1
            here = ranges(at[:-1], count)
            owner = np.repeat(np.arange(part.num_rows), count)
            one, _ = identifiers(raw, WIDTH)
            two, _ = identifiers(raw ^ np.uint8(0xA5), WIDTH)
            place = _column(part, "place")[owner]
            first, _ = starts_of(place)
            columns = [
                one[here].view(np.int64), two[here].view(np.int64), _column(part, "k1")[owner], place,
                here - at[owner] + first, _column(part, "wanted")[owner],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "k1", "place", "start", "wanted"])


def _cut(incoming):
    """Task: removed spans and kept bytes of each text."""
    for batch in incoming:
        for part in slices(batch, "text"):
            text = part.column(part.schema.get_field_index("text"))
            raw, at = text_bytes(text)
            cover = np.zeros(len(raw) + 1, np.int32)
            for name in ("places", "spans"):
                packed, listed = _lists(part.column(part.schema.get_field_index(name)))
                begin = np.repeat(at[:-1], np.diff(listed))
                first, last = starts_of(packed) if name == "places" else (packed >> 32, packed & 0xFFFFFFFF)
                np.add.at(cover, first + begin, 1)
                np.add.at(cover, last + WIDTH + begin, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept_at = np.r_[0, np.cumsum(~gone)][at]
            edge = np.zeros(len(raw) + 1, bool)
            edge[at] = True
            starts = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]][: len(gone)]))
            ends = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False][: len(gone)])) + 1
            per = np.searchsorted(starts, at)
            own = np.repeat(at[:-1], np.diff(per))
            offsets = pa.array(per.astype(np.int32))
            kept = pa.Array.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(raw[~gone])]
            ).cast(pa.binary())
            columns = [
                part.column(part.schema.get_field_index("row")), text, pa.array(np.diff(at)),
                pa.array(np.diff(at) - np.diff(kept_at)), pa.ListArray.from_arrays(offsets, pa.array(starts - own)),
                pa.ListArray.from_arrays(offsets, pa.array(ends - own)), kept,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_bytes", "n_removed", "starts", "ends", "kept"])


TOP = -(1 << 40)
MADE = "n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def repeats(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(k1, k2, places, spans) of each text with repeated starts, from columns text, k1, k2.

    ``places`` are packed runs of starts (``starts_of``), ``spans`` further runs as
    first start << 32 | last start; k2 holds its leading 24 bits only.
    """
    counted = texts.select("text").mapInArrow(tidy(_count_classes), "bucket long, kind long, n long")
    counted = counted.repartition("bucket").groupBy("bucket", "kind").agg(F.sum("n").alias("n"))
    over = "over (partition by bucket)"
    classes = counted.withColumns(
        {"members": F.expr(f"sum(n) {over}"), "open": F.expr(f"min(n) {over}") == 1, "size": F.expr(f"count(*) {over}")}
    ).filter("members > 1")
    classes = classes.select("kind", "n", F.when(F.col("open"), F.struct("bucket", "kind", "size")).alias("refined"))
    sent = texts.mapInArrow(tidy(_send_anchors), "kind long, k1 long, place long")
    found = sent.join(classes, "kind").select("k1", "place", (F.col("n") > 1).alias("resolved"), "refined")
    found = cut_lineage(found, "anchors")
    own_text = F.col("place").bitwiseAND(F.lit(TOP)).alias("k2")

    # Of each class in a bucket that is still open one anchor; those of classes of one want to know.
    members = found.filter("refined is not null").groupBy("refined").agg(
        F.min(F.struct("k1", "place")).alias("own"), F.bool_or("resolved").alias("resolved")
    ).select("refined.bucket", "refined.size", "own.k1", "own.place", (~F.col("resolved")).alias("wanted"))
    members = cut_lineage(members, "members")
    asked = members.groupBy("k1", own_text).agg(F.collect_list(F.struct("bucket", "size", "place", "wanted")).alias("asked"))
    sent = texts.withColumn("k2", F.col("k2").bitwiseAND(F.lit(TOP))).join(asked, ["k1", "k2"])
    runs = sent.select("text", "k1", "k2", "asked").mapInArrow(
        tidy(_send_bytes), "bucket long, size long, k1 long, place long, wanted boolean, run binary"
    )
    runs = cut_lineage(runs, "runs")
    bins = 1 + members.filter(F.col("size") <= most).count() // PER_BIN
    binned = runs.filter(F.col("size") <= most).withColumn("bin", F.pmod(F.xxhash64("bucket"), F.lit(bins)))
    refined = binned.select("bin", "k1", "place", "run", "wanted").groupBy("bin").applyInArrow(tidy(_refine_bin), SPANS)
    large = runs.filter(F.col("size") > most).dropDuplicates(["k1", "place"]).select("k1", "place", "run", "wanted").mapInArrow(
        tidy(_send_starts), "one long, two long, k1 long, place long, start long, wanted boolean"
    )
    several = large.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two")
    single = large.filter("wanted").join(several, ["one", "two"])
    single = single.select("k1", "place", F.col("start").alias("first"), F.col("start").alias("last"))
    spans = refined.unionByName(single).groupBy("k1", own_text).agg(
        F.collect_set(F.shiftleft("first", 32).bitwiseOR(F.col("last"))).alias("spans")
    )
    places = found.filter("resolved").groupBy("k1", own_text).agg(F.collect_set("place").alias("places"))
    return places.join(spans, ["k1", "k2"], "full")


def remove_repeats(documents: DataFrame, text_col: str = "text", marks: str = "repeat", most: int = MOST) -> DataFrame:
    """``documents`` with a struct column ``marks``: n_bytes, n_removed, starts, ends, kept.

    ``starts`` and ``ends`` are the byte spans removed, maximal and in order; ``kept`` the
    other bytes, which need not be whole characters.
    """
    bounded_batches(documents.sparkSession)
    others = [c for c in documents.columns if c not in (text_col, marks)]
    row = F.struct(F.lit(True).alias("weft_row"), *[F.col(f"`{c}`").alias(c) for c in others])
    rows = documents.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"k1": F.xxhash64(known), "k2": F.xxhash64(F.lit(1), known)})
    found = repeats(rows.select("text", "k1", "k2"), most)
    marked = rows.withColumn("k2", F.col("k2").bitwiseAND(F.lit(TOP))).join(found, ["k1", "k2"], "left")
    made = StructType([rows.schema["row"], rows.schema["text"], *StructType.fromDDL(MADE).fields])
    cut = marked.select("row", "text", "places", "spans").mapInArrow(tidy(_cut), made)
    names = [
        F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in documents.columns if c != marks
    ]
    return cut.select(*names, F.struct("n_bytes", "n_removed", "starts", "ends", "kept").alias(marks))
