"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles (lower-cased A-Z). Two
documents link when 100 * |A n B| >= percent * |A u B|. Shingles are ordered from
rare to frequent; a document's l-prefix is its first n - t + l shingles, where t is
the least overlap that any partner must have. Linked documents share at least l
shingles of their l-prefixes, so each document picks the l whose estimated cost
(postings read, plus candidates left to verify) is least, and a pair is verified
only when it shares min(l_a, l_b) shingles of that prefix.

How often a shingle occurs is counted over all documents in a fixed number of
cells (a hash of the shingle), so the order costs the same memory at every size;
cells shared by chance change the order, never the result.

Before sets are compared, pairs are dropped by marks: 1024 bits per set, each the parity
of the shingles that fall on it. Marks of two sets differ in no more places than the
sets do, and linked sets differ in at most (100 - percent) / (100 + percent) of the sum
of their sizes. The test is part of the join of posting lists, so near misses of a large
group don't become rows.

No group is expanded into all its pairs: documents of equal sets are one node; then
each posting list links its nodes to one leader per list and size band, each node only
to the leader that it shares most with, so a round compares no more pairs than there
are nodes; rounds end when they join little. What is left are pairs of nodes of
different components, as one row each, however many shingles they share: where the
marks tell sets apart, a pair is made at the least shared shingle that both nodes' few
least shingles name. Of these, one and then up to 16 likely pairs of each two components
are compared before all that are still apart, since one link joins two components. New
links join the components known by then, not the graph from its start. Sets are made
from the texts for each step, only those that a pair left by the marks names.

Nulls and empty texts: n_shingles 0, linked with nothing, component_id = id. Equal
texts are one node, whatever their ids. Rows that share an id are each reported; a
row without an id gets the component_id of its group, null when the group holds no id.
Columns other than id and text are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import bounded_batches, mix64, pack, partitions_of, shingle_sets, slices, tidy, unpack
from weft.llm.graph import components
from weft.session import cut_lineage

CELL_BITS = 20
MOST_MATCHES = 8
VERIFY_COST = 4.0
FLUSH = 500_000
BUCKET_SHINGLES = 8_000_000
BAND = 1.25
LEAST_GAIN = 20
SMALL_ROWS = 500_000
MARK_BITS = 1024
MARKS = [f"m{k}" for k in range(MARK_BITS // 64)]
LEAST_TOKENS = 8


def _node(s: np.ndarray) -> int:
    """64-bit name of a set: equal sets have equal names."""
    if not len(s):
        return 0
    total = mix64(s).sum(dtype=np.uint64)
    return int(mix64(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def marks_of(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles on each of ``MARK_BITS`` places, by bits that name no cell, as longs."""
    place = ((s >> np.uint64(CELL_BITS)) & np.uint64(MARK_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=MARK_BITS).astype(np.uint8) & 1).view(np.int64)


def marks_differ(other: str = "_b") -> Column:
    """Number of places in which the marks differ from those with the suffix."""
    differ = F.lit(0)
    for m in MARKS:
        differ = differ + F.bit_count(F.col(m).bitwiseXOR(F.col(m + other)))
    return differ


def marks_allow(percent: int, other: str = "_b") -> Column:
    """The marks, and those with the suffix, differ in no more places than two linked sets of sizes n and other can."""
    return marks_differ(other) * (100 + percent) <= (F.col("n") + F.col("other")) * (100 - percent)


def marks_tell(percent: int) -> Column:
    """Sets of sizes n and other are so small that the marks of unlike ones differ in many more places than linked ones may."""
    return (F.col("n") + F.col("other")) * (100 - percent) * 4 <= MARK_BITS * (100 + percent)


def least_tokens(lists: DataFrame) -> DataFrame:
    """(node, least): the least few tokens of each node, of those that count for every pair (level 1)."""
    held = lists.filter("level = 1").groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("least"))
    return held.select("node", F.slice("least", 1, LEAST_TOKENS).alias("least"))


def first_shared(other: str = "_b") -> Column:
    """False if both nodes' least tokens name a shared one below this: that row makes the pair. True for the least shared one."""
    named = F.array_min(F.array_intersect("least", f"least{other}"))
    return F.coalesce(named >= F.col("token"), F.lit(True))


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """(id, set) of every row of (id, text) batches."""
    for batch in batches:
        for part in slices(batch, "text"):
            yield from zip(part.column(0).to_pylist(), shingle_sets(part.column(1), width))


def _count(width: int):
    """Task: name and size of each document's set, and cell counts of the task's distinct sets."""

    def run(batches):
        cells, seen = np.zeros(1 << CELL_BITS, np.int64), set()
        rows, waiting, held = [], [], 0

        def flush():
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int32()),
                    pa.nulls(len(rows), pa.binary()),
                    *[pa.array(m) for m in np.array([r[3] for r in rows], np.int64).reshape(-1, len(MARKS)).T],
                ],
                names=["id", "n", "node", "chunk", "payload", *MARKS],
            )
            rows.clear()
            return out

        for key, s in _sets(batches, width):
            node = _node(s)
            rows.append((key, len(s), node, marks_of(s)))
            if node not in seen:
                seen.add(node)
                waiting.append((s & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64))
                held += len(s)
            if held >= FLUSH:
                cells += np.bincount(np.concatenate(waiting), minlength=len(cells))
                waiting.clear()
                held = 0
            if len(rows) >= 20_000:
                yield flush()
        yield flush()
        if waiting:
            cells += np.bincount(np.concatenate(waiting), minlength=len(cells))
        if seen:
            chunks = [pack(c.astype(np.uint32)) for c in cells.reshape(16, -1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.nulls(16, pa.int64()) for _ in range(3)],
                    pa.array(range(16), pa.int32()), pa.array(chunks, pa.binary()),
                    *[pa.nulls(16, pa.int64()) for _ in MARKS],
                ],
                names=["id", "n", "node", "chunk", "payload", *MARKS],
            )

    return run


def _add_cells(group: pa.Table) -> pa.Table:
    total = sum(unpack(v)[0].astype(np.int64) for v in group.column("payload").to_pylist())
    return pa.table({"chunk": group.column("chunk")[:1], "payload": pa.array([pack(total)], pa.binary())})


def choose_matches(counts: np.ndarray, base: int, most: int) -> int:
    """Number of required matches of least estimated cost.

    ``counts`` estimate how many documents hold each shingle, in prefix order;
    ``base`` is the length of the 1-prefix. A candidate that must match l times
    uses up l postings, so at most postings / l remain to be verified.
    """
    if most <= 1:
        return 1
    read = np.cumsum(counts[: base + most - 1])[base - 1 :]
    cost = read + VERIFY_COST * read / np.arange(1, len(read) + 1)
    return int(np.argmin(cost)) + 1


def _prefixes(width: int, percent: int, buckets: int, cells_of):
    """Task: prefix shingles of the task's distinct sets, packed by bucket of the shingle."""
    mask = np.uint64((1 << CELL_BITS) - 1)

    def run(batches):
        cells = cells_of()
        mean = cells.sum() / len(cells)
        noise, hot = mean + 2 * np.sqrt(mean), max(cells.sum() / (4 * buckets), 4 * mean + 1000)
        seen: set = set()
        tokens, owners, levels, nodes, sizes, matches = [], [], [], [], [], []
        held = 0

        def flush():
            token, owner, level = np.concatenate(tokens), np.concatenate(owners), np.concatenate(levels)
            name, size, need = np.array(nodes, np.int64), np.array(sizes, np.uint32), np.array(matches, np.uint8)
            often = cells[(token & mask).astype(np.int64)] >= hot
            where = (token >> np.uint64(CELL_BITS)) + np.where(often, mix64(name[owner].view(np.uint64)), np.uint64(0))
            bucket = (where % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((token, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out_b, out_p = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[b] : cuts[b + 1]]
                mine, local = np.unique(owner[at], return_inverse=True)
                out_b.append(int(b))
                out_p.append(pack(token[at], local.astype(np.uint32), level[at], often[at], name[mine], size[mine], need[mine]))
            for x in (tokens, owners, levels, nodes, sizes, matches):
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(out_b, pa.int32()), pa.array(out_p, pa.binary())], names=["bucket", "payload"]
            )

        for _, s in _sets(batches, width):
            n = len(s)
            node = _node(s)
            if not n or node in seen:
                continue
            seen.add(node)
            count = cells[(s & mask).astype(np.int64)]
            order = np.argsort(count, kind="stable")
            least = -(-percent * n // 100)
            base = n - least + 1
            estimate = np.maximum(count[order[: base + MOST_MATCHES - 1]] - noise, 0) + 1
            need = choose_matches(estimate, base, min(MOST_MATCHES, least))
            length = base + need - 1
            tokens.append(s[order[:length]])
            owners.append(np.full(length, len(nodes), np.int64))
            levels.append(np.maximum(np.arange(length) - base + 2, 1).astype(np.uint8))
            nodes.append(node)
            sizes.append(n)
            matches.append(need)
            held += length
            if held >= FLUSH:
                yield flush()
                held = 0
        if nodes:
            yield flush()

    return run


def _lead_pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, need: np.ndarray, percent: int):
    """(a, b, shared, least) of the least node of each shingle and size band with the band's other nodes."""
    band = np.floor(np.log(n) / np.log(BAND)).astype(np.int64)
    order = np.lexsort((node, band, token))
    t, w, node, n, need = token[order], band[order], node[order], n[order].astype(np.int64), need[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    fit = ~first & (100 * np.minimum(n, n[lead]) >= percent * np.maximum(n, n[lead]))
    a, b, least = node[lead[fit]], node[fit], np.minimum(need[fit], need[lead[fit]])
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(fresh)
    return a[at], b[at], np.diff(np.append(at, len(a))), least[at]


def _lists(percent: int):
    """Group: postings of the shingles of one bucket that more than one node holds, and pairs with their leaders.

    The first round of leaders needs no shuffle of its own: rows without a token are its
    pairs (node, other), with the shingles shared as n and those required as need.
    """

    def run(group: pa.Table) -> pa.Table:
        token, node, n, level, need = _postings(group)
        a, b, shared, least = _lead_pairs(token, node, n, need, percent)
        none = pa.nulls(len(a), pa.int64())

        def column(kind, x, y):
            return pa.chunked_array([pa.array(x.astype(kind)), pa.array(y.astype(kind))])

        return pa.table(
            {
                "token": pa.chunked_array([pa.array(token.view(np.int64)), none]), "node": column(np.int64, node, a),
                "n": column(np.int32, n, shared), "level": column(np.int32, level, np.zeros(len(a))),
                "need": column(np.int32, need, least),
                "other": pa.chunked_array([pa.nulls(len(token), pa.int64()), pa.array(b.astype(np.int64))]),
            }
        )

    return run


def _postings(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(token, node, n, level, need) of shingles that more than one node of the group's lists holds."""
    parts = [unpack(v) for v in group.column("payload").to_pylist()]
    token = np.concatenate([p[0] for p in parts])
    node = np.concatenate([p[4][p[1]] for p in parts])
    size = np.concatenate([p[5][p[1]] for p in parts])
    need = np.concatenate([p[6][p[1]] for p in parts])
    level = np.concatenate([p[2] for p in parts])
    often = np.concatenate([p[3] for p in parts])
    order = np.lexsort((node, token))
    t, d = token[order], node[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    order, t = order[fresh], t[fresh]
    same = t[1:] == t[:-1]
    keep = often[order]
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    return token[order], node[order], size[order], level[order], need[order]


LIST_SCHEMA = "token long, node long, n int, level int, need int, other long"


def _set_rows(width: int):
    def run(batches):
        names, values, held = [], [], 0
        for _, s in _sets(batches, width):
            names.append(_node(s))
            values.append(s.tobytes())
            held += len(s)
            if held >= FLUSH:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(values, pa.binary())], names=["node", "shingles"]
                )
                names, values, held = [], [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(values, pa.binary())], names=["node", "shingles"]
        )

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            u, v, last, left = [], [], None, None
            for x, y, p, q in zip(a, b, batch.column("sa"), batch.column("sb")):
                if x != last:
                    last, left = x, np.frombuffer(p.as_buffer(), np.uint64)
                right = np.frombuffer(q.as_buffer(), np.uint64)
                long, short = (left, right) if len(left) >= len(right) else (right, left)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                shared = int((long[at] == short).sum())
                if 100 * shared >= percent * (len(left) + len(right) - shared):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def merged(joined: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) after new links of nodes, and how many links joined two components.

    Only components that a new link names are joined anew; a component is named by its
    least node, so the least of those joined names the whole.
    """
    names = joined.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    apart = found.join(names, "u", "left").join(names.toDF("v", "cv"), "v", "left").select(
        F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")
    )
    apart = cut_lineage(apart.filter("u != v").distinct(), "links")
    new = apart.count()
    if not new:
        return joined, 0
    changed = components(apart)
    after = changed.select(F.col("node").alias("component"), F.col("component").alias("_now"))
    moved = joined.join(after, "component", "left").select("node", F.coalesce("_now", "component").alias("component"))
    return cut_lineage(moved.union(changed).distinct(), "components"), new


def links(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(keys, classes, joined): id, n and node of each row; least id of each node; component of each linked node.

    A component is named by its least node.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = ", ".join(["id long, n long, node long, chunk int, payload binary", *[f"{m} long" for m in MARKS]])
    first = cut_lineage(docs.mapInArrow(tidy(_count(width)), counted), "shingle-keys")
    rows = first.filter("chunk is null").drop("chunk", "payload")
    keys = rows.select("id", "n", "node")
    added = first.filter("chunk is not null").select("chunk", "payload").groupBy("chunk").applyInArrow(
        _add_cells, "chunk int, payload binary"
    )
    # 16 rows, 1 << CELL_BITS counts in all, whatever the input.
    cells = [unpack(bytes(r["payload"]))[0] for r in sorted(added.collect(), key=lambda r: r["chunk"])]
    classes = keys.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    if not cells:
        return keys, classes, None
    classes = cut_lineage(classes, "classes")
    counts = np.concatenate(cells)
    shared = spark.sparkContext.broadcast(counts)
    buckets = max(4 * partitions_of(spark), int(counts.sum()) // BUCKET_SHINGLES)
    packed = docs.select("id", "text").mapInArrow(
        tidy(_prefixes(width, percent, buckets, lambda: shared.value)), "bucket int, payload binary"
    )
    listed = cut_lineage(packed.groupBy("bucket").applyInArrow(tidy(_lists(percent)), LIST_SCHEMA), "postings")
    postings = listed.filter("token is not null").drop("other")

    def marks_with(nodes: DataFrame) -> DataFrame:
        """Marks of the given nodes, a row per node; rows of equal node have equal marks."""
        return rows.filter("n > 0").join(nodes, "node", "left_semi").select("node", "n", *MARKS).dropDuplicates(["node"])

    def verified(pairs: DataFrame, marked: bool) -> DataFrame:
        """Linked pairs, repeats possible. Pairs go by their marks, then only sets that a pair left names are made and moved."""

        def named(pairs: DataFrame) -> DataFrame:
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
            return F.broadcast(nodes) if few else nodes

        many = pairs.count()
        few, none = many <= SMALL_ROWS, pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("false")
        if not many:
            return none
        if not marked:
            own = marks_with(named(pairs))
            left = own.select(F.col("node").alias("a"), "n", *MARKS)
            right = own.select(
                F.col("node").alias("b"), F.col("n").alias("other"), *[F.col(m).alias(f"{m}_b") for m in MARKS]
            )
            pairs = pairs.join(left, "a").join(right, "b").filter(marks_allow(percent)).select("a", "b")
            pairs = cut_lineage(pairs, "marked-pairs")
            many = pairs.count()
            few = many <= SMALL_ROWS
            if not many:
                return none
        holders = classes.join(named(pairs), "node", "left_semi").select(F.col("id").alias("holder")).distinct()
        texts = docs.join(F.broadcast(holders) if few else holders, F.col("id").eqNullSafe(F.col("holder")), "left_semi")
        sets = texts.mapInArrow(tidy(_set_rows(width)), "node long, shingles binary")
        sets = cut_lineage(sets.join(named(pairs), "node", "left_semi"), "sets")
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        left = left.join(F.broadcast(pairs.select("a").distinct()) if few else pairs.select("a").distinct(), "a", "left_semi")
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = right.join(F.broadcast(pairs) if few else pairs, "b").join(left.hint("merge"), "a")
        return both.select("a", "b", "sa", "sb").mapInArrow(tidy(_verify(percent)), "u long, v long")

    def within(table: DataFrame, joined: DataFrame, node: str, comp: str) -> DataFrame:
        """The table with the component that each node is in by now."""
        named = joined.select(F.col("node").alias(node), F.col("component").alias("_now"))
        return table.join(named, node, "left").withColumn(comp, F.coalesce("_now", node)).drop("_now")

    def best(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b, shared, least) that share enough, the one of each b that shares most."""
        most = F.max_by("a", F.struct("shared", "a")).alias("a")
        return cut_lineage(pairs.filter("shared >= least").groupBy("b").agg(most).select("a", "b"), "pairs")

    alike = f"100 * least(n, other) >= {percent} * greatest(n, other)"
    pairs = listed.filter("token is null").groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(
        F.sum("n").alias("shared"), F.first("need").alias("least")
    )
    joined = classes.select("node", F.col("node").alias("component")).filter("false")
    joined, new = merged(joined, verified(best(pairs), marked=False))
    total = new
    banded = postings.withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    current = cut_lineage(within(banded, joined, "node", "comp"), "postings")
    # What leaders don't find, the pairs below do: rounds end when they join little.
    while new * LEAST_GAIN > total:
        lead = current.groupBy("token", "band").agg(
            F.min(F.struct("comp", "node", "n", "need")).alias("lead"), F.max("comp").alias("last")
        ).filter("lead.comp < last").drop("last")
        met = current.join(lead.hint("merge"), ["token", "band"]).filter("comp != lead.comp")
        met = met.withColumn("other", F.col("lead.n")).filter(alike)
        pairs = met.groupBy(F.col("lead.node").alias("a"), F.col("node").alias("b")).agg(
            F.count(F.lit(1)).alias("shared"), F.first(F.least("need", "lead.need")).alias("least")
        )
        joined, new = merged(joined, verified(best(pairs), marked=False))
        total += new
        if new:
            current = cut_lineage(within(banded, joined, "node", "comp"), "postings")
    several = current.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    open_lists = cut_lineage(
        current.join(several.select("token").hint("merge"), "token", "left_semi").drop("band"), "open-lists"
    )
    if open_lists.isEmpty():
        return keys, classes, joined
    marks = rows.filter("n > 0").select("node", *MARKS).dropDuplicates(["node"])
    marks = marks.join(least_tokens(open_lists).hint("merge"), "node", "left")
    left = cut_lineage(open_lists.join(marks.hint("merge"), "node"), "marked-lists")
    right = left.select(
        "token", F.col("node").alias("b"), F.col("n").alias("other"), F.col("level").alias("level_b"),
        F.col("need").alias("need_b"), F.col("comp").alias("comp_b"), F.col("least").alias("least_b"),
        *[F.col(m).alias(f"{m}_b") for m in MARKS],
    )
    rest = left.join(right.hint("merge"), "token").filter("comp < comp_b").filter(alike).filter(
        "level <= least(need, need_b) and level_b <= least(need, need_b)"
    ).filter(marks_allow(percent)).filter(~marks_tell(percent) | first_shared())
    rest = rest.select(
        F.col("node").alias("a"), "b", "comp", "comp_b", F.least("need", "need_b").alias("asked"),
        marks_tell(percent).alias("told"), (marks_differ() / (F.col("n") + F.col("other"))).alias("apart"),
    ).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("asked", "told", "apart", "comp", "comp_b")]
    ).filter("told or shared >= asked").drop("asked", "told", "shared")
    rest = cut_lineage(rest, "pairs")
    # One link joins two components: likely pairs of each two come first, then all pairs still apart.
    for slots in (1, 16, None):
        if rest.isEmpty():
            break
        step = rest
        if slots:
            likely = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("pair")
            slot = F.pmod(F.xxhash64("a", "b"), F.lit(slots))
            step = rest.groupBy("comp", "comp_b", slot.alias("slot")).agg(likely).select("pair.a", "pair.b")
            step = cut_lineage(step, "likely-pairs")
            rest = rest.join(step, ["a", "b"], "left_anti")
        joined, new = merged(joined, verified(step.select("a", "b"), marked=True))
        if slots:
            if new:
                rest = within(within(rest, joined, "a", "comp"), joined, "b", "comp_b").filter("comp != comp_b")
            rest = cut_lineage(
                rest.withColumn("low", F.least("comp", "comp_b")).withColumn("comp_b", F.greatest("comp", "comp_b"))
                .withColumn("comp", F.col("low")).drop("low"),
                "pairs",
            )
    return keys, classes, joined


def _grouped(documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, node, component, component_id) of every row; component is the least node reachable by links."""
    keys, classes, joined = links(documents, id_col, text_col, width, percent)
    named = classes.select("node", "id")
    if joined is not None:
        joined = named.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
        named = joined.join(least, "component").select("node", "component", "component_id")
    else:
        named = named.select("node", F.col("node").alias("component"), F.col("id").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return keys.join(named, "node", "left").withColumn("component_id", own)


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row."""
    found = _grouped(documents, id_col, text_col, width, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _nodes(width: int):
    """Task: (id, text, node) of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                nodes = [_node(s) for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes, pa.int64())], names=["id", "text", "node"]
                )

    return run


def without_copies(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One document of each group: the one of least id. Rows without an id, and without words, stay.

    Where rows share an id, each text goes by its own group: rows of one id and one set of
    shingles are reduced to one, and of several near copies under the least id one stays.
    """
    found = cut_lineage(_grouped(documents, id_col, text_col, width, percent), "groups").filter("id is not null")
    shared = found.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    losers = found.filter("id != component_id").select("id").union(shared).distinct()
    name = documents[id_col].cast("long")
    kept = documents.join(losers, name == losers["id"], "left_anti")
    if shared.isEmpty():
        return kept
    again = documents.select(name.alias("id"), documents[text_col].cast("string").alias("text")).join(shared, "id", "left_semi")
    again = again.distinct().mapInArrow(tidy(_nodes(width)), "id long, text string, node long")
    first = found.filter("n > 0 and id = component_id").groupBy("component").agg(F.min("node").alias("node"), F.min("id").alias("id"))
    stay = first.select("id", "node").union(found.filter("n = 0").select("id", "node").distinct())
    # One text for each id and set that stays, then one row of that id and text.
    chosen = again.join(stay, ["id", "node"], "left_semi").groupBy("id", "node").agg(F.min(F.struct("text")).alias("least"))
    chosen = chosen.select("id", F.col("least.text").alias("text"))
    same = (name == chosen["id"]) & documents[text_col].cast("string").eqNullSafe(chosen["text"])
    return kept.union(documents.join(chosen, same, "left_semi").dropDuplicates([id_col, text_col]))
