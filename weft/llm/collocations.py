"""Phrase collocations by stripes: each prefix keys a counter of the words that follow.

Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into
words ``[^\\x20\\x09]+``. All counts are per language; phrases have 1 to 3 words and lie
within a piece.

A task counts, over some million words, for each prefix of two words a stripe: how often
each next word, or the end of the piece, follows. Stripes go to the bucket of their
prefix, where they are added elementwise. All that is wanted comes out of the merged
stripes: extensions f(x y z), prefix totals f(x y) (the end mark makes a stripe's sum
the prefix's count) and, added over the stripes of x, f(x); and the greatest extension
of a prefix, which decides whether the prefix is subsumed. Extensions to the left are
the greatest candidates by their last two words.

A prefix of any frequency sends at most one count per next word and task. Buckets
are as many as the bytes of the texts ask for; a task of a bucket adds its messages a
few at a time, so it holds merged stripes and not all that was sent.

Words are named by 64-bit hashes of language and word; strings join at the end. Rows
without a language are ``und``; null and empty texts have no words; repeated rows and
ids count as often as they occur; other columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.llm.common import bounded_batches, hash_spans, mix64, pack, ranges, slices, text_bytes, tidy, unpack
from weft.session import cut_lineage

LEAST = 10
SUBSUMED = 50  # per cent
BEST = 2000
FLUSH_WORDS = 2_500_000
BUCKET_BYTES = 32 << 20
CHUNK_ENTRIES = 2_000_000
END = np.uint64(0)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_CUT = np.zeros(256, bool)
_IS_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_IS_GAP = _IS_CUT.copy()
_IS_GAP[list(b" \t")] = True


def named_words(texts: pa.Array, languages: pa.Array) -> tuple:
    """(name, follows, start, end, row, raw): words in order, and whether the next one follows in the same piece."""
    raw, at = text_bytes(texts)
    raw = _LOWERED[raw]
    inside = ~_IS_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]][: len(raw)]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False][: len(raw)])) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    cuts = np.r_[0, np.cumsum(_IS_CUT[raw])][starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (cuts[1:] == cuts[:-1])
    tongue, tongue_at = text_bytes(languages)
    tongue = hash_spans(tongue, tongue_at[:-1], tongue_at[1:])
    return mix64(mix64(hash_spans(raw, starts, ends)) + tongue[row]), follows, starts, ends, row, raw


def _column(batch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def counted(name: np.ndarray, follows: np.ndarray, size: int) -> tuple:
    """(vocabulary, x, y, z, n) of the first ``size`` places: distinct triples as places in the vocabulary, sorted.

    Place 0 is the end of the piece. Up to two words more may be given, as followers.
    """
    vocabulary, own = np.unique(name, return_inverse=True)
    own = np.r_[own + 1, 0, 0]
    after = np.r_[follows, False, False]
    y = np.where(after[:size], own[1 : size + 1], 0)
    z = np.where(after[:size] & after[1 : size + 1], own[2 : size + 2], 0)
    base = np.uint64(len(vocabulary) + 1)
    keys, n = np.unique((own[:size].astype(np.uint64) * base + y.astype(np.uint64)) * base + z.astype(np.uint64), return_counts=True)
    prefix, z = keys // base, keys % base
    return np.r_[END, vocabulary], prefix // base, prefix % base, z, n


def messages(vocabulary, x, y, z, n, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed stripes); a prefix is in one bucket."""
    bucket = (mix64(vocabulary[x] * _PAIR + vocabulary[y]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        some = order[cuts[k] : cuts[k + 1]]
        used, place = np.unique(np.concatenate([x[some], y[some], z[some]]), return_inverse=True)
        a, b, c = place.reshape(3, -1)
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        kinds = np.uint16 if len(used) < 1 << 16 else np.uint32
        yield k, pack(
            vocabulary[used], a[new].astype(kinds), b[new].astype(kinds), np.diff(np.r_[new, len(some)]).astype(np.uint32),
            c.astype(kinds), n[some].astype(np.uint32),
        )


def _send_stripes(buckets: int):
    """Task: (bucket, payload) of the stripes of some million words at a time."""

    def flush(held: list) -> pa.RecordBatch:
        name, follows = (np.concatenate(c) for c in zip(*held))
        held.clear()
        made = []
        for k in range(0, len(name), FLUSH_WORDS):
            size = min(FLUSH_WORDS, len(name) - k)
            made += messages(*counted(name[k : k + size + 2], follows[k : k + size + 2], size), buckets)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in made], pa.int64()), pa.array([v for _, v in made], pa.binary())], names=["bucket", "payload"]
        )

    def run(incoming):
        held, size = [], 0
        for batch in incoming:
            for part in slices(batch, "text"):
                name, follows, *_ = named_words(_column(part, "text"), _column(part, "lang"))
                if size and size + len(name) > FLUSH_WORDS:
                    yield flush(held)
                    size = 0
                held.append((name, follows))
                size += len(name)
        if size:
            yield flush(held)

    return run


def merged(parts: list[tuple]) -> tuple:
    """Stripes (x, y, z, n) added elementwise, sorted by prefix; names are hashes."""
    x, y, z, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((z, y, x))
    x, y, z, n = x[order], y[order], z[order], n[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])][: len(x)])
    return x[new], y[new], z[new], np.add.reduceat(n, new) if len(new) else n


def _read(payload: bytes) -> tuple:
    vocabulary, a, b, size, c, n = unpack(payload)
    return np.repeat(vocabulary[a], size), np.repeat(vocabulary[b], size), vocabulary[c], n.astype(np.int64)


FOUND = "kind string, x long, y long, z long, f long, longest long"


def _merge_stripes(least: int):
    """All stripes of one bucket: extensions and prefixes of ``least`` or more, and sums of first words."""

    def run(group: pa.Table) -> pa.Table:
        whole, waiting, size = [], [], 0
        for payload in group.column("payload"):
            waiting.append(_read(payload.as_py()))
            size += len(waiting[-1][0])
            if size > CHUNK_ENTRIES:
                whole = [merged(whole + waiting)]
                waiting, size = [], 0
        x, y, z, n = merged(whole + waiting)
        new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        total = np.add.reduceat(n, new)
        longest = np.maximum.reduceat(np.where(z == END, 0, n), new)
        px, py = x[new], y[new]
        first = np.flatnonzero(np.r_[True, px[1:] != px[:-1]])
        pairs = np.flatnonzero((total >= least) & (py != END))
        threes = np.flatnonzero((n >= least) & (z != END))
        none = np.zeros(0, np.uint64)
        made = [
            ("word", px[first], none, none, np.add.reduceat(total, first), none),
            ("pair", px[pairs], py[pairs], none, total[pairs], longest[pairs]),
            ("three", x[threes], y[threes], z[threes], n[threes], none),
        ]

        def long(values, size):
            return pa.array(values.view(np.int64)) if len(values) == size else pa.nulls(size, pa.int64())

        tables = [
            pa.table(
                [pa.array([kind] * len(c[0]), pa.string()), *[long(v, len(c[0])) for v in c]],
                names=["kind", "x", "y", "z", "f", "longest"],
            )
            for kind, *c in made
        ]
        return pa.concat_tables(tables)

    return run


def _send_words(incoming):
    """Task: (x, lang, word) of the distinct words of each slice."""
    for batch in incoming:
        for part in slices(batch, "text"):
            name, _, start, end, row, raw = named_words(_column(part, "text"), _column(part, "lang"))
            distinct, first = np.unique(name, return_index=True)
            size = (end - start)[first]
            data = raw[ranges(start[first], size)]
            offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
            words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), _column(part, "lang").take(pa.array(row[first])), words.cast(pa.string())],
                names=["x", "lang", "word"],
            )


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact in decimals."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    over = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def collocations(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, subsumed: int = SUBSUMED,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer one subsumes.

    A candidate is a phrase of 2 or 3 words with a = f(phrase) >= ``least``. Of its cuts in
    two parts the one of the lowest score counts, of equal ones the one after fewer words;
    l and r are the parts' counts, n the words of the language. A candidate is subsumed by
    a longer one that holds it and has at least ``subsumed`` per cent of its count.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    )
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    buckets = 1 + size // BUCKET_BYTES
    sent = docs.mapInArrow(tidy(_send_stripes(buckets)), "bucket long, payload binary")
    found = cut_lineage(sent.groupBy("bucket").applyInArrow(tidy(_merge_stripes(least)), FOUND), "stripes")
    words = docs.mapInArrow(tidy(_send_words), "x long, lang string, word string")
    words = words.groupBy("x").agg(F.first("lang").alias("lang"), F.first("word").alias("word"))
    counts = found.filter("kind = 'word'").groupBy("x").agg(F.sum("f").alias("f"))
    words = cut_lineage(counts.join(words, "x"), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))

    def word(at: str, count: str, text: str) -> DataFrame:
        return words.select(F.col("x").alias(at), F.col("f").alias(count), F.col("word").alias(text))

    threes = found.filter("kind = 'three'").select("x", "y", "z", F.col("f").alias("a"))
    pairs = found.filter("kind = 'pair'").select("x", "y", F.col("f").alias("a"), "longest")
    before = threes.groupBy(F.col("y").alias("x"), F.col("z").alias("y")).agg(F.max("a").alias("longest_before"))
    longest = F.greatest("longest", F.coalesce("longest_before", F.lit(0)))
    kept = pairs.join(before, ["x", "y"], "left").filter((longest < least) | (longest * 100 < F.col("a") * subsumed))
    kept = kept.join(words.select("x", "lang", F.col("f").alias("fx"), F.col("word").alias("wx")), "x").join(word("y", "fy", "wy"), "y")
    two = kept.select(
        "lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"),
        cut_score(F.col("a"), F.col("fx"), F.col("fy")).alias("score"),
    )
    heads = pairs.select("x", "y", F.col("a").alias("fxy"))
    tails = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"))
    whole = threes.join(heads, ["x", "y"]).join(tails, ["y", "z"])
    whole = whole.join(words.select("x", "lang", F.col("f").alias("fx"), F.col("word").alias("wx")), "x")
    whole = whole.join(word("y", "fy", "wy"), "y").join(word("z", "fz", "wz"), "z")
    whole = whole.withColumns({"s1": cut_score(F.col("a"), F.col("fx"), F.col("fyz")), "s2": cut_score(F.col("a"), F.col("fxy"), F.col("fz"))})
    late = F.col("s2") < F.col("s1")
    three = whole.select(
        "lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), "a", F.when(late, F.col("fxy")).otherwise(F.col("fx")).alias("l"),
        F.when(late, F.col("fz")).otherwise(F.col("fyz")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, most: int = BEST) -> DataFrame:
    """The first ``most`` phrases of each language by score, count and phrase, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
