"""Katz backoff: bigrams with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = d(c(h w)) c(h w) / c(h)     if h w occurs in training texts
             = a(h) P(w)                   otherwise
    P(w)     = d1(c(w)) c(w) / N           if w occurs, else the mass that is left

Counts over ``MOST`` are not discounted. a(h) makes the probabilities of all training
tokens and of one class of unknown tokens sum to 1 after each h; a context whose
counts leave no mass gets one more count. The first word follows a start mark, the
end follows the last word; an end is a token.

Words are counted first: each batch of documents sends the counts of its distinct
words to buckets of the hash range, gets their total counts and ids back, and then
sends its distinct bigrams, with the documents that hold them, to buckets of the
context. A bucket holds a context whole: it counts its bigrams, writes them as a
partition of the n-gram table, and returns per document what its tokens add to the
score, in parts that need no other bucket. Discounts follow from the counts of counts
of all buckets and complete the sums at the end.

Contexts with at least a 1024th of all tokens are dealt by bigram instead of context,
and bigrams of two such words are counted ahead: at most 1026 * 1026 numbers, the only
data that every task holds, beside sums. So no bucket depends on one word.

``documents`` must give the same rows in the same partitions when read twice, as a
table of files does; a batch that changed between passes raises an error. Null texts
are empty: one token, the end. Rows are scored one by one, repeated rows and ids
included. Without training rows every token is unknown with probability 1.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import bounded_batches, hashed_words, mix64, pack, partitions_of, slices, tidy, unpack
from weft.session import checkpoint_folder, cut_lineage

MOST = 5
SHARE = 1024
HOT_LEAST = 50_000
BATCH_BYTES = 12 << 20
ROWS = "kind string, place long, batch long, payload binary"
NAMES = ["kind", "place", "batch", "payload"]


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) .. d(MOST) from the counts of counts n(1) .. n(MOST + 1) at 1 ...; d(0) is unused.

    Where Katz's formula gives no number between 0 and 1, half a count is taken off.
    """
    out = np.ones(MOST + 1)
    for r in range(1, MOST + 1):
        d = -1.0
        if n[1] > 0 and n[r] > 0:
            over = (MOST + 1) * n[MOST + 1] / n[1]
            if over < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    """Sums of the training words: N tokens, V distinct, D documents, counts of counts, discounts."""

    tokens: int
    distinct: int
    documents: int
    d: np.ndarray
    extra: int
    unknown: float

    @classmethod
    def of(cls, counts: np.ndarray, tokens: int, distinct: int, documents: int) -> Unigrams:
        if not tokens:
            return cls(0, 0, 0, np.ones(MOST + 1), 0, 1.0)
        d = discounts(counts)
        left = sum(counts[r] * r * (1 - d[r]) for r in range(1, MOST + 1))
        extra = 0 if left > 0 else 1
        return cls(tokens, distinct, documents, d, extra, float((left + extra) / (tokens + extra)))

    def chance(self, c: np.ndarray) -> np.ndarray:
        known = self.d[np.where(c <= MOST, c, 0)] * c / max(1, self.tokens + self.extra)
        return np.where(c > 0, known, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _rows(made: list) -> pa.RecordBatch:
    kinds, places, batches, payloads = zip(*made) if made else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(places, pa.int64()), pa.array(batches, pa.int64()), pa.array(payloads, pa.binary())],
        names=NAMES,
    )


def _gathered(incoming):
    """Arrow batches joined to about BATCH_BYTES, so that fewer bigrams are sent twice."""
    held, size = [], 0
    for batch in incoming:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _batches(incoming):
    """(batch number, ids, training flags, hashes, first word of each row) of bounded parts of a partition."""
    k, part = 0, TaskContext.get().partitionId()
    for batch in _gathered(incoming):
        for some in slices(batch, "text", BATCH_BYTES):
            words, row = hashed_words(some.column(1))
            yield (part << 24) + k, some.column(0), some.column(2).to_numpy(zero_copy_only=False).astype(bool), words, row
            k += 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the hash range, ascending with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _send_words(buckets: int):
    def run(incoming):
        for batch, _, training, words, row in _batches(incoming):
            known, inverse = np.unique(words, return_inverse=True)
            learned = np.repeat(training, np.diff(row))
            count = np.bincount(inverse[learned], minlength=len(known)).astype(np.uint32)
            cuts = np.searchsorted(_bucket(known, buckets), np.arange(buckets + 1))
            made = [
                ("words", int(b), batch, pack(known[cuts[b] : cuts[b + 1]], count[cuts[b] : cuts[b + 1]]))
                for b in np.flatnonzero(np.diff(cuts))
            ]
            made.append(("sum", -1, batch, pack(np.array([training.sum()], np.int64))))
            yield _rows(made)

    return run


def _count_words(group: pa.Table) -> pa.Table:
    """Total counts of one bucket's words, sent back to each batch in the order they came."""
    if group.column("kind")[0].as_py() == "sum":
        documents = sum(int(unpack(v)[0][0]) for v in group.column("payload").to_pylist())
        return pa.Table.from_batches([_rows([("documents", -1, 0, pack(np.array([documents], np.int64)))])])
    parts = [unpack(v) for v in group.column("payload").to_pylist()]
    known, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
    place, made, at = group.column("place")[0].as_py(), [], 0
    for batch, part in zip(group.column("batch").to_pylist(), parts):
        own = inverse[at : at + len(part[0])]
        check = np.array([np.bitwise_xor.reduce(part[0])], np.uint64)
        made.append(("reply", place, batch, pack(own.astype(np.int64), count[own], check)))
        at += len(part[0])
    small = np.bincount(count[count <= MOST + 1], minlength=MOST + 2)
    made.append(("vocabulary", place, 0, pack(known, count)))
    made.append(("counts", place, 0, pack(np.r_[len(known), count.sum(), (count > 0).sum(), small].astype(np.int64))))
    return pa.Table.from_batches([_rows(made)])


def _hot_words(least: int, starts: np.ndarray):
    def run(incoming):
        for batch in incoming:
            made = []
            for place, payload in zip(batch.column("place").to_pylist(), batch.column("payload").to_pylist()):
                known, count = unpack(payload)
                for k in np.flatnonzero(count >= least).tolist():
                    made.append((int(known[k].view(np.int64)), int(starts[place] + k), int(count[k])))
            a, b, c = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["hash", "id", "n"])

    return run


@dataclass(frozen=True)
class Hot:
    """Frequent words by ascending id, and the training counts of their bigrams (place * size + place)."""

    ids: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id among the frequent words, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


START, END = -2, -1


def _sequences(words: np.ndarray, row: np.ndarray, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and rows of all bigrams, with a start before and an end after each row."""
    sizes = np.diff(row)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    context = np.empty(len(owner), words.dtype)
    word = np.empty(len(owner), words.dtype)
    inner = np.ones(len(owner), bool)
    inner[first] = False
    context[first], context[inner] = start, words
    last = first + sizes
    inner[:] = True
    inner[last] = False
    word[last], word[inner] = end, words
    return context, word, owner


def _hot_pairs(hashes: np.ndarray, places: np.ndarray, start: int, end: int, size: int):
    """Task: training counts of bigrams of two frequent words; hashes ascend."""

    def run(incoming):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, _, training, words, row in _batches(incoming):
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                place = np.where(hashes[at] == words, places[at], -1)
            else:
                place = np.full(len(words), -1, np.int64)
            a, b, owner = _sequences(place, row, start, end)
            both = (a >= 0) & (b >= 0) & training[owner]
            key, n = np.unique(a[both] * size + b[both], return_counts=True)
            keys, inverse = np.unique(np.r_[keys, key], return_inverse=True)
            counts = np.bincount(inverse, np.r_[counts, n], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return run


def _send_texts(incoming):
    for batch, ids, training, words, row in _batches(incoming):
        known, inverse = np.unique(words, return_inverse=True)
        dtype = np.uint32 if len(known) > 1 << 16 else np.uint16
        key = ids.fill_null(0).to_numpy().astype(np.int64)
        null = np.asarray(ids.is_null().to_pylist(), bool)
        check = np.array([np.bitwise_xor.reduce(known) if len(known) else 0], np.uint64)
        value = pack(inverse.astype(dtype), np.diff(row).astype(np.uint32), key, null, training, check, np.array([len(known)], np.int64))
        yield _rows([("text", -1, batch, value)])


def _deal_bigrams(buckets: int, starts: np.ndarray, unigrams_of, hot_of):
    """Task: one batch's texts and the totals of its words to messages for the buckets of its bigrams."""

    def run(group: pa.Table) -> pa.Table:
        unigrams, hot = unigrams_of(), hot_of()
        places, payloads = group.column("place").to_pylist(), group.column("payload").to_pylist()
        batch = group.column("batch")[0].as_py()
        replies = sorted((p, unpack(v)) for p, v in zip(places, payloads) if p >= 0)
        (local, sizes, ids, null, training, check, n_known), = (unpack(v) for p, v in zip(places, payloads) if p < 0)
        word_id = np.concatenate([starts[p] + r[0] for p, r in replies] or [np.zeros(0, np.int64)])
        count = np.concatenate([r[1] for _, r in replies] or [np.zeros(0, np.int64)])
        found = np.bitwise_xor.reduce(np.concatenate([r[2] for _, r in replies])) if replies else np.uint64(0)
        if len(word_id) != n_known[0] or found != check[0]:
            raise RuntimeError("the documents changed between two passes; read them from a table")
        size = len(word_id)
        word_id = np.r_[word_id, START, END]
        count = np.r_[count, unigrams.documents, unigrams.documents]
        row = np.r_[0, np.cumsum(sizes.astype(np.int64))]
        a, b, owner = _sequences(local.astype(np.int64), row, size, size + 1)
        docs = len(sizes)
        key_of = np.int64(batch) * (1 << 18) + np.arange(docs)
        known = np.bincount(owner, count[b] > 0, docs).astype(np.int64)
        base = np.bincount(owner, unigrams.base(count[b]), docs)
        place = hot.place(word_id)
        pa_, pb = place[a], place[b]
        both = (pa_ >= 0) & (pb >= 0)
        # Bigrams of two frequent words: their training counts are at hand.
        pair, doc = pa_[both] * max(1, len(hot.ids)) + pb[both], owner[both]
        at = np.minimum(np.searchsorted(hot.pairs, pair), max(0, len(hot.pairs) - 1))
        n = np.where(hot.pairs[at] == pair, hot.counts[at], 0) if len(hot.pairs) else np.zeros(len(pair), np.int64)
        seen = n > 0
        total = np.bincount(doc[seen], np.log10(n[seen] / count[a[both][seen]]), docs)
        low = np.stack([np.bincount(doc[n == r], minlength=docs) for r in range(1, MOST + 1)])
        unseen = ~seen
        total += np.bincount(doc[unseen], np.log10(unigrams.chance(count[b[both][unseen]])), docs)
        late, m = np.unique(pa_[both][unseen] * docs + doc[unseen], return_counts=True)
        made = [
            ("meta", batch % buckets, batch, pack(key_of, ids, null, training, sizes.astype(np.int64) + 1, known, base)),
            ("sums", batch % buckets, batch, pack(key_of, total, *low.astype(np.uint32))),
            ("late", batch % buckets, batch, pack(hot.ids[late // docs] if len(late) else late, key_of[late % docs], m.astype(np.int64))),
        ]
        a, b, owner = a[~both], b[~both], owner[~both]
        keys, n = np.unique((a * (size + 2) + b) * docs + owner, return_counts=True)
        pair, doc = np.divmod(keys, docs)
        fresh = np.ones(len(pair), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        begin = np.flatnonzero(fresh)
        posted = np.diff(np.r_[begin, len(pair)])
        learned = np.add.reduceat(n * training[doc], begin) if len(begin) else n[:0]
        a, b = np.divmod(pair[begin], size + 2)
        mixed = mix64(word_id[a].view(np.uint64) + np.uint64(9))
        mixed = np.where(place[a] >= 0, mix64(mixed + word_id[b].view(np.uint64)), mixed)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[k] : cuts[k + 1]]
            heads, at = np.unique(a[some], return_index=True)
            run_of = np.diff(np.r_[at, len(some)])
            posts = np.repeat(begin[some], posted[some]) + np.arange(posted[some].sum()) - np.repeat(
                np.cumsum(posted[some]) - posted[some], posted[some]
            )
            value = pack(
                word_id[heads], count[heads], run_of.astype(np.uint32), word_id[b[some]], count[b[some]],
                learned[some].astype(np.uint32), posted[some].astype(np.uint32), doc[posts].astype(np.uint32), n[posts].astype(np.uint32),
            )
            made.append(("bigrams", k, batch, value))
        return pa.Table.from_batches([_rows(made)])

    return run


def _reduce(unigrams_of, hot_of):
    """Task: all bigrams of one bucket: table rows, document sums, and what must wait for the discounts."""

    def run(group: pa.Table) -> pa.Table:
        unigrams, hot = unigrams_of(), hot_of()
        kinds, batches = group.column("kind").to_pylist(), group.column("batch").to_pylist()
        payloads, place = group.column("payload").to_pylist(), group.column("place")[0].as_py()
        made = [(k, place, b, v) for k, b, v in zip(kinds, batches, payloads) if k != "bigrams"]
        parts = [(b, unpack(v)) for k, b, v in zip(kinds, batches, payloads) if k == "bigrams"]
        payloads.clear()
        if not parts:
            return pa.Table.from_batches([_rows(made)])
        head = np.concatenate([np.repeat(p[0], p[2]) for _, p in parts])
        head_n = np.concatenate([np.repeat(p[1], p[2]) for _, p in parts])
        word, word_n = (np.concatenate([p[k] for _, p in parts]) for k in (3, 4))
        learned = np.concatenate([p[5] for _, p in parts]).astype(np.int64)
        posted = np.concatenate([p[6] for _, p in parts]).astype(np.int64)
        doc = np.concatenate([p[7].astype(np.int64) + b * (1 << 18) for b, p in parts])
        n = np.concatenate([p[8] for _, p in parts]).astype(np.int64)
        order = np.lexsort((word, head))
        new = np.ones(len(order), bool)
        new[1:] = (head[order][1:] != head[order][:-1]) | (word[order][1:] != word[order][:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]
        h, hn, w, wn = head[first], head_n[first], word[first], word_n[first]
        c = np.bincount(kind, learned, len(first)).astype(np.int64)
        chance = unigrams.chance(wn)
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        context = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        low = np.stack([np.add.reduceat((c == r).astype(np.int64), starts) for r in range(1, MOST + 1)])
        high = np.add.reduceat(np.where(c > MOST, c, 0), starts)
        reached = np.add.reduceat(np.where(c > 0, chance, 0.0), starts)
        frequent = hot.place(h[starts]) >= 0
        # A context that is whole here and leaves no mass gets one more count.
        full = ~frequent & (low.sum(axis=0) == 0) & (hn[starts] > 0)
        weight = hn + full[context]
        owner = np.repeat(kind, posted)
        seen = c[owner] > 0
        value = np.log10(np.where(seen, c[owner] / np.maximum(1, weight[owner]), chance[owner])) * n
        keys, inverse = np.unique(doc, return_inverse=True)
        total = np.bincount(inverse, value, len(keys))
        counts = [np.bincount(inverse, np.where(c[owner] == r, n, 0), len(keys)).astype(np.uint32) for r in range(1, MOST + 1)]
        made.append(("sums", place, 0, pack(keys, total, *counts)))
        open_ = ~seen & (hn[owner] > 0)
        waits = np.flatnonzero(open_ & frequent[context[owner]])
        made.append(("late", place, 0, pack(h[owner[waits]], doc[waits], n[waits])))
        waits = np.flatnonzero(open_ & ~frequent[context[owner]])
        used, at = np.unique(context[owner[waits]], return_inverse=True)
        made.append(
            ("open", place, 0, pack(hn[starts][used] + full[used], high[used], reached[used], *[x[used] for x in low], at.astype(np.uint32), doc[waits], n[waits]))
        )
        some = np.flatnonzero(frequent)
        made.append(("hot", place, 0, pack(h[starts][some], hn[starts][some], high[some], reached[some], *[x[some] for x in low])))
        made.append(("counts", place, 0, pack(np.bincount(c[c <= MOST + 1], minlength=MOST + 2).astype(np.int64))))
        kept = np.flatnonzero(c > 0)
        made.append(("ngrams", place, 0, pack(h[kept], w[kept], c[kept].astype(np.int64))))
        return pa.Table.from_batches([_rows(made)])

    return run


def backoff(total, high, reached, low, d: np.ndarray):
    """a(h) from c(h), the counts over MOST, the unigram mass of seen words and the counts of counts."""
    kept = high + sum(low[r - 1] * r * d[r] for r in range(1, MOST + 1))
    return (1 - kept / np.maximum(total, 1)) / (1 - reached)


def _finish(d: np.ndarray, late_ids: np.ndarray, late_weight: np.ndarray):
    """Task: stored parts to what each batch's documents gain by them."""

    def run(incoming):
        for batch in incoming:
            made = []
            for kind, own, payload in zip(*(batch.column(k).to_pylist() for k in ("kind", "batch", "payload"))):
                if kind == "meta":
                    made.append(("meta", -1, own, payload))
                    continue
                parts = unpack(payload)
                if kind == "sums":
                    key, gain = parts[0], parts[1] + sum(parts[1 + r] * np.log10(d[r]) for r in range(1, MOST + 1))
                elif kind == "open":
                    weight = np.log10(backoff(parts[0], parts[1], parts[2], parts[3 : 3 + MOST], d))
                    at, doc, n = parts[3 + MOST :]
                    key, gain = doc, weight[at] * n
                elif len(late_ids):
                    key, gain = parts[1], late_weight[np.searchsorted(late_ids, parts[0])] * parts[2]
                else:
                    continue
                key, inverse = np.unique(key, return_inverse=True)
                gain = np.bincount(inverse, gain, len(key))
                part = key >> 18
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(key) else np.zeros(1, np.int64)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    doc = (key[lo:hi] & ((1 << 18) - 1)).astype(np.uint32)
                    made.append(("gain", -1, int(part[lo]), pack(doc, gain[lo:hi])))
            yield _rows(made)

    return run


def _add_up(group: pa.Table) -> pa.Table:
    """One batch's documents with the sum of their gains."""
    meta, gains = None, []
    for kind, payload in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist()):
        if kind == "meta":
            meta = unpack(payload)
        else:
            gains.append(unpack(payload))
    _, ids, null, training, n, known, base = meta
    total = np.zeros(len(ids))
    for doc, gain in gains:
        total[doc] += gain
    return pa.table(
        {
            "id": pa.array(ids, pa.int64(), mask=null), "held_out": ~training.astype(bool), "n_tokens": n,
            "n_known": known, "base_score": base, "score": total,
        }
    )


PARTS = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(
    documents: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", hot_least: int = HOT_LEAST,
    whole: frozenset = frozenset(), path: str | None = None,
) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows where ``held`` is true are scored but not learned from; ids are cast to long.
    The tables of words (hash, id as place in its bucket, count) and of bigrams are
    left under ``path`` or the checkpoint folder. ``whole`` names frequent words to be
    kept in one bucket (see below).
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(~held, F.lit(True)).alias("training"),
    )
    buckets = partitions_of(spark)
    sent = docs.mapInArrow(tidy(_send_words(buckets)), ROWS)
    words = cut_lineage(sent.groupBy("place").applyInArrow(tidy(_count_words), ROWS), "words")
    sums = np.zeros((buckets, MOST + 5), np.int64)
    trained = 0
    for r in words.filter("kind in ('counts', 'documents')").collect():  # one row of 10 numbers per bucket
        value = unpack(bytes(r["payload"]))[0]
        if r["kind"] == "documents":
            trained = int(value[0])
        else:
            sums[r["place"]] = value
    starts = np.cumsum(sums[:, 0]) - sums[:, 0]
    small = sums[:, 3:].sum(axis=0)
    small[0] = 0
    if 0 < trained <= MOST + 1:
        small[trained] += 1
    unigrams = Unigrams.of(small, int(sums[:, 1].sum()) + trained, int(sums[:, 2].sum()) + (trained > 0), trained)

    least = max(hot_least, unigrams.tokens // SHARE)
    found = words.filter("kind = 'vocabulary'").select("place", "payload").mapInArrow(
        _hot_words(least, starts), "hash long, id long, n long"
    ).collect()  # at most SHARE words
    found = [r for r in found if r["id"] not in whole]
    marks = [m for m in (START, END) if trained >= least and m not in whole]
    hot_ids = np.sort(np.array([r["id"] for r in found] + marks, np.int64))
    if len(hot_ids):
        by_hash = sorted((np.int64(r["hash"]).view(np.uint64), r["id"]) for r in found)
        hashes = np.array([h for h, _ in by_hash], np.uint64)
        places = np.searchsorted(hot_ids, np.array([i for _, i in by_hash], np.int64))
        start, end = (int(np.searchsorted(hot_ids, m)) if m in marks else -1 for m in (START, END))
        counted = docs.mapInArrow(tidy(_hot_pairs(hashes, places, start, end, len(hot_ids))), "pair long, n long")
        pairs = sorted((r["pair"], r["n"]) for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect())
    else:
        pairs = []
    hot_pairs = np.array([p for p, _ in pairs], np.int64)
    hot_counts = np.array([n for _, n in pairs], np.int64)
    shared = spark.sparkContext.broadcast((hot_ids, hot_pairs, hot_counts))
    facts = (unigrams.tokens, unigrams.distinct, unigrams.documents, unigrams.d, unigrams.extra, unigrams.unknown)

    def unigrams_of():
        return Unigrams(*facts)

    def hot_of():
        return Hot(*shared.value)

    texts = docs.mapInArrow(tidy(_send_texts), ROWS).union(words.filter("kind = 'reply'").select(*NAMES))
    dealt = texts.groupBy("batch").applyInArrow(tidy(_deal_bigrams(buckets, starts, unigrams_of, hot_of)), ROWS)
    reduced = dealt.groupBy("place").applyInArrow(tidy(_reduce(unigrams_of, hot_of)), ROWS)
    folder = path or f"{checkpoint_folder(spark)}/weft/katz-{uuid.uuid4().hex}"
    reduced.write.partitionBy("kind").parquet(folder)
    stored = spark.read.schema(ROWS).parquet(folder)

    n = np.bincount(np.minimum(hot_counts, MOST + 2), minlength=MOST + 3)[: MOST + 2]
    for r in stored.filter("kind = 'counts'").select("payload").collect():  # one row of 7 numbers per bucket
        n = n + unpack(bytes(r["payload"]))[0]
    d = discounts(n)

    # Frequent contexts: sums of the buckets and of the pairs counted ahead, at most SHARE + 2 of them.
    sums_of = {int(i): np.zeros(3 + MOST) for i in hot_ids}
    for r in stored.filter("kind = 'hot'").select("payload").toLocalIterator():
        parts = unpack(bytes(r["payload"]))
        for k, i in enumerate(parts[0].tolist()):
            sums_of[i] += np.r_[0, [p[k] for p in parts[2:]]]
    counts_of = {r["id"]: r["n"] for r in found} | {m: trained for m in marks}
    for pair, count in pairs:
        a, b = (int(hot_ids[x]) for x in divmod(pair, len(hot_ids)))
        own = sums_of[a]
        own[2] += float(unigrams.chance(np.array([counts_of[b]]))[0])
        if count > MOST:
            own[1] += count
        else:
            own[2 + count] += 1
    full = frozenset(i for i in sums_of if i != END and counts_of[i] and not sums_of[i][3:].any())
    if full - whole:
        # A frequent word with no rare successor leaves no mass: keep it in one bucket, which adds a count.
        return score(documents, held, id_col, text_col, hot_least, whole | full, path and f"{path}-whole")
    late_weight = np.array([np.log10(backoff(counts_of[int(i)], *sums_of[int(i)][1:3], sums_of[int(i)][3:], d)) for i in hot_ids])

    gains = stored.filter("kind in ('meta', 'sums', 'open', 'late')").select("kind", "batch", "payload").mapInArrow(
        _finish(d, hot_ids, late_weight), ROWS
    )
    return gains.groupBy("batch").applyInArrow(tidy(_add_up), PARTS).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(unigrams.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
