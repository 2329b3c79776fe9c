"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public sentencepiece vocabulary get a probability per language.
A word's probability under a language is the sum over all its segmentations into
pieces, whatever their length, by the forward algorithm; a text's is the product over its words, and the
language of highest posterior (equal priors) is predicted. Words are runs of letters,
lower-cased, with the vocabulary's word mark in front; runs of more than ``LONGEST``
letters are cut there. A letter that is no piece counts as a piece of a small fixed
probability in every language.

``fit`` estimates the probabilities by expectation maximisation on the word counts of
at most about ``max_rows`` labelled texts, the same number for each language; word
counts and expected piece counts are summed by Spark, and the driver holds one number
per language and piece. Null labels are not learned from.

A text that is null or has no letter, and every text where nothing was learned, is
``und`` with score 0. The score is the posterior. Ties go to the first language by code
point. Every input row gives one row; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import bounded_batches, hash_spans, mix64, pack, tidy, unpack, worker_state
from weft.llm.toxicity import text_groups

MARK = "▁"
LONGEST = 24
FLOOR = 1e-7
MAX_ROWS = 4_000
MEMO_WORDS = 500_000
STEPS = 4
CELLS = 1 << 22
STEP_HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    hashes: np.ndarray
    chance: np.ndarray
    longest: int


def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """Sorted hashes of the lower-case pieces of a sentencepiece model, and the characters of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    kept = sorted(p for p in pieces if p and p == p.lower() and p.strip(MARK).isalpha() or p == MARK)
    return np.unique(np.array([piece_hash(p) for p in kept], np.uint64)), max(map(len, kept), default=1)


def piece_hash(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = grown(h, np.array([ord(c)], np.uint64))
    return int(h[0])


def grown(h: np.ndarray, character: np.ndarray) -> np.ndarray:
    """Hash of a string with one more character."""
    return mix64(h * STEP_HASH + character + np.uint64(1))


def is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    kept = worker_state("letters")
    if "table" not in kept:
        kept["table"] = np.array([chr(k).isalpha() for k in range(0x110000)])
    return kept["table"]


def letter_words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, start and end of each word (cut at LONGEST), and its row; rows' words in order."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in lowered])
    inside = is_letter()[points]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts = -(-(ends - starts) // LONGEST)
    if (parts > 1).any():
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        last = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + number * LONGEST
        ends = np.minimum(starts + LONGEST, last)
    row = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return points, starts, ends, row


def distinct_words(points, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted names of the distinct words, a place of each, and the distinct word of each occurrence."""
    named = hash_spans(points.view(np.uint8), starts * 4, ends * 4)
    return np.unique(named, return_index=True, return_inverse=True)


class Lattice:
    """Forward and backward sums over the segmentations of words of equal length."""

    def __init__(self, hashes: np.ndarray, longest: int = LONGEST + 1):
        self.hashes, self.longest = hashes, longest
        self.maybe = np.zeros(CELLS, bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def pieces(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> (words, piece) of every piece that the rows of ``words`` hold there."""
        n, width = words.shape
        out = {}
        for i in range(width):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                h = grown(h, words[:, j - 1])
                some = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[some]
                some, at = some[hit], at[hit]
                if j == i + 1 and len(some) < n:
                    other = np.setdiff1d(np.arange(n), some)
                    some, at = np.r_[some, other], np.r_[at, np.full(len(other), -1)]
                if len(some):
                    out[i, j] = (some, at)
        return out

    def forward(self, words: np.ndarray, spans: dict, chance: np.ndarray) -> np.ndarray:
        """(length + 1, words, languages) sums over the segmentations of each beginning."""
        n, width = words.shape
        f = np.zeros((width + 1, n, chance.shape[1]))
        f[0] = 1
        for i in range(width):
            for j in range(i + 1, min(width, i + self.longest) + 1):
                if (i, j) in spans:
                    some, at = spans[i, j]
                    f[j, some] += f[i, some] * chance[at]
        return f

    def backward(self, words: np.ndarray, spans: dict, chance: np.ndarray) -> np.ndarray:
        n, width = words.shape
        b = np.zeros((width + 1, n, chance.shape[1]))
        b[width] = 1
        for i in range(width - 1, -1, -1):
            for j in range(i + 1, min(width, i + self.longest) + 1):
                if (i, j) in spans:
                    some, at = spans[i, j]
                    b[i, some] += b[j, some] * chance[at]
        return b


def _marked(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points with the word mark in front) of the words of each length, some thousands at a time."""
    length = ends - starts
    for n in np.unique(length).tolist():
        every = np.flatnonzero(length == n)
        for at in range(0, len(every), 20_000):
            some = every[at : at + 20_000]
            words = points[starts[some][:, None] + np.arange(n)[None, :]].astype(np.uint64)
            yield some, np.concatenate([np.full((len(some), 1), ord(MARK), np.uint64), words], axis=1)


def _with_floor(chance: np.ndarray) -> np.ndarray:
    """Index -1 is the floor of a letter that is no piece."""
    return np.concatenate([chance, np.full((1, chance.shape[1]), FLOOR)])


def log_chances(texts: list, lattice: Lattice, chance: np.ndarray, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each text under each language, and whether it has a letter."""
    memo = {} if memo is None else memo
    out, lettered = np.zeros((len(texts), chance.shape[1])), np.zeros(len(texts), bool)
    padded = _with_floor(chance)
    for start, group in text_groups(texts):
        points, starts, ends, row = letter_words(group)
        if not len(starts):
            continue
        named, first, inverse = distinct_words(points, starts, ends)
        value = np.zeros((len(first), chance.shape[1]))
        held, values = memo.get("named", np.zeros(0, np.uint64)), memo.get("values", value[:0])
        at = np.minimum(np.searchsorted(held, named), max(0, len(held) - 1))
        known = held[at] == named if len(held) else np.zeros(len(named), bool)
        value[known] = values[at[known]]
        new = np.flatnonzero(~known)
        for some, words in _marked(points, starts[first[new]], ends[first[new]]):
            value[new[some]] = np.log(lattice.forward(words, lattice.pieces(words), padded)[-1])
        if len(held) + len(new) > MEMO_WORDS:
            memo.update(named=named, values=value)
        elif len(new):
            order = np.argsort(np.r_[held, named[new]], kind="stable")
            memo.update(named=np.r_[held, named[new]][order], values=np.concatenate([values, value[new]])[order])
        for g in range(chance.shape[1]):
            out[start : start + len(group), g] = np.bincount(row, value[inverse, g], len(group))
        lettered[start + np.unique(row)] = True
    return out, lettered


def fit(documents: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    spark = documents.sparkSession
    bounded_batches(spark)
    known = documents.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "text is not null and lang is not null"
    )
    size = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(size, key=lambda x: x.encode())
    hashes, longest = vocabulary(path)
    if not langs:
        return Model([], hashes, np.zeros((len(hashes), 0)), longest)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_rows / len(langs) / size[lang]))).otherwise(share)
    number = {lang: k for k, lang in enumerate(langs)}

    def words_of(batches):
        for batch in batches:
            by_lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            texts = batch.column(0).to_pylist()
            for start, group in text_groups(texts):
                points, starts, ends, row = letter_words(group)
                if not len(starts):
                    continue
                _, first, inverse = distinct_words(points, starts, ends)
                key, count = np.unique(by_lang[start + row] * len(first) + inverse, return_counts=True)
                word = [points[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[first], ends[first])]
                lang, at = np.divmod(key, len(first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang.astype(np.int32)), pa.array([word[k] for k in at], pa.string()), pa.array(count)],
                    names=["lang", "word", "n"],
                )

    counts = known.filter(place < share).select("text", "lang").mapInArrow(tidy(words_of), "lang int, word string, n long")
    from weft.session import cut_lineage

    words = cut_lineage(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")
    chance = np.full((len(hashes), len(langs)), 1.0 / len(hashes))

    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((hashes, chance))

        def expect(batches, shared=shared):
            hashes, chance = shared.value
            lattice, padded = Lattice(hashes, longest), _with_floor(chance)
            total, width = np.zeros(padded.size), padded.shape[1]
            for batch in batches:
                word = batch.column(0).to_pylist()
                lang, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
                sizes = np.array([len(w) for w in word], np.int64)
                points = np.frombuffer("".join(word).encode("utf-32-le"), np.uint32)
                ends = np.cumsum(sizes)
                for some, matrix in _marked(points, ends - sizes, ends):
                    spans = lattice.pieces(matrix)
                    f, b = lattice.forward(matrix, spans, padded), lattice.backward(matrix, spans, padded)
                    own = lang[some]
                    scale = n[some] / f[-1][np.arange(len(some)), own]
                    for (i, j), (rows, at) in spans.items():
                        g = own[rows]
                        share = scale[rows] * f[i, rows, g] * padded[at, g] * b[j, rows, g]
                        total += np.bincount((at % len(padded)) * width + g, share, total.size)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([pack(total)], pa.binary())], names=["one", "payload"])

        # One array of pieces x languages in the driver, whatever the input.
        total = np.zeros((len(hashes) + 1) * len(langs))
        parts = words.select("word", "lang", "n").mapInArrow(tidy(expect), "one long, payload binary")
        for r in parts.groupBy("one").applyInArrow(_add_up, "one long, payload binary").collect():
            total += unpack(bytes(r["payload"]))[0]
        total = total.reshape(-1, len(langs))[:-1] + 0.1
        chance = total / total.sum(axis=0)
    return Model(langs, hashes, chance, longest)


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(unpack(v)[0] for v in group.column("payload").to_pylist())
    return pa.table({"one": group.column("one")[:1], "payload": pa.array([pack(total)], pa.binary())})


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents' other columns with lang_pred and score, without the text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.hashes, model.chance))
    longest = model.longest
    others = [c for c in documents.columns if c not in (text_col, "lang_pred", "score")]
    docs = documents.select(*others, F.col(text_col).cast("string").alias("_text"))
    schema = docs.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        langs, hashes, chance = shared.value
        lattice = Lattice(hashes, longest)
        memo: dict = {}  # chances of the task's words
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            if langs:
                value, lettered = log_chances(texts, lattice, chance, memo)
                best = value.argmax(axis=1)
                score = 1 / np.exp(value - value.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                lettered, best, score = np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts))
            pred = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))],
                names=[*others, "lang_pred", "score"],
            )

    return docs.mapInArrow(tidy(run), schema)
