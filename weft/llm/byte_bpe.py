"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a BPE model whose merges are all splits of a
token into two tokens, ordered by the token's rank. Text is cut by the public pattern;
each match is encoded by itself. Distinct matches are encoded once and kept in the
task's bounded memo, so a batch costs one library call for its new matches.

Ids are ids of bytes: a character can be split between tokens. Offsets are in
characters; both tokens of a split character cover it. Decoding maps ids back to
bytes by the reversed table and only then to text; bytes that end inside a character
become U+FFFD in text, and stay as they are in ``decoded``.

Null and empty texts have no tokens; decoding null or empty ids gives empty bytes.
An id outside the vocabulary raises an error. Every input row gives one output row.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import bounded_batches, slices, tidy

MEMO_ENTRIES = 200_000
SLICE = 2 << 20
GROUP = 256
SEPARATOR = "\x00"

def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte; other bytes follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """Encoder and decoder of one rank file; made once per task, so idle workers hold none."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()

        def name(token: bytes) -> str:
            return "".join(shown[b] for b in token)

        merges = []
        for token in sorted(ranks, key=ranks.get):
            halves = [(token[:k], token[k:]) for k in range(1, len(token))]
            halves = [h for h in halves if h[0] in ranks and h[1] in ranks]
            halves.sort(key=lambda h: (ranks[h[0]], ranks[h[1]]))
            merges += [(name(a), name(b)) for a, b in halves]
        model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.plain = Tokenizer(model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(SEPARATOR, "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.cut = regex.compile(pattern).findall
        byte_of = {c: b for b, c in shown.items()}
        self.bytes_of = {
            i: bytes(byte_of[c] for c in token) for token, i in self.tokenizer.get_vocab().items()
        }
        self.between = self.plain.encode(SEPARATOR, add_special_tokens=False).ids[0]
        self.decimal_of = {i: str(i) for i in self.bytes_of}
        self.memo: dict[str, tuple] = {}

    def matches(self, text: str) -> list[str]:
        return self.cut(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode the matches that the memo lacks: (ids, decimal ids, decoded bytes) of each."""
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = list(pieces)
        odd = [p for p in new if SEPARATOR in p]
        even = [p for p in new if SEPARATOR not in p]
        groups = [even[k : k + GROUP] for k in range(0, len(even), GROUP)]
        library = self.tokenizer.encode_batch_fast
        for group, made in zip(groups, library([SEPARATOR.join(g) for g in groups], add_special_tokens=False)):
            ids, start = made.ids, 0
            ends = np.flatnonzero(np.array(ids) == self.between).tolist() + [len(ids)]
            for piece, end in zip(group, ends):
                self._keep(piece, ids[start:end])
                start = end + 1
        for piece in odd:  # rare: a match that holds the separator goes alone to a second copy
            self._keep(piece, self.plain.encode(piece, add_special_tokens=False).ids)

    def _keep(self, piece: str, ids: list[int]) -> None:
        decimal = ",".join([self.decimal_of[i] for i in ids])
        self.memo[piece] = (len(ids), decimal, self.decode(ids))

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        cut = self.matches(text)
        self.learn(set(cut))
        return [int(i) for p in cut for i in self.memo[p][1].split(",")]

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First and end character of each token; tokens that share a character both cover it."""
        sizes = np.array([len(self.bytes_of[i]) for i in ids], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        if not len(ids):
            return [], []
        return character[ends - sizes].tolist(), (character[ends - 1] + 1).tolist()


def encode(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, starts, ends): token ids and their character offsets."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        own = Coder(path, pattern)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [own.encode(t) for t in texts]
                spans = [own.spans(t, i) for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(ids, pa.list_(pa.int32())),
                        pa.array([s[0] for s in spans], pa.list_(pa.int32())),
                        pa.array([s[1] for s in spans], pa.list_(pa.int32())),
                    ],
                    names=[id_col, "ids", "starts", "ends"],
                )

    return docs.mapInArrow(tidy(run), f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded, text) from an array of ids; ``text`` replaces incomplete characters."""
    rows = tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        own = Coder(path, pattern)
        for batch in batches:
            raw = [own.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(raw, pa.binary()),
                    pa.array([r.decode("utf-8", errors="replace") for r in raw], pa.string()),
                ],
                names=[id_col, "decoded", "text"],
            )

    return rows.mapInArrow(tidy(run), f"`{id_col}` {kind}, decoded binary, text string")


def round_trip(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them.

    Encodes and decodes in one pass, so that ids need not leave the task.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        own = Coder(path, pattern)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                cut = [own.matches(t) if t else [] for t in part.column(1).to_pylist()]
                own.learn(set().union(*cut))
                count, ids, decoded = [], [], []
                for pieces in cut:
                    made = list(map(own.memo.__getitem__, pieces))
                    sizes, decimals, raw = zip(*made) if made else ((), (), ())
                    count.append(sum(sizes))
                    ids.append(hashlib.sha256(",".join(decimals).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(raw)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
