"""Byte-level byte-pair encoding of whole texts with a public vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.session import ship

#: Where the vocabulary files lie on the driver.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pattern that cuts a text into pieces before merging, valid for the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per worker, and the longest one remembered (bytes); only speed depends on them.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 64


class BytePairEncoder:
    """Encodes texts by merge ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_rank_file(cls, content: bytes) -> BytePairEncoder:
        """From lines of base64 token and rank."""
        lines = (line.split() for line in content.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in lines})

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece.

        The symbols form a doubly linked list; a priority queue holds the ranks of adjacent pairs, lowest first, at
        equal ranks leftmost. An entry is stale if its left symbol is gone or the pair has another extent by now.
        O(n log n) for any piece, however long.
        """
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return (ranks[piece],)
        after = list(range(1, n + 1))  # start of the next symbol; n is the end
        before = list(range(-1, n - 1))
        alive = [True] * n
        queue = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queue.append((rank, i, i + 2))
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, i, end = pop(queue)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    push(queue, (rank, i, after[end]))
            k = before[i]
            if k >= 0:
                rank = ranks.get(piece[k:end])
                if rank is not None:
                    push(queue, (rank, k, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text, without special tokens; an empty or null text has none."""
        out: list[int] = []
        if not text:
            return out
        known, extend = self.known, out.extend
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode()
                ids = self.merge(raw)
                if len(raw) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of token ids: their vocabulary strings joined."""
        return b"".join(map(self.vocabulary.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _encoder(content: bytes) -> BytePairEncoder:
    return BytePairEncoder.from_rank_file(content)


def _rank_file(name: str, folder: str) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_column(docs: DataFrame, text: str, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """The columns `keep` plus `ids` (array<int>), or only their number `n_tokens` with `counts_only`.

    One pass without a shuffle. The vocabulary (under 1 MB, a fixed size) is read by the driver and broadcast, each
    worker builds it once; pieces recur, so nearly all are looked up. Null and empty texts give an empty list (0).
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(_rank_file(tokenizer, folder))
    new = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    kind = T.StructType([*docs.select(*keep).schema.fields, new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(content.value).encode
        for batch in batches:
            n = batch.num_columns - 1
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(t) for t in part.column(n).to_pylist()]
                made = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], made], names=kind.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, kind)


def decode_column(encoded: DataFrame, ids: str, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` plus `text`, what the token ids stand for: their vocabulary strings joined.

    A null or empty list gives an empty text. Bytes that are no text, as of a list cut inside a character, become
    replacement characters; ids outside the vocabulary raise KeyError.
    """
    ship(encoded.sparkSession)
    content = encoded.sparkSession.sparkContext.broadcast(_rank_file(tokenizer, folder))
    kind = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(content.value).decode
        for batch in batches:
            n = batch.num_columns - 1
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [decode(x or ()) for x in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string())], names=kind.names)

    return encoded.select(*keep, encoded[ids].alias("_ids")).mapInArrow(run, kind)
