"""Encoding of the corpus with a public byte-level BPE vocabulary (problem 8).

A text is cut into pieces by the vocabulary's pattern.  Within a piece the
symbols form a doubly linked list; a priority queue holds (merge rank,
position) of every adjacent pair that the vocabulary can merge.  The best pair
is popped, skipped if one of its ends has changed since (a stale entry), merged
otherwise, and the two new neighbours are pushed.  Pieces recur, so a worker
keeps the ids of pieces it has seen in a table of bounded size.

Null and empty texts have the defined result of an empty list of ids.  Special
tokens are never produced: their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published piece pattern of this byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_PIECES = 200_000


class Vocabulary:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        rank = self.rank
        if raw in rank:
            return [rank[raw]]
        n = len(raw)
        symbol: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := rank.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            left, j = symbol[i], after[i]
            if left is None or j >= n or len(left) + len(symbol[j]) != size:
                continue  # stale: one end was merged away or has grown
            whole = left + symbol[j]
            symbol[i], symbol[j] = whole, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(whole + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, len(whole) + len(symbol[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(symbol[h] + whole)) is not None:
                heapq.heappush(queue, (r, h, len(symbol[h]) + len(whole)))
        return [rank[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        known, ids = self.known, []
        for piece in self.pieces(text) if text else ():
            found = known.get(piece)
            if found is None:
                found = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(known) >= KNOWN_PIECES:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary, loaded once per worker."""
    path = f"{folder}/{name}"
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; null and empty texts give an empty list."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(folder, name).encode
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def lengths(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row, without handing the ids to Spark."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(folder, name).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int32())], [key, "n_tokens"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decoded(rows: DataFrame, ids: str = "ids", into: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``rows`` with the text of the ids; null ids give null."""

    @F.pandas_udf("string")
    def text_of(column):  # noqa: ANN001, ANN202
        v = vocabulary(folder, name)
        return column.map(lambda x: None if x is None else v.decode(x))

    return rows.withColumn(into, text_of(F.col(ids)))
