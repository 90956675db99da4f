"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves. Two encoded neighbours are joined by encoding
again only a window of tokens around the seam. In BPE a token sequence is the encoding of its bytes exactly if
every pair of adjacent tokens is the encoding of that pair's bytes; so once the pairs at both edges of the
window hold, the tokens outside it cannot change, and the join is exact. If they don't, the window doubles on that side.
Decoding concatenates halves up the tree. Equal pieces are encoded once a task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship

#: Pieces of up to LEAF bytes are merged directly; a join starts with EDGE tokens on each side of the seam.
LEAF, EDGE, LEAF_TOKENS, DIRECT = 24, 4, 4096, 192
#: Bounds of a task's memory of pieces; what doesn't fit is encoded anew each time.
MOST_PIECES, MOST_PIECE_BYTES, MOST_PAIRS = 600_000, 64, 200_000
NEVER = 1 << 60

_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder of one vocabulary: ranks of byte strings in the file at ``path``, split by ``pattern``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, until no two neighbours are a token."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > DIRECT:
            return self.merge_long(data)
        bounds = list(range(len(data) + 1))
        costs = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) != NEVER:
            at = costs.index(least)
            del bounds[at + 1], costs[at]
            if at < len(costs):
                costs[at] = ranks.get(data[bounds[at] : bounds[at + 2]], NEVER)
            if at:
                costs[at - 1] = ranks.get(data[bounds[at - 1] : bounds[at + 1]], NEVER)
        return [ranks[data[i:j]] for i, j in zip(bounds, bounds[1:])]

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges from a heap of neighbours: n log n steps for long runs that no window cuts short."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place
        alive = [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heappush(heap, (rank, i, end[j]))

        while heap:
            _, i, to = heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue  # a part of this pair has grown since
            alive[end[i]] = False
            end[i] = to
            if to < n:
                before[to] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def holds(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joint bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self.pairs) < MOST_PAIRS:
                self.pairs[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        tokens = self.tokens
        i, j = max(0, len(left) - EDGE), min(len(right), EDGE)
        while True:
            middle = self.merge(b"".join([tokens[t] for t in left[i:]] + [tokens[t] for t in right[:j]]))
            before = i == 0 or self.holds(left[i - 1], middle[0])
            after = j == len(right) or self.holds(middle[-1], right[j])
            if before and after:
                return left[:i] + middle + right[j:]
            if not before:
                i = max(0, len(left) - 2 * (len(left) - i))
            if not after:
                j = min(len(right), 2 * j)

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            ids = tuple(self.encode_bytes(data))
            if len(data) <= MOST_PIECE_BYTES and len(self.pieces) < MOST_PIECES:
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, extend = self.pieces.get, ids.extend
        for piece in self.split(text):
            extend(known(piece) or self.encode_piece(piece))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker; it is kept from task to task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each document's whole text, without special tokens; null counts as empty, which has no ids.

    ``path`` is a rank file that every executor has there. Further columns of ``docs`` are left out.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 256):
                lists = [own.encode(x.as_py() or "") for x in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([ids[at : at + 256], pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) from (doc_id, ids): the bytes that the ids stand for; null counts as none."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [own.decode(x.as_py() or []) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass and keeps digests only."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        words = {rank: str(rank) for rank in own.tokens}
        for batch in batches:
            n, marks, back = [], [], []
            for x in batch.column("text"):
                ids = own.encode(x.as_py() or "")
                n.append(len(ids))
                marks.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
