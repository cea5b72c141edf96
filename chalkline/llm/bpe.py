"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut by the vocabulary's pattern; each piece is merged by itself. The positions of a piece form a linked list.
A queue holds, for each merge rank, the positions whose pair has that rank; a hierarchical bitmap marks the ranks that
have any, so that find-first-set gives the next rank. An entry whose pair has changed meanwhile is stale and skipped.
A merge touches two pairs, so a piece of n bytes takes O(n log n) steps however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, kept

LEAF_BITS = 8  # 256 ranks for each leaf of the bitmap
LEAF_MASK = (1 << LEAF_BITS) - 1
CACHED_BYTES, CACHED_PIECES = 48, 400_000  # of each of two generations in a worker; other pieces are encoded anew, with the same result


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@dataclass(frozen=True)
class Vocabulary:
    ranks: dict[bytes, int]
    digest: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        ranks = load_ranks(path)
        return cls(ranks, hashlib.sha256(b"".join(b"%s %d\n" % x for x in ranks.items())).hexdigest())


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the pair of the least rank is merged, the leftmost of these first.

    The queue is kept in local names, since most pieces are short: buckets has the positions of each rank, leaves a bit
    for each rank that has any, top a bit for each leaf that isn't empty.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank_of = len(piece), ranks.get
    token: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    wanted: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # the rank of the pair that starts here
    wanted.append(None)
    top, leaves, buckets = 0, {}, {}
    leaf_of, bucket_of = leaves.get, buckets.get
    for i, rank in enumerate(wanted):
        if rank is not None:
            bucket = bucket_of(rank)
            if bucket:
                bucket.append(i)  # positions come in order, which is a heap
            else:
                buckets[rank] = [i]
                leaf = rank >> LEAF_BITS
                leaves[leaf] = leaf_of(leaf, 0) | 1 << (rank & LEAF_MASK)
                top |= 1 << leaf
    while top:
        leaf = (top & -top).bit_length() - 1  # find first set
        bits = leaves[leaf]
        low = bits & -bits
        rank = (leaf << LEAF_BITS) + low.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket.pop()
            leaves[leaf] = bits = bits ^ low
            if not bits:
                top ^= 1 << leaf
        if wanted[i] != rank:
            continue  # stale
        gone = after[i]
        merged = token[i] = token[i] + token[gone]
        token[gone] = wanted[gone] = None
        after[i] = right = after[gone]
        left = before[i]
        if right < n:
            before[right] = i
            found = wanted[i] = rank_of(merged + token[right])
        else:
            found = wanted[i] = None
        at = i
        while True:
            if found is not None:
                bucket = bucket_of(found)
                if bucket:
                    heappush(bucket, at)
                else:
                    buckets[found] = [at]
                    leaf = found >> LEAF_BITS
                    leaves[leaf] = leaf_of(leaf, 0) | 1 << (found & LEAF_MASK)
                    top |= 1 << leaf
            if at == left or left < 0:
                break
            at = left
            found = wanted[left] = rank_of(token[left] + merged)
    return [ranks[t] for t in token if t is not None]


class Codec(dict):
    """Packed ids by piece, filled as pieces come; each id is a little-endian unsigned 32-bit integer.

    When the young generation is full it becomes the old one; a piece found there moves on to the new one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.find, self.old = ranks, regex.compile(pattern).findall, {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            raw = piece.encode()
            packed = b"".join([i.to_bytes(4, "little") for i in merge(raw, self.ranks)])
            if len(raw) > CACHED_BYTES:
                return packed
        self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if len(self) > CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed or b"").cast("I")))


def _codec(ranks, pattern: str) -> Codec:
    """That of this worker, so that the tasks it runs one after another share the pieces they know."""
    key, codecs = (ranks.value.digest, pattern), kept("bpe")
    if key not in codecs:
        codecs.clear()
        codecs[key] = Codec(ranks.value.ranks, pattern)
    return codecs[key]


def _encode(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(ranks, pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            ids = [codec.encode(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(ranks, pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            raw = [codec.decode(x.as_py()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])


def _encode_decode(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    """Both in one worker, which then holds the pieces once."""
    for part in _encode(batches, ranks, pattern):
        yield from _decode(iter([part]), ranks, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; ids: packed little-endian unsigned 32-bit integers. A null text has none.

    path: a file of base64 tokens and ranks, read by the driver and broadcast (a vocabulary of fixed size).
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _encode(it, ranks, pattern), "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""
    ranks = ids.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    return ids.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, ranks, pattern), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    both = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _encode_decode(it, ranks, pattern), "doc_id long, ids binary, decoded binary")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
