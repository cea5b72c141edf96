"""Exact top-k search by inner product with MaxScore pruning, over shards of quantised vectors.

Each dimension is a query's term. The vectors of a shard lie in blocks of vectors that are like each other, so that a block
knows close bounds: the most that a term can add to the score of any of its vectors. A query starts with the k-th best score
that a fixed sample of vectors gives it, the same for all shards, and takes the blocks by the sum of their bounds; when that
sum cannot reach the k-th best score any more, no other block can. Inside a block, terms are ordered by bound. Those whose
bounds together leave the k-th best score out of reach are non-essential: they alone bring no vector in. The essential terms'
postings are traversed; the others are probed, largest bound first, for vectors that are competitive with the bounds still
open. The k-th best score rises with every block.

A dense vector has a posting in every list, so the lists of a block are stored as columns, and what pruning saves are blocks
and the later terms of most vectors. Queries travel to the shards, a twentieth of what the shards weigh, one row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL, LARGE = 8192, 65536  # vectors of a shard: as few as there are tasks for, but no more than the larger number
BLOCK = 4096  # vectors of a block, on average
SEEDS = 1024  # vectors whose scores give a query its first bound
PROBE = 8  # terms that are probed at a time
EXACT = 2**53
LONGEST = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, without vectors that are null or hold a null or non-finite component."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _rows(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return np.split(flat, ends[1:-1] - ends[0])


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for line, v in zip(out, rows, strict=True):
        line[: len(v)] = v
    return out


def _fits(*largest: int, width: int) -> bool:
    """Whether sums of products stay exact in floats; else Python's own integers have to do."""
    return max(largest) ** 2 * max(1, width) < EXACT


def _bounded(score: int) -> int:
    return max(-LONGEST, min(LONGEST, score))


class Shard:
    """Blocks of some vectors, with the bounds of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.largest = int(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))))
        pivot = np.zeros(len(rows), np.int64)
        if len(rows) > BLOCK:
            # The nearest of some vectors: those of one are like each other.
            some = rows[np.random.default_rng(0).choice(len(rows), -(-len(rows) // BLOCK), replace=False)].astype(np.float64)
            for s in range(0, len(rows), 1 << 14):
                pivot[s : s + (1 << 14)] = (rows[s : s + (1 << 14)].astype(np.float64) @ some.T - np.square(some).sum(axis=1) / 2).argmax(axis=1)
        order = np.lexsort((ids, pivot))
        cut = np.flatnonzero(np.diff(pivot[order], prepend=-1))
        cut = np.unique(np.concatenate([cut, np.arange(0, len(rows), 2 * BLOCK)]))[1:] if len(rows) else []
        kind = np.float64 if _fits(self.largest, width=rows.shape[1]) else object
        self.ids = np.split(ids[order], cut)
        self.columns = [np.ascontiguousarray(b.T).astype(kind) for b in np.split(rows[order], cut)]
        self.high = np.array([b.max(axis=1, initial=-LONGEST) for b in self.columns]).reshape(len(self.columns), -1)
        self.low = np.array([b.min(axis=1, initial=LONGEST) for b in self.columns]).reshape(len(self.columns), -1)
        self.width = rows.shape[1]

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, vec_id) other than own among those of at least floor, and how many vectors were never scored in full."""
        query = np.concatenate([query, np.zeros(max(0, self.width - len(query)), np.int64)])[: self.width]
        exact = self.columns[0].dtype != object and _fits(self.largest, int(max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0))))), width=self.width)
        weight = query.astype(np.float64 if exact else object)
        bound = np.where(weight > 0, weight * self.high, weight * self.low)
        whole = bound.sum(axis=1)
        best: list[tuple[int, int]] = []  # (-score, vec_id), in order
        scored, total = 0, sum(map(len, self.ids))
        for b in np.argsort(-whole.astype(np.float64), kind="stable").tolist():
            if floor is not None and whole[b] < floor:
                if exact:
                    break
                continue  # the order is that of rounded sums
            columns, term = self.columns[b], np.argsort(-bound[b].astype(np.float64), kind="stable")
            rest = np.concatenate([np.cumsum(bound[b][term][::-1])[::-1], np.zeros(1, bound.dtype)])  # of the terms from here on
            essential = self.width
            if floor is not None:
                reach = rest < floor
                essential = int(np.argmax(reach)) if reach.any() else self.width
            at = min(self.width, -(-max(1, essential) // PROBE) * PROBE)
            live = np.flatnonzero(self.ids[b] != own)
            score = (weight[term[:at]] @ columns[term[:at]])[live]
            while at < self.width:
                if floor is not None:
                    open_ = score + rest[at] >= floor
                    live, score = live[open_], score[open_]
                if not len(live):
                    break
                more = term[at : at + PROBE]
                score = score + weight[more] @ columns[np.ix_(more, live)]
                at += PROBE
            scored += len(live)
            if floor is not None:
                close = score >= floor
                live, score = live[close], score[close]
            if len(live):
                best = sorted([*best, *zip((-_bounded(int(x)) for x in score), self.ids[b][live].tolist(), strict=True)])[:k]
                if len(best) == k and -best[-1][0] > -LONGEST:
                    floor = -best[-1][0] if floor is None else max(floor, -best[-1][0])
        return [(-s, i) for s, i in best], total - scored


def _floors(batches: Iterator[pa.RecordBatch], seeds, k: int) -> Iterator[pa.RecordBatch]:
    """Queries (vec_id, v) with floor: the k-th best score among the seeds, or null."""
    ids, rows = seeds.value
    shard = Shard(ids, rows) if len(ids) else None
    for batch in batches:
        found = [shard.search(v, own, k)[0] if shard else [] for own, v in zip(batch.column(0).to_pylist(), _rows(batch, "v"), strict=True)]
        floor = [x[-1][0] if len(x) == k and x[-1][0] > -LONGEST else None for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floor, pa.int64())], ["vec_id", "v", "floor"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, lane, asks, vec_id, v, floor), sorted: a shard's vectors come before the queries that ask it."""
    here, ids, rows, shard = None, [], [], None
    for batch in batches:
        part, lane, asks, vec_id, floor = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
        out = []
        for i, v in enumerate(_rows(batch, "v")):
            if (part[i], lane[i]) != here:
                here, ids, rows, shard = (part[i], lane[i]), [], [], None
            if not asks[i]:
                ids.append(vec_id[i])
                rows.append(v.copy())
                continue
            if shard is None:
                shard = Shard(np.array(ids, np.int64), _matrix(rows)) if ids else False
                ids, rows = [], []
            if shard:
                out += [(vec_id[i], other, s) for s, other in shard.search(v, vec_id[i], k, floor[i])[0]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other vectors.

    Ties go to the smaller vec_id; fewer than k others give fewer rows, and an empty table none. Vectors that are null or
    hold a null or non-finite component take no part, nor do null ids. A shorter vector counts as filled up with zeros.
    Rows that repeat a vec_id are candidates each, a query's own id is never among its results, and of a query's repeated
    rows the smallest vector asks. Components beyond 64 bits count as the nearest 64-bit number, and so do scores.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    n, tasks = rows.count(), spark.sparkContext.defaultParallelism
    shards = max(-(-n // LARGE), min(tasks, -(-n // SMALL)), 1)
    lanes = max(1, -(-tasks // shards)) if n > SMALL else 1  # copies of a shard that share the queries, while shards are few
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SEEDS).toArrow()
    ids = seeds["vec_id"].to_numpy().astype(np.int64)
    sent = spark.sparkContext.broadcast((ids, _matrix([np.array(v, np.int64) for v in seeds["v"].to_pylist()])))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(lambda it: _floors(it, sent, k), "vec_id long, v array<long>, floor long")
    lane = F.pmod(F.xxhash64("vec_id", F.lit("lane")), F.lit(lanes)).cast("int").alias("lane")
    held = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    asking = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"), lane, F.lit(True).alias("asks"), "vec_id", "v", "floor")
    met = held.union(asking).repartition(shards * lanes, "part", "lane").sortWithinPartitions("part", "lane", "asks", "vec_id")
    found = met.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
