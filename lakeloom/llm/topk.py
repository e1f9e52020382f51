"""Exact top-k search by inner product: the threshold algorithm over sorted lists.

Candidates are dealt into shards of a bounded size. In a shard every dimension
has its sorted list. A query walks the lists from their good ends (descending
for a positive weight, ascending for a negative one) in growing strides;
objects met for the first time are scored by random access; the threshold is
what an object not met yet could score at best. The walk stops once the kth
score is above the threshold, so ties at the kth place are never missed. The
shards' winners meet in a ranking with a per-task limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm import words
from lakeloom.session import n_partitions

#: Rows of a shard at most, about; a shard is held in one task.
SHARD = 32768
#: Rows that are worth a shard of their own while there are fewer shards than the session has partitions.
SMALL = 2048

Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the rows with an id whose vector is whole, finite and not empty."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _unique(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least vector of each id."""
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], rows[first]


def search_shards(rows: DataFrame, queries: DataFrame, k: int, search: Search, kind: str, shard_rows: int = SHARD) -> DataFrame:
    """Run ``search`` for all queries over each shard, in blocks, and rank the results.

    rows, queries: id, v. A query meets the vectors of its own length only and
    never the rows of its own id. Rows that repeat an id count once, with the
    least of their vectors. Each query is sent to each shard once, so shards are
    as large as a task can hold; a task holds a shard and a block of queries.
    """
    spark = rows.sparkSession
    n = rows.count()
    n_shards = max(1, -(-n // shard_rows), min(n_partitions(spark), n // SMALL))
    parts = max(1, min(n_partitions(spark), n_shards))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(0).cast("byte").alias("kind"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).cast("byte").alias("kind"), "id", "v")
    dealt = held.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}  # by length of the vectors: ids and rows
        ready: dict[int, tuple] = {}
        shard, last = None, None

        def answer(ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            d = rows.shape[1]
            if d not in ready:
                if d not in own:
                    return
                ready[d] = _unique(np.concatenate([x for x, _ in own[d]]), np.concatenate([x for _, x in own[d]]))
            got = list(search(*ready[d], ids, rows))
            if got:
                q, v, s = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64() if kind == "long" else pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            shards, kinds, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "id"))
            v = b.column("v")
            values, offsets = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            size = np.diff(offsets)
            cut = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, len(ids)]):
                if shards[s] != shard:
                    own, ready, shard, last = {}, {}, shards[s], None
                if kinds[s] == 1 and last == 0:
                    ready = {}
                fresh = np.concatenate([[(kinds[s], ids[s]) != last or kinds[s] == 0], ids[s + 1 : e] != ids[s : e - 1]]) if kinds[s] else np.ones(e - s, bool)
                last = (kinds[s], ids[e - 1])
                for d in np.unique(size[s:e]):
                    at = s + np.flatnonzero((size[s:e] == d) & fresh)
                    if not len(at):
                        continue
                    block = values[offsets[at][:, None] + np.arange(d)]
                    if kinds[s] == 0:
                        own.setdefault(int(d), []).append((ids[at], block))
                    else:
                        yield from answer(ids[at], block)

    found = dealt.mapInArrow(words.tidy(run), f"query_id long, vec_id long, score {kind}")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= floor)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


class SortedLists:
    """The rows of a shard with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        #: how far down its lists the last search went
        self.depth = 0
        self.order = np.argsort(rows, axis=0, kind="stable")  # ascending, by dimension
        self.sorted = np.take_along_axis(rows, self.order, axis=0)

    def search(self, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows other than ``own``."""
        n = len(self.ids)
        dims = np.flatnonzero(weights)
        w = weights[dims]
        up = w < 0
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, weights.dtype)
        depth, stride = 0, max(8, n // 64)
        while depth < n:
            end = min(n, depth + stride)
            met = np.zeros(n, bool)
            if len(dims):
                met[self.order[depth:end, dims[up]].ravel()] = True
                met[self.order[n - end : n - depth, dims[~up]].ravel()] = True
            else:
                met[:] = True  # every row scores nothing
            met &= ~seen
            seen |= met
            fresh = np.flatnonzero(met)
            fresh = fresh[self.ids[fresh] != own]
            ids = np.concatenate([ids, self.ids[fresh]])
            scores = np.concatenate([scores, self.rows[fresh] @ weights])
            top = best(ids, scores, k)
            ids, scores = ids[top], scores[top]
            depth = end
            if len(scores) == k and depth < n:
                edge = np.where(up, self.sorted[depth - 1, dims], self.sorted[n - depth, dims])
                if scores[-1] > (edge * w).sum():
                    break
            if seen.all():
                break
            stride *= 2
        self.depth = depth
        return ids, scores


def exact_topk(df: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Defined cases: vectors that are null,
    empty or hold null or non-finite components take no part, nor do rows with
    a null id; fewer candidates than k: all of them; a score among the k best
    that no 64-bit integer holds raises OverflowError; ties go to the smaller id;
    repeated ids count once, with their least vector; an empty table gives an
    empty result; other columns are not looked at.
    """

    def whole(x: np.ndarray) -> np.ndarray:
        return np.floor(scale * x)

    def search(ids, rows, asked, block):
        rows, block = whole(rows), whole(block)
        bound = np.abs(rows).max(initial=0) * np.abs(block).max(initial=0) * max(1, rows.shape[1])
        if bound >= 2.0**53:  # beyond what doubles hold exactly
            rows, block = rows.astype(object), block.astype(object)
            rows, block = np.vectorize(int, otypes=[object])(rows), np.vectorize(int, otypes=[object])(block)
            for q, w in zip(asked, block):
                scores = np.array([int(s) for s in rows @ w], object)
                order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
                if any(not -(2**63) <= scores[i] < 2**63 for i in order):
                    raise OverflowError(f"query {q}: a score beyond 64 bits")
                yield np.full(len(order), q), ids[order], np.array([scores[i] for i in order], np.int64)
            return
        lists = SortedLists(ids, rows)
        for q, w in zip(asked, block):
            got, scores = lists.search(q, w, k)
            yield np.full(len(got), q), got, scores.astype(np.int64)

    return search_shards(vectors(df, id_col, vector_col), vectors(queries, id_col, vector_col), k, search, "long", shard_rows)
