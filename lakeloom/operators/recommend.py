"""Item-similarity collaborative filtering on interactions (user, item, rating)."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import cut, n_partitions


def interactions(df: DataFrame, user: str, item: str, rating: str, how: str = "sum", order: str | None = None) -> DataFrame:
    """One row per user and item: the sum of the ratings, or the last one by ``order``."""
    rows = df.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).cast("double").alias("rating"), *([F.col(order).alias("order")] if order else []))
    rows = rows.where(F.col("user").isNotNull() & F.col("item").isNotNull() & F.col("rating").isNotNull())
    if how == "sum":
        value = F.sum("rating")
    elif how == "last" and order:
        value = F.max_by("rating", F.struct("order", "rating"))
    else:
        raise ValueError(how)
    return rows.groupBy("user", "item").agg(value.alias("rating"))


def cap_per_user(x: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` items of each user by item id: bounds the pairs of a heavy user."""
    r = F.row_number().over(W.partitionBy("user").orderBy("item"))
    return x.withColumn("r", r).where(F.col("r") <= cap).drop("r")


#: Items of a user that meet in one task; larger baskets are dealt to pairs of blocks.
BASKET = 1024


#: Pairs that a task holds at a time, about, and bits of the filter that is broadcast, as a power of two.
CHUNK, FILTER = 1 << 22, 28
#: Up to so many pairs in all are made without a count before.
FEW = 1 << 21


def deal(x: DataFrame, values: tuple[str, ...], blocks: bool) -> DataFrame:
    """Rows by meeting (user, low, high): all pairs of its rows meet, but those of one block (own) only where low = high.

    The items of a heavy user are dealt to blocks, and each pair of blocks is a
    meeting of its own: no pair is lost, no task holds more than two blocks.
    """
    if not blocks:
        zero = F.lit(0)
        return x.select("user", zero.alias("low"), zero.alias("high"), zero.alias("own"), "item", *values)
    heavy = x.groupBy("user").agg(F.ceil(F.count(F.lit(1)) / BASKET).cast("int").alias("_blocks")).where(F.col("_blocks") > 1)
    # at most one row for BASKET rows of the input
    rows = x.join(F.broadcast(heavy), "user", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("user", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "item", *values)


def chunks(batches: Iterator[pa.RecordBatch], enough: int = 1 << 18) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in the order of meetings and items, and the positions p < q of the pairs among them, about CHUNK at a time, once ``enough`` rows are there."""

    def enumerate_pairs(rows: pa.Table, starts: np.ndarray):
        ends = np.append(starts[1:], rows.num_rows)
        partners = np.repeat(ends, ends - starts) - np.arange(rows.num_rows) - 1
        done = np.concatenate([[0], np.cumsum(partners)])
        low, high, own = (rows.column(c).to_numpy() for c in ("low", "high", "own"))
        start = 0
        while start < rows.num_rows:
            stop = max(start + 1, int(np.searchsorted(done, done[start] + CHUNK, "right")) - 1)
            n = partners[start:stop]
            p = np.repeat(np.arange(start, stop), n)
            q = p + 1 + np.arange(len(p)) - np.repeat(done[start:stop] - done[start], n)
            if (high[start:stop] > 0).any():
                meet = (low[p] == high[p]) | (own[p] != own[q])
                p, q = p[meet], q[meet]
            if len(p):
                yield rows, p, q
            start = stop

    def firsts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in ("user", "low", "high"):
            column = rows.column(c).combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = firsts(rows)
        last = int(starts[-1])  # its meeting may go on in the next batch
        if last:
            yield from enumerate_pairs(rows.slice(0, last), starts[:-1])
        held = rows.slice(last).to_batches()
        n = rows.num_rows - last
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from enumerate_pairs(rows, firsts(rows))


def _keys(rows: pa.Table, p: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of a hash of each pair of items."""
    h = rows.column("hash").to_numpy().view(np.uint64)
    z = (h * np.uint64(0x9E3779B97F4A7C15))[p]
    z ^= (h ^ (h >> np.uint64(32)))[q]
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x94D049BB133111EB)
    return z >> np.uint64(64 - bits)


def _recurring(dealt: DataFrame, pairs: int, min_support: int) -> tuple[bytearray, int, int]:
    """A bit for each hash that pairs of ``min_support`` meetings may have, with the bits of a key and of a position.

    Every pair sends two or three bytes: its key's distance from the one before
    in the order of its chunk, at most ``min_support`` times a chunk, as more
    decide nothing. A bucket of keys holds about CHUNK of them.
    """
    size = max(1, math.ceil(math.log2(pairs)))
    part = max(0, size - int(math.log2(CHUNK)))  # 2 ** part buckets
    bits, wide = max(size + 8, FILTER), min(FILTER, max(16, size + 4))
    rest = bits - part  # of a key, within its bucket

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, p, q in chunks(batches):
            keys = np.sort(_keys(rows, p, q, bits))
            keys = np.concatenate([keys[:min_support], keys[min_support:][keys[min_support:] != keys[:-min_support]]])
            own = (keys >> np.uint64(rest)).astype(np.int64)
            steps = np.diff(keys, prepend=np.uint64(0))
            first = np.flatnonzero(np.diff(own, prepend=-1))
            steps[first] = keys[first] - (own[first].astype(np.uint64) << np.uint64(rest))
            near, far = steps.astype(np.uint16), (steps >> np.uint64(16)).astype(np.uint32)
            ends = np.append(first[1:], len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[first], pa.int64()), pa.array([near[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array([zlib.compress(far[a:b].tobytes(), 1) for a, b in zip(first, ends)], pa.binary())],
                ["bucket", "near", "far"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = defaultdict(list)
        for batch in batches:
            for bucket, near, far in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found[bucket].append((near, far))
        for bucket, sent in found.items():
            keys = np.sort(np.concatenate([np.cumsum(np.frombuffer(n, np.uint16) + (np.frombuffer(zlib.decompress(f), np.uint32).astype(np.uint64) << np.uint64(16)), dtype=np.uint64) for n, f in sent]))
            often = keys[min_support - 1 :][keys[min_support - 1 :] == keys[: len(keys) - min_support + 1]]
            marks = np.zeros(1 << max(0, wide - part), bool)
            marks[(often >> np.uint64(bits - wide)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())], ["bucket", "marks"])

    if wide - part < 3 or rest > 48:
        raise ValueError("too many pairs for the filter")
    sent = dealt.select("user", "low", "high", "own", "hash").mapInArrow(send, "bucket long, near binary, far binary")
    marked = sent.repartition(max(1 << part, min(n_partitions(dealt.sparkSession), 1 << part)), "bucket").mapInArrow(count, "bucket long, marks binary")
    marks = bytearray(1 << (wide - 3))
    own = len(marks) >> part
    for r in marked.collect():
        marks[r.bucket * own : (r.bucket + 1) * own] = zlib.decompress(r.marks)
    return marks, bits, wide


def _pairs(x: DataFrame, *values: str, min_support: int = 1, summed) -> DataFrame:
    """Pairs of items i < j of the same user, aggregated to i, j and the columns of ``summed``, first the support.

    Where ``min_support`` is over one, most pairs of a large table are of too
    few users, and are as many as all others by far. So pairs are counted by
    hash first, which moves few bytes a pair, and only pairs of a hash that
    recurs as often become rows. Hashes only leave out pairs that cannot have
    the support; whether one has it is decided by its own rows.
    """
    pairs, most = x.groupBy("user").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.max("n")).first()
    keys = ["user", "low", "high"]
    dealt = deal(x.where(F.col("user").isNotNull() & F.col("item").isNotNull()), values, (most or 0) > BASKET)
    if min_support < 2 or (pairs or 0) <= FEW:
        a = dealt.select(*keys, F.col("own").alias("a_own"), F.col("item").alias("i"), *(F.col(v).alias(f"a_{v}") for v in values))
        b = dealt.select(*keys, F.col("own").alias("b_own"), F.col("item").alias("j"), *(F.col(v).alias(f"b_{v}") for v in values))
        met = a.join(b, keys).where(F.col("i") < F.col("j")).where((F.col("low") == F.col("high")) | (F.col("a_own") != F.col("b_own")))
        return met.groupBy("i", "j").agg(*summed).where(F.col("support") >= min_support)
    spark = x.sparkSession
    parts = max(n_partitions(spark), math.ceil(pairs / (8 * CHUNK)))
    dealt = dealt.withColumn("hash", F.xxhash64("item")).repartition(parts, *keys).sortWithinPartitions(*keys, "item").persist(StorageLevel.MEMORY_AND_DISK)
    marks, bits, wide = _recurring(dealt, int(pairs), min_support)
    sent = spark.sparkContext.broadcast(bytes(marks))
    sides = [("item", "i", "p"), ("item", "j", "q"), *((v, f"{s}_{v}", r) for s, r in ("ap", "bq") for v in values)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(sent.value, np.uint8)
        for rows, p, q in chunks(batches):
            at = _keys(rows, p, q, bits) >> np.uint64(bits - wide)
            kept = np.flatnonzero(marks[at >> np.uint64(3)] & (128 >> (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            for k in range(0, len(kept), 1 << 16):
                take = {"p": p[kept[k : k + (1 << 16)]], "q": q[kept[k : k + (1 << 16)]]}
                yield from pa.table({name: rows.column(c).take(pa.array(take[r])) for c, name, r in sides}).combine_chunks().to_batches()

    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    met = dealt.mapInArrow(meet, ", ".join(f"{name} {types[c]}" for c, name, _ in sides)).where("i < j")
    found = cut(met.groupBy("i", "j").agg(*summed).where(F.col("support") >= min_support))
    dealt.unpersist()
    sent.unpersist()
    return found


@contextmanager
def kept(x: DataFrame) -> Iterator[DataFrame]:
    """x, computed once for all that is done inside, in memory or on disk; left as it is where it is kept already."""
    own = x.storageLevel == StorageLevel.NONE
    if own:
        x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield x
    finally:
        if own:
            x.unpersist()


def cooccur(x: DataFrame, min_support: int = 1) -> DataFrame:
    """i, j, support: users who share both items."""
    with kept(x):
        return _pairs(x, min_support=min_support, summed=[F.count(F.lit(1)).alias("support")])


def similarity(x: DataFrame, how: str = "cosine", min_support: int = 1) -> DataFrame:
    """i, j, support, similarity of items i < j.

    cosine: over all raters; jaccard: of the sets of users; pearson: over the
    users of both (no row if a variance is 0); adjusted_cosine: cosine of the
    ratings less the user's mean (no row if a norm is 0). Item sums are joined
    to the ratings before the self-join, so that pairs are only aggregated,
    with partial sums before the shuffle.
    """
    if how == "adjusted_cosine":
        x = x.withColumn("rating", F.col("rating") - F.avg("rating").over(W.partitionBy("user")))
    with kept(x):
        return _similarity(x, how, min_support)


def _similarity(x: DataFrame, how: str, min_support: int) -> DataFrame:
    a, b, support = F.col("a_rating"), F.col("b_rating"), F.count(F.lit(1)).alias("support")
    if how in ("cosine", "adjusted_cosine"):
        norms = x.groupBy("item").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm")).where("norm > 0")
        scaled = x.join(norms, "item").select("user", "item", (F.col("rating") / F.col("norm")).alias("rating"))
        return _pairs(scaled, "rating", min_support=min_support, summed=[support, F.sum(a * b).alias("similarity")])
    if how == "jaccard":
        sized = x.join(x.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item")
        found = _pairs(sized, "n", min_support=min_support, summed=[support, F.first("a_n").alias("m"), F.first("b_n").alias("n")])
        return found.select("i", "j", "support", (F.col("support") / (F.col("m") + F.col("n") - F.col("support"))).alias("similarity"))
    if how == "pearson":
        sums = _pairs(x, "rating", min_support=min_support, summed=[support, F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab")])
        n = F.col("support")
        va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
        return sums.where((va > 0) & (vb > 0)).select("i", "j", "support", ((n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)).alias("similarity"))
    raise ValueError(how)


def neighbours(sim: DataFrame, k: int) -> DataFrame:
    """item, neighbour, similarity, rank: the k most similar items of each, ties to the smaller id."""
    both = sim.select(F.explode(F.array(F.struct(F.col("i").alias("item"), F.col("j").alias("neighbour"), "similarity"), F.struct(F.col("j").alias("item"), F.col("i").alias("neighbour"), "similarity"))).alias("x")).select("x.*")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("similarity"), "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def predict(x: DataFrame, nb: DataFrame) -> DataFrame:
    """user, item, prediction: mean of the user's ratings of an item's neighbours, weighted by similarity; null if the weights add up to 0."""
    scored = x.join(nb.select(F.col("neighbour").alias("item"), F.col("item").alias("target"), "similarity"), "item")
    weight = F.sum(F.abs("similarity"))
    return scored.groupBy("user", F.col("target").alias("item")).agg(F.when(weight > 0, F.sum(F.col("similarity") * F.col("rating")) / weight).alias("prediction"))


def recommend(x: DataFrame, nb: DataFrame, n: int, digits: int = 8) -> DataFrame:
    """user, item, prediction, rank: the n best items that the user has not had, ties to the smaller id.

    Predictions that agree in ``digits`` decimals tie, so that the order of sums does not matter.
    """
    unseen = predict(x, nb).where("prediction is not null").join(x.select("user", "item"), ["user", "item"], "left_anti")
    rank = F.row_number().over(W.partitionBy("user").orderBy(F.desc(F.round("prediction", digits)), "item"))
    return unseen.withColumn("rank", rank).where(F.col("rank") <= n)


def rmse(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """n, rmse over the pairs that have a prediction."""
    both = truth.join(predicted, ["user", "item"]).where("prediction is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2)).alias("rmse"))


def precision_recall(recommended: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """users, precision, recall at n: means over the users with held-out items."""
    hits = recommended.where(F.col("rank") <= n).join(truth.select("user", "item"), ["user", "item"]).groupBy("user").agg(F.count(F.lit(1)).alias("hits"))
    own = truth.groupBy("user").agg(F.count(F.lit(1)).alias("own")).join(hits, "user", "left")
    hit = F.coalesce("hits", F.lit(0))
    return own.agg(F.count(F.lit(1)).alias("users"), F.avg(hit / F.lit(float(n))).alias("precision"), F.avg(hit / F.col("own")).alias("recall"))
