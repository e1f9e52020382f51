"""SimHash near-duplicates found with BK-trees.

Fingerprints are spread over shards such that any two within the radius meet
in at least one; each shard holds a BK-tree (children keyed by their integer
Hamming distance to the parent) and a search follows only the edges within the
radius. A shard gives back a spanning forest of its links, never all pairs.

The trees travel by shuffle and not by a driver broadcast: all of them
together grow with the corpus, so no size bound could be proven for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import words
from lakeloom.operators.components import connected_components
from lakeloom.session import cut, n_partitions

#: Fingerprints of one tree at most, before its shard is split over more bits.
TREE = 2048


def shingle_bytes(body: bytes | None, width: int) -> list[bytes]:
    """Runs of ``width`` words of a text with A-Z lower-cased; shorter texts are one run."""
    own = body.lower().split() if body else []
    if len(own) <= width:
        return [b" ".join(own)] if own else []
    return list(map(b" ".join, zip(*(own[i:] for i in range(width)))))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, np.int64)
    for s in range(0, n, 1 << 16):
        part = hashes[s : s + (1 << 16)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def hash_shingles(shingles: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), ">u8").astype(np.uint64)


class BKTree:
    """Fingerprints by their Hamming distance to their parents."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """Add a value; its place."""
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != place:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), place)
        return place

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values within the radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if len(kids) > 2 * radius + 1:
                stack.extend(kids[e] for e in range(max(0, d - radius), d + radius + 1) if e in kids)
            else:
                stack.extend(c for e, c in kids.items() if d - radius <= e <= d + radius)


class BucketTree:
    """A BK-tree over values known from the start; groups of up to ``leaf`` values are leaves and scanned at once."""

    def __init__(self, values: np.ndarray, leaf: int = 64) -> None:
        self.values = values
        #: (place of the node's value, children by distance), or the places of a leaf
        self.nodes: list[tuple[int, dict[int, int]] | np.ndarray] = []
        grow: list[tuple[np.ndarray, dict[int, int] | None, int]] = [(np.arange(len(values)), None, 0)] if len(values) else []
        while grow:
            own, above, edge = grow.pop()
            if above is not None:
                above[edge] = len(self.nodes)
            if len(own) <= leaf or (above is not None and edge == 0):  # no distance to the parent: all are equal
                self.nodes.append(own)
                continue
            pivot, rest = int(own[0]), own[1:]
            far = np.bitwise_count(values[rest] ^ values[pivot])
            kids: dict[int, int] = {}
            self.nodes.append((pivot, kids))
            order = np.argsort(far, kind="stable")
            at = np.flatnonzero(np.diff(far[order], prepend=255))
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
                grow.append((rest[order[s:e]], kids, int(far[order[s]])))

    def search(self, value: np.uint64, radius: int) -> np.ndarray:
        """Places of the values within the radius, the nearest first."""
        stack, found = [0] if self.nodes else [], []
        while stack:
            node = self.nodes[stack.pop()]
            if isinstance(node, np.ndarray):
                found.append(node)
                continue
            pivot, kids = node
            d = int(self.values[pivot] ^ value).bit_count()
            found.append([pivot])
            stack.extend(kids[e] for e in kids if d - radius <= e <= d + radius)
        if not found:
            return np.zeros(0, np.int64)
        near = np.concatenate(found).astype(np.int64)
        far = np.bitwise_count(self.values[near] ^ value)
        near, far = near[far <= radius], far[far <= radius]
        return near[np.lexsort((near, far))]


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the values' classes: a spanning forest of places, by tree search."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in tree.search(v, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
        tree.insert(v)
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc, fp: one row per row of df, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in words.slices(b, "body"):
                fps = [_signed(fingerprint(hash_shingles(shingle_bytes(x, width)))) for x in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(fps, pa.int64())], names=["doc", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("body")).mapInArrow(words.tidy(run), "doc long, fp long")


def _blocks(n: int, low: int, high: int) -> list[tuple[int, int]]:
    """Cut the bits low..high into n blocks: (first bit, number of bits)."""
    at = [low + (high - low) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _block(fp, at, bits):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))


def link_fingerprints(fps: DataFrame, radius: int, tree: int = TREE) -> DataFrame:
    """Links (a, b) that join distinct fingerprints within the radius into classes.

    fps: column fp, distinct. Of radius + 1 blocks of bits, two fingerprints
    within the radius share one at least: a shard is a block and its bits. A
    shard with over ``tree`` fingerprints is split in the same way over the
    bits that its members don't share yet, so that a tree has a proven bound:
    with each level fewer bits are free, and 2**free bits the most there are.
    """
    spark = fps.sparkSession
    n, parts = radius + 1, n_partitions(spark)
    # Free bits stay contiguous: level by level the shared block is rotated out.
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), _block(F.col("fp"), a, b).alias("bits"), _outside(F.col("fp"), a, b, 64).alias("rest")) for i, (a, b) in enumerate(_blocks(n, 0, 64))]))
    # all ways count as the widest block being shared; the narrowest gives the free bits
    free = 64 - min(b for _, b in _blocks(n, 0, 64))
    rows = fps.select("fp", spread.alias("s")).select("fp", F.xxhash64("s.way", "s.bits").alias("shard"), F.col("s.rest").alias("rest"))
    found = []
    while True:
        if free <= n or (1 << free) <= tree:
            found.append(rows.select("fp", "shard"))
            break
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        large = cut(sizes.where(F.col("size") > tree).select("shard"))
        if large.isEmpty():
            found.append(rows.select("fp", "shard"))
            break
        found.append(rows.join(large, "shard", "left_anti").select("fp", "shard"))
        cuts = _blocks(n, 0, free)
        again = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), _block(F.col("rest"), a, b).alias("bits"), _outside(F.col("rest"), a, b, free).alias("rest")) for i, (a, b) in enumerate(cuts)]))
        rows = rows.join(large, "shard", "left_semi").select("fp", "shard", again.alias("s")).select("fp", F.xxhash64("shard", "s.way", "s.bits").alias("shard"), F.col("s.rest").alias("rest"))
        free -= min(b for _, b in cuts)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(own)
            found = forest(fp.astype(np.uint64).tolist(), radius) if len(fp) > 1 else []
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[i], pa.int64()), pa.array(fp[j], pa.int64())], names=["a", "b"])

        last, own = None, []
        for b in batches:
            if not b.num_rows:
                continue
            shard, fp = b.column("shard").to_numpy(), b.column("fp").to_numpy()
            cut = np.flatnonzero(np.diff(shard)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)]):
                if shard[s] != last and own:
                    yield from close(own)
                    own = []
                last = shard[s]
                own.append(fp[s:e])
        if own:
            yield from close(own)

    return every.repartition(parts, "shard").sortWithinPartitions("shard", "fp").mapInArrow(words.tidy(run), "a long, b long").distinct()


def _outside(value, at: int, bits: int, width: int):
    """The bits of value other than bits at..at+bits, moved together."""
    low = value.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
    if at + bits >= width:
        return low
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, at + bits), at))


def simhash_components(df: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose fingerprints link at ``radius`` or fewer bits.

    Returns id_col, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    smallest id reachable over links, its own included), one row per input row.

    Defined cases: a null or blank text has fingerprint zero, which links like
    any other; a null id stays null, never names a component unless all its
    members have null ids; repeated rows are kept, each with the same result;
    an empty table gives an empty result; other columns are not looked at.
    """
    docs = cut(fingerprints(df, id_col, text_col, width))
    own = docs.groupBy("fp").agg(F.min("doc").alias("least"))
    links = cut(link_fingerprints(own.select("fp"), radius))
    roots = connected_components(links)
    # root: a fingerprint that stands for the class
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
