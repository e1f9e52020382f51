"""Near-duplicate documents: SimHash, BK-trees and a check of the similarity.

Fingerprints of texts at a Jaccard similarity of 0.8 differ in ten of 64 bits
on average, too many to spread them over shards by their bits. So the shards
are those of a few min-hashes of the shingles: texts of similarity s share one
of m shards with a probability of 1 - (1 - s)**m. In a shard a BK-tree over the
SimHash fingerprints gives the candidates within a generous radius. A sketch of
the shingle sets decides where it holds them whole or leaves no doubt; the other
pairs, unless sure links join them anyhow, are decided on their whole sets.
Texts with equal shingle sets are one entry from the start, so copies cost one
row each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import words
from lakeloom.llm.simhash import BucketTree, fingerprint
from lakeloom.operators.components import connected_components
from lakeloom.session import cut, n_partitions

#: Shards that a text goes to: at a similarity of 0.8 two texts miss each other once in 3,000 times.
SHARDS = 5
#: Least hashes of a shingle set that are kept. Sets up to this size are compared exactly.
SKETCH = 512
#: A sketch decides alone if it would err with a probability of exp(-DOUBT) at most (Chernoff's bound).
DOUBT = 20
#: Rows of whole shingle sets in one Arrow batch.
SETS = 256
#: Texts of a block; larger shards are dealt to blocks.
BLOCK = 1024
_SEEDS = words.mix(np.arange(1, SHARDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(body: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the word shingles of a text with A-Z lower-cased, ascending."""
    value, _ = words.hash_texts([body.lower()])
    if not len(value):
        return value
    return np.unique(words.mix(words.fold(value, min(width, len(value))) + np.uint64(min(width, len(value)))))


def sketch_similarity(a: np.ndarray, b: np.ndarray, whole: bool) -> float:
    """Jaccard similarity of two sets by their least hashes; exact if both are whole."""
    both = np.union1d(a, b)
    if not whole:
        both = both[:SKETCH]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, both[-1], side="right")) / len(both)


def similar(a: np.ndarray, b: np.ndarray, sizes: tuple[int, int], similarity: float) -> bool | None:
    """Whether two sets, given by their sketches and sizes, reach the similarity; None if the sketches cannot tell."""
    if min(sizes) / max(sizes) < similarity:  # no two sets of these sizes do
        return False
    whole = max(sizes) <= SKETCH
    s = sketch_similarity(a, b, whole)
    if not whole:
        pairs = [(x, y) for x, y in ((s, similarity), (1 - s, 1 - similarity)) if x > 0]
        apart = math.inf if any(y <= 0 for _, y in pairs) else sum(x * math.log(x / y) for x, y in pairs)
        if SKETCH * apart < DOUBT:
            return None
    return s >= similarity


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc, code, digest, fp, mins, size and sketch of docs (doc, code, body)."""
    names = ["doc", "code", "digest", "fp", "mins", "size", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in words.slices(b, "body"):
                digests, fps, mins, sizes, sketches = [], [], [], [], []
                for body in part.column("body").to_pylist():
                    own = shingle_set(body or b"", width)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest())
                    fps.append(fingerprint(own))
                    mins.append([int(words.mix(own ^ s).min().view(np.int64)) for s in _SEEDS] if len(own) else [])
                    sizes.append(len(own))
                    sketches.append(np.unique((own[:SKETCH] >> np.uint64(32)).astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("code"), pa.array(digests), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(mins, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], names=names
                )

    return docs.mapInArrow(words.tidy(run), "doc long, code long, digest string, fp long, mins array<long>, size int, sketch binary")


def shards(small: DataFrame) -> DataFrame:
    """shard, members, digest, fp: the shards of more than one text, from small (digest, fp, mins)."""
    seeds = small.select("digest", "fp", F.posexplode("mins").alias("way", "least_hash")).select("digest", "fp", F.xxhash64("way", "least_hash").alias("shard"))
    busy = seeds.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    return seeds.join(busy, "shard").select("shard", "members", "digest", "fp")


def all_pairs(rows: DataFrame, within: bool) -> DataFrame:
    """rows (shard, digest, fp, root) dealt so that any two of a shard meet in a group of two blocks at most.

    side: rows of different sides are compared, those of side 2 with all.
    within: also two rows of one block.
    """
    n = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.join(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("members")), "shard").withColumn("n", n)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows if within else rows.where("own <> other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rows.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "digest", "fp", "root", side.cast("byte").alias("side"))


def join_classes(values: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similarity: float, radius: int) -> tuple[list, list]:
    """Links that join classes of the members of a group, and pairs that the sketches leave open.

    label: classes known so far. A member is compared with those in other
    classes only, so a class of many near copies costs a link for each.
    """
    tree, found, left = BucketTree(values), [], []
    for i in range(len(values)):
        near = tree.search(values[i], radius)
        near = near[(near < i) & (label[near] != label[i]) & ((side[near] != side[i]) | (side[i] == 2))]
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i])]
        while len(near):
            j = int(near[0])
            same = similar(sets[i], sets[j], (int(sizes[i]), int(sizes[j])), similarity)
            near = near[1:]
            if same is None:
                left.append((i, j))
            elif same:
                found.append((i, j))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return found, [(i, j) for i, j in left if label[i] != label[j]]


def links(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b, sure) of digests that join classes within the groups of rows (shard, digest, fp, root, side, size, sketch); those not sure are yet to be decided on whole sets."""
    parts = n_partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list) -> Iterator[pa.RecordBatch]:
            digests, fps, roots, sides, sizes, sketches = zip(*held)
            _, label = np.unique(roots, return_inverse=True)
            found, left = join_classes(np.array(fps, np.int64).view(np.uint64), np.array(sizes), [np.frombuffer(s, np.uint32) for s in sketches], label, np.array(sides), similarity, radius)
            both = found + left
            for at in range(0, len(both), 1 << 16):
                part = both[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i, _ in part]), pa.array([digests[j] for _, j in part]), pa.array([at + k < len(found) for k in range(len(part))])], names=["a", "b", "sure"])

        shard, held = None, []
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                for s, *row in zip(*(part.column(c).to_pylist() for c in ("shard", "digest", "fp", "root", "side", "size", "sketch"))):
                    if s != shard:
                        if len(held) > 1:
                            yield from close(held)
                        shard, held = s, []
                    held.append(row)
        if len(held) > 1:
            yield from close(held)

    dealt = rows.select("shard", "digest", "fp", "root", "side", "size", "sketch").repartition(parts, "shard").sortWithinPartitions("shard", "digest")
    return dealt.mapInArrow(words.tidy(run), "a string, b string, sure boolean").distinct()


def all_links(feats: DataFrame, small: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b, sure) of digests that join them into classes.

    A shard of over BLOCK texts is dealt to blocks. Classes form in each block
    first; then one text of each class meets those of the shard's other blocks;
    only where a shard is of several classes even then, texts of different
    blocks and classes meet. So a hot group of near copies costs a few rows for
    each of its texts, and no pair of different classes is missed.
    """
    parts = n_partitions(small.sparkSession)
    seeds = cut(shards(small))
    sketches = feats.select("digest", "size", "sketch").join(seeds.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    own = F.pmod(F.xxhash64("digest"), F.ceil(F.col("members") / BLOCK)).cast("int")
    group = F.when(F.col("members") > BLOCK, F.xxhash64("shard", own)).otherwise(F.col("shard"))
    rows = seeds.select(group.alias("shard"), "digest", "fp", F.col("digest").alias("root"), F.lit(2).cast("byte").alias("side"))
    found = cut(links(rows.join(sketches, "digest"), similarity, radius))
    crowded = seeds.where(F.col("members") > BLOCK).select("shard", "digest", "fp")
    if crowded.isEmpty():
        return found
    sketches = cut(sketches.join(crowded.select("digest").distinct(), "digest", "left_semi"))

    def named() -> DataFrame:
        roots = connected_components(found.where("sure").select("a", "b"))
        return crowded.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("shard", "digest", "fp", F.coalesce("component", "digest").alias("root"))

    heads = named().groupBy("shard", "root").agg(F.min(F.struct("digest", "fp")).alias("head")).select("shard", "head.digest", "head.fp", "root")
    found = cut(found.union(links(all_pairs(cut(heads), within=True).join(sketches, "digest"), similarity, radius)).coalesce(parts))
    rest = cut(named())
    several = rest.groupBy("shard").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("shard")
    rest = cut(rest.join(several, "shard", "left_semi"))
    if rest.isEmpty():
        return found
    return cut(found.union(links(all_pairs(rest, within=False).join(sketches, "digest"), similarity, radius)).coalesce(parts))


def decide(unsure: DataFrame, texts: DataFrame, small: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of the pairs of digests (a, b), those whose whole shingle sets reach the similarity; texts: doc, code, body."""
    names = unsure.select(F.col("a").alias("digest")).union(unsure.select(F.col("b").alias("digest"))).distinct()
    wanted = small.join(names, "digest", "left_semi").select("least.doc", "least.code", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SETS):
                part = b.slice(at, SETS)
                sets = [shingle_set(body or b"", width).view(np.int64) for body in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "set"])

    once = texts.join(wanted, ["doc", "code"]).select("digest", "body").dropDuplicates(["digest"])
    sets = cut(once.mapInArrow(words.tidy(run), "digest string, set array<long>"))
    pairs = unsure.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    counted = pairs.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return counted.where(F.col("shared") / (F.col("sizes") - F.col("shared")) >= similarity).select("a", "b")


def near_dedup(df: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns of df.

    A group is a class of texts linked by a Jaccard similarity of
    ``similarity`` or more of their ``width``-word shingles; the row with the
    smallest id stays.

    Defined cases: null and blank texts have no shingles and are copies of one
    another; shorter texts are one shingle; a null id comes after all others,
    and among equal ids the smaller hash of the text first; of rows with equal id and
    text the one whose columns come first as JSON stays; an empty table gives an empty result; other columns are
    passed on.
    """
    last = (1 << 63) - 1
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("code")]
    texts = df.select(*key, F.col(text_col).cast("binary").alias("body"))
    feats = cut(features(texts, width))
    small = feats.groupBy("digest").agg(F.min(F.struct("doc", "code")).alias("least"), F.first("fp").alias("fp"), F.first("mins").alias("mins"))
    found = all_links(feats, small, similarity, radius)
    sure, unsure = found.where("sure").select("a", "b"), found.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = connected_components(sure)
    if not unsure.isEmpty():
        # pairs that sure links join in the end need no look at their sets
        sides = [roots.select(F.col("node").alias(x), F.col("component").alias(f"root_{x}")) for x in "ab"]
        apart = unsure.join(sides[0], "a", "left").join(sides[1], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        more = decide(cut(apart), texts, small, width, similarity)
        roots = connected_components(cut(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    named = small.select("digest", "least").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    stay = named.groupBy(F.coalesce("component", "digest").alias("root")).agg(F.min("least").alias("least")).select("least.doc", "least.code")
    packed = df.select(*key, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = packed.join(stay, ["doc", "code"], "left_semi")
    if not feats.groupBy("doc", "code").count().where("count > 1").isEmpty():
        kept = kept.groupBy("doc", "code").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*")
