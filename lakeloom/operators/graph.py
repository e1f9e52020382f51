"""PageRank and the graph operators around it, on edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import cut, n_partitions


def edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, drop_loops: bool = False) -> DataFrame:
    """One row (src, dst, weight) per directed edge; null ends go, weights add up; without a weight column an edge weighs 1.0 however often it comes."""
    e = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    e = e.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if drop_loops:
        e = e.where("src <> dst")
    return e.groupBy("src", "dst").agg((F.sum("weight") if weight else F.max("weight")).alias("weight"))


def nodes(e: DataFrame) -> DataFrame:
    """Every src or dst."""
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, in_weight, out_weight, in one pass over the edges."""
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = e.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), no.alias("i"), one.alias("o"), F.lit(0.0).alias("iw"), F.col("weight").alias("ow")),
                F.struct(F.col("dst").alias("node"), one.alias("i"), no.alias("o"), F.col("weight").alias("iw"), F.lit(0.0).alias("ow")),
            )
        ).alias("x")
    ).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"))


def dangling(e: DataFrame) -> DataFrame:
    """Nodes without an out-edge."""
    return nodes(e).join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


#: Steps of the restart vector that are kept apart.
SHALLOW = 3


def pagerank(e: DataFrame, d: float = 0.85, iters: int = 20, tol: float | None = None, mode: str = "normalised", restart: DataFrame | None = None, hub: int = 1024) -> DataFrame:
    """node, rank after ``iters`` rounds, or earlier once the L1 change is at most ``tol``.

    normalised: ranks start at 1/N and add up to 1; the rank of dangling nodes
    is spread like the restart. unnormalised: ranks start at 1, the base is
    1 - d and the dangling rank is lost. restart: (node, weight), a restart
    vector in place of the even one; its weights are scaled to add up to 1.

    The edges' shares are dealt by node once and kept so, on disk where memory
    is short; a round moves ranks and partial sums by destination, never the
    edges. Nodes with over 1 / ``hub`` of all edges are fewer than ``hub``:
    their edges stay where they are and meet their ranks by broadcast. Each
    round ends with a checkpoint of the ranks, so the plan does not grow.

    A round is linear: ranks are sums of the restart vector and of what it
    passes on in one step, two steps and so on. The first ``SHALLOW`` steps are
    kept apart. Where no path is longer, all rounds follow from them exactly,
    with numbers alone; otherwise rounds go on from the ranks that they give.
    """
    if mode not in ("normalised", "unnormalised"):
        raise ValueError(mode)
    spark = e.sparkSession
    parts = n_partitions(spark)
    own = e.storageLevel == StorageLevel.NONE
    if own:
        e.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _pagerank(e, parts, d, iters, tol, mode, restart, hub)
    finally:
        if own:
            e.unpersist()


def _pagerank(e: DataFrame, parts: int, d: float, iters: int, tol: float | None, mode: str, restart: DataFrame | None, hub: int) -> DataFrame:
    out = e.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("links"))
    base = nodes(e).join(out.select(F.col("src").alias("node"), "total", "links"), "node", "left")
    if restart is not None:
        r = restart.select("node", F.col("weight").cast("double").alias("w")).groupBy("node").agg(F.sum("w").alias("w"))
        base = base.join(r, "node", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    else:
        base = base.withColumn("w", F.lit(1.0))
    base = cut(base)
    n, total, most, all_links = base.agg(F.count(F.lit(1)), F.sum("w"), F.max("links"), F.sum("links")).first()
    if n == 0:
        return base.select("node", F.lit(0.0).alias("rank"))
    if not total > 0:
        raise ValueError("no node of the restart vector is in the graph")
    many = (all_links or 0) // hub
    hubs = (most or 0) > max(1, many)
    base = base.select("node", "total", "links", F.col("total").isNull().alias("loose"), (F.col("w") / F.lit(total)).alias("jump")).repartition(parts, "node").persist(StorageLevel.MEMORY_AND_DISK)
    rows = e.select(F.col("src").alias("node"), "dst", "weight")
    of_hubs = None
    if hubs:
        wide = F.broadcast(base.where(F.col("links") > max(1, many)).select("node", "total"))
        of_hubs = cut(rows.join(wide, "node").select("node", "dst", (F.col("weight") / F.col("total")).alias("share")))
        rows = rows.join(wide.select("node"), "node", "left_anti")
    dealt = rows.repartition(parts, "node").join(base.select("node", "total"), "node").select("node", "dst", (F.col("weight") / F.col("total")).alias("share")).persist(StorageLevel.MEMORY_AND_DISK)
    scaled = mode == "normalised"

    def passed(rank: DataFrame) -> DataFrame:
        """node, flow: what the column ``rank`` passes on over the edges."""
        flow = rank.select("node", "rank").join(dealt, "node").select("dst", (F.col("rank") * F.col("share")).alias("flow"))
        if of_hubs is not None:
            wide = F.broadcast(rank.where(F.col("links") > max(1, many)).select("node", "rank"))
            flow = flow.union(of_hubs.join(wide, "node").select("dst", (F.col("rank") * F.col("share")).alias("flow")))
        return flow.groupBy(F.col("dst").alias("node")).agg(F.sum("flow").alias("flow"))

    steps = base.select("node", (F.col("jump") if scaled else F.lit(1.0)).alias("s0"), "loose", "links")
    lost: list[float] = []
    done = 0  # steps beyond the restart vector
    while True:
        held = F.col(f"s{done}")
        at_loose, elsewhere = steps.agg(F.sum(F.when(F.col("loose"), held)), F.max(F.when(~F.col("loose"), F.abs(held)))).first()
        lost.append(at_loose or 0.0)
        ends = not elsewhere  # what is nowhere but at dangling nodes is passed on no more
        if ends or done == min(SHALLOW, iters):
            break
        more = passed(steps.select("node", held.alias("rank"), "links").where("rank <> 0"))
        done += 1
        steps = cut(steps.join(more, "node", "left").withColumn(f"s{done}", d * F.coalesce("flow", F.lit(0.0))).drop("flow"))
    # the share of each step in the ranks after each round
    shares = [[1.0]]
    for _ in range(iters if ends else done):
        back = (1 - d) + (d * sum(c * x for c, x in zip(shares[-1], lost)) if scaled else 0.0)
        shares.append([back, *shares[-1]][: done + 1])

    def mixed(by: list[float]):
        return sum((c * F.col(f"s{i}") for i, c in enumerate(by)), F.lit(0.0))

    last, settled = len(shares) - 1, False
    if tol is not None and last:
        changes = steps.agg(*[F.sum(F.abs(mixed([x - y for x, y in zip(new, [*old, 0.0])]))).alias(f"r{k}") for k, (old, new) in enumerate(zip(shares, shares[1:]), 1)]).first()
        stop = next((k for k, change in enumerate(changes, 1) if change <= tol), None)
        last, settled = stop or last, stop is not None
    rank = cut(steps.select("node", mixed(shares[last]).alias("rank"), "loose", "links"))
    for _ in range(0 if settled else iters - last):
        new = base.join(passed(rank), "node", "left")
        flowed = F.coalesce("flow", F.lit(0.0))
        if scaled:
            lost_now = rank.agg(F.sum(F.when(F.col("loose"), F.col("rank")).otherwise(0.0)).alias("lost"))
            new = new.crossJoin(F.broadcast(lost_now))  # one row
            value = (1 - d) * F.col("jump") + d * (flowed + F.col("lost") * F.col("jump"))
        else:
            value = (1 - d) + d * flowed
        new = cut(new.select("node", value.alias("rank"), "loose", "links"))
        change = None
        if tol is not None:
            change = rank.select("node", F.col("rank").alias("old")).join(new, "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new
        if change is not None and change <= tol:
            break
    dealt.unpersist()
    base.unpersist()
    return rank.select("node", "rank")
