"""Connected components of an undirected graph, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import cut


def _join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of a bounded graph as edges to the least node of each component."""
    root: dict = {}

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for own in batches:
        for x, y in zip(own["u"].tolist(), own["v"].tolist()):
            root.setdefault(x, x)
            root.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    done = [(x, find(x)) for x in root]
    done = [(x, y) for x, y in done if x != y]
    yield pd.DataFrame({"u": [x for x, _ in done], "v": [y for _, y in done]})


#: Nodes that a task knows at a time, about, when it joins its own links.
KNOWN = 1 << 19


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) of a part as links that tie the same nodes, at most one a node; a new set is begun at KNOWN nodes."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def forest() -> pd.DataFrame:
        return pd.DataFrame({"u": list(root), "v": [find(x) for x in root]})

    for own in batches:
        own = own.drop_duplicates()
        for x, y in zip(own["u"].tolist(), own["v"].tolist()):
            x, y = find(root.setdefault(x, x) if x not in root else x), find(root.setdefault(y, y) if y not in root else y)
            if x != y:
                root[x] = y
        if len(root) > KNOWN:
            yield forest()
            root.clear()
    if root:
        yield forest()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 200_000) -> DataFrame:
    """node, component (least node of its component) for the nodes of ``links``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every
    round is two aggregations and two joins by node, so no component is ever
    gathered in one task; a hub's rows are split by skew-join handling. Each
    round's lineage is cut with a checkpoint. Links with a null end are
    dropped; a self-link makes its node a component. Each part of the links is
    first replaced by as few that tie the same nodes. Once there are no more
    than ``few`` edges, one task joins the rest: its size is known, and small
    graphs need no rounds.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    ends = cut(ends.mapInPandas(_contract, ends.schema))
    nodes = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    edges = cut(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        if now[0] <= few:
            edges = cut(edges.coalesce(1).mapInPandas(_join, edges.schema))
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is tied to the least of the neighbourhood
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are tied to the least one
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
