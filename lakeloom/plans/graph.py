"""PageRank queries over the trade graph: customer -> supplier -> part, weighted by quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import graph as G
from lakeloom.operators.components import connected_components
from lakeloom.session import table

ROUNDS = 4


def _raw(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    buys = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_quantity").alias("w"))
    sells = line.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").alias("w"))
    return buys.unionByName(sells)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(_raw(spark, d), weight="w")


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_nodes(spark, d):
    return G.nodes(_edges(spark, d))


def graph_degrees(spark, d):
    return G.degrees(_edges(spark, d))


def graph_dangling(spark, d):
    return G.dangling(_edges(spark, d))


def _ranked(r: DataFrame) -> DataFrame:
    return r.select("node", F.round("rank", 9).alias("rank"))


def graph_pagerank(spark, d):
    return _ranked(G.pagerank(G.edges(_raw(spark, d)), iters=ROUNDS))


def graph_pagerank_weighted(spark, d):
    return _ranked(G.pagerank(_edges(spark, d), iters=ROUNDS))


def graph_pagerank_unnormalised(spark, d):
    return G.pagerank(G.edges(_raw(spark, d)), iters=ROUNDS, mode="unnormalised").select("node", F.round("rank", 6).alias("rank"))


def graph_pagerank_personalised(spark, d):
    start = table(spark, d, "customer").where(F.col("c_nationkey") == 7).select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit(1.0).alias("weight"))
    return _ranked(G.pagerank(G.edges(_raw(spark, d)), iters=ROUNDS, restart=start))


def graph_pagerank_converged(spark, d):
    return G.pagerank(G.edges(_raw(spark, d)), iters=50, tol=1e-8).select("node", F.round("rank", 6).alias("rank"))


def graph_components(spark, d):
    return connected_components(_raw(spark, d), "src", "dst")  # weights do not matter


_E = """
raw as (
  select 'c' || o_custkey as src, 's' || l_suppkey as dst, l_quantity as w from orders join lineitem on o_orderkey = l_orderkey
  union all select 's' || l_suppkey, 'p' || l_partkey, l_quantity from lineitem
), e as materialized (select src, dst, {weight} as weight from raw group by src, dst),
nodes as materialized (select distinct node from (select src as node from e union all select dst from e))
"""
_EDGES = "with " + _E.format(weight="sum(w)")


def _pagerank_sql(weight: str, rounds: int, normalised: bool = True, restart: str | None = None, digits: int = 9) -> str:
    parts = [
        _E.format(weight=weight),
        "total as (select src, sum(weight) as total from e group by src)",
        "share as materialized (select e.src, e.dst, e.weight / t.total as share from e join total t on e.src = t.src)",
        f"jump as materialized ({restart or 'select node, cast(1 as double) / (select count(*) from nodes) as jump from nodes'})",
        "base as materialized (select j.node, j.jump, t.src is null as loose from jump j left join total t on j.node = t.src)",
        f"r0 as materialized (select node, {'jump' if normalised else 'cast(1 as double)'} as rank from base)",
    ]
    for i in range(1, rounds + 1):
        flow = f"(select s.dst as node, sum(r.rank * s.share) as flow from r{i - 1} r join share s on r.node = s.src group by s.dst)"
        if normalised:
            lost = f"(select coalesce(sum(r.rank), 0) from r{i - 1} r join base b on r.node = b.node where b.loose)"
            value = f"0.15::double * b.jump + 0.85::double * (coalesce(f.flow, 0) + {lost} * b.jump)"
        else:
            value = "0.15::double + 0.85::double * coalesce(f.flow, 0)"
        parts.append(f"r{i} as materialized (select b.node, {value} as rank from base b left join {flow} f on b.node = f.node)")
    return "with " + ",\n".join(parts) + f"\nselect node, round(rank, {digits}) as rank from r{rounds}"


_RESTART = """
select n.node, case when c.c_custkey is not null then cast(1 as double) else 0 end / (select count(*) from customer join nodes on node = 'c' || c_custkey where c_nationkey = 7) as jump
from nodes n left join customer c on n.node = 'c' || c.c_custkey and c.c_nationkey = 7
"""

QUERIES = {f.__name__: f for f in (graph_edges, graph_nodes, graph_degrees, graph_dangling, graph_pagerank, graph_pagerank_weighted, graph_pagerank_unnormalised, graph_pagerank_personalised, graph_pagerank_converged, graph_components)}
ORACLES = {
    "graph_edges": _EDGES + "select src, dst, weight from e",
    "graph_nodes": _EDGES + "select node from nodes",
    "graph_degrees": _EDGES
    + """, x as (select src as node, 0 as i, 1 as o, 0.0::double as iw, weight as ow from e union all select dst, 1, 0, weight, 0.0 from e)
select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, sum(iw) as in_weight, sum(ow) as out_weight from x group by node""",
    "graph_dangling": _EDGES + "select node from nodes where node not in (select src from e)",
    "graph_pagerank": _pagerank_sql("cast(1 as double)", ROUNDS),
    "graph_pagerank_weighted": _pagerank_sql("sum(w)", ROUNDS),
    "graph_pagerank_unnormalised": _pagerank_sql("cast(1 as double)", ROUNDS, normalised=False, digits=6),
    "graph_pagerank_personalised": _pagerank_sql("cast(1 as double)", ROUNDS, restart=_RESTART),
    "graph_pagerank_converged": _pagerank_sql("cast(1 as double)", 50, digits=6),
    # the least label spreads a step a round; trade routes are far shorter than the rounds
    "graph_components": _EDGES
    + ", link as materialized (select src as a, dst as b from e union select dst, src from e), c0 as materialized (select node, node as component from nodes), "
    + ", ".join(f"c{i} as materialized (select c.node, least(c.component, min(o.component)) as component from c{i - 1} c join link l on l.a = c.node join c{i - 1} o on o.node = l.b group by c.node, c.component)" for i in range(1, 13))
    + " select node, component from c12",
}
