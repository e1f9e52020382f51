import pytest
from pyspark.sql import functions as F

from lakeloom.operators import graph as G
from lakeloom.operators.components import connected_components

LINKS = [("a", "b", 1.0), ("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0), (None, "a", 1.0), ("d", "d", 5.0)]


@pytest.fixture(scope="module")
def e(spark):
    return spark.createDataFrame(LINKS, "src string, dst string, weight double")


def test_edges_add_up_and_drop_nulls(e):
    got = {(r.src, r.dst): r.weight for r in G.edges(e, weight="weight", drop_loops=True).collect()}
    assert got == {("a", "b"): 3.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("c", "d"): 1.0}


def test_nodes_degrees_dangling(e):
    own = G.edges(e, weight="weight", drop_loops=True)
    assert {r.node for r in G.nodes(own).collect()} == set("abcd")
    d = {r.node: (r.in_degree, r.out_degree, r.in_weight, r.out_weight) for r in G.degrees(own).collect()}
    assert d["a"] == (1, 1, 1.0, 3.0) and d["d"] == (1, 0, 1.0, 0.0)
    assert [r.node for r in G.dangling(own).collect()] == ["d"]


def brute(links, d=0.85, rounds=30, restart=None):
    names = sorted({x for a, b, _ in links for x in (a, b)})
    jump = {n: (1 / len(names) if restart is None else restart.get(n, 0.0)) for n in names}
    rank = dict(jump)
    for _ in range(rounds):
        lost = sum(rank[n] for n in names if not any(a == n for a, _, _ in links))
        new = {n: (1 - d) * jump[n] + d * lost * jump[n] for n in names}
        for a, b, w in links:
            new[b] += d * rank[a] * w / sum(x for s, _, x in links if s == a)
        rank = new
    return rank


def test_pagerank(spark, e):
    own = G.edges(e, weight="weight", drop_loops=True)
    links = [(r.src, r.dst, r.weight) for r in own.collect()]
    got = {r.node: r["rank"] for r in G.pagerank(own, iters=30).collect()}
    assert got == pytest.approx(brute(links)) and sum(got.values()) == pytest.approx(1)
    r = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("x", 9.0)], "node string, weight double")
    got = {x.node: x["rank"] for x in G.pagerank(own, iters=10, restart=r).collect()}
    assert got == pytest.approx(brute(links, rounds=10, restart={"a": 0.5, "b": 0.5}))


def test_pagerank_stops_and_loses(e):
    own = G.edges(e, drop_loops=True)
    got = {r.node: r["rank"] for r in G.pagerank(own, iters=200, tol=1e-12).collect()}
    assert sum(got.values()) == pytest.approx(1)
    loose = G.pagerank(own, iters=50, mode="unnormalised").agg(F.sum("rank")).first()[0]
    assert loose < 4
    with pytest.raises(ValueError):
        G.pagerank(own, mode="other")


def test_pagerank_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    assert G.pagerank(none).count() == 0


@pytest.mark.parametrize("few", [0, 10, 200_000])
def test_components(spark, few):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 1), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a int, b int"), few=few).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    names = connected_components(spark.createDataFrame([("b", "é"), ("é", "z"), ("x", "y")], "a string, b string"), few=few)
    assert {r.node: r.component for r in names.collect()} == {"b": "b", "é": "b", "z": "b", "x": "x", "y": "x"}


@pytest.mark.parametrize("tol", [None, 3e-3])
def test_rounds_without_long_paths_need_few_checkpoints(spark, monkeypatch, tol):
    """Where no path is long, rounds follow from the first steps and edges are not walked again."""
    links = [(f"c{i}", f"s{i * j % 5}", 1.0) for i in range(9) for j in range(1, 4)] + [(f"s{i}", f"p{i * j % 7}", 1.0) for i in range(5) for j in range(1, 5)]
    own = G.edges(spark.createDataFrame(links, "src string, dst string, weight double"))
    made, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: made.append(1) or real(df))
    got = {r.node: r["rank"] for r in G.pagerank(own, iters=7, tol=tol).collect()}
    plain = brute([(r.src, r.dst, r.weight) for r in own.collect()], rounds=7)
    assert got == pytest.approx(plain, abs=3e-2 if tol else 1e-12) and len(made) <= 5
    monkeypatch.setattr(G, "SHALLOW", 0)
    again = {r.node: r["rank"] for r in G.pagerank(own, iters=7, tol=tol).collect()}
    assert again == pytest.approx(got, abs=1e-12) and len(made) > 8


def test_links_of_a_part_are_contracted_first():
    import pandas as pd

    from lakeloom.operators import components as C

    links = pd.DataFrame([(i % 50, (i * 7) % 50) for i in range(2000)] + [(99, 99)], columns=["u", "v"])
    got = pd.concat(C._contract(iter([links[:900], links[900:]])))
    assert len(got) == 51 and set(got["u"]) == {*range(50), 99}
    whole, few = (pd.concat(C._join(iter([x]))).set_index("u")["v"].to_dict() for x in (links, got))
    assert whole == few
