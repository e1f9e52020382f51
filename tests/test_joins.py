import pytest

from lakeloom.operators import recommend as R
from lakeloom.operators.joins import skew_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [2, 1024])
def test_skew_join_equals_a_join(spark, how, hot):
    keys = [0] * 50 + [1] * 30 + [2, 3, 3, 4, 4, 5, None]
    big = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    small = spark.createDataFrame([(k, f"v{k}", keys.count(k)) for k in (0, 1, 2, 3, 9)], "k int, v string, n long")
    got = sorted(map(str, skew_join(big, small, ["k"], "n", how, hot).select("id", "k", "v", "n").collect()))
    assert got == sorted(map(str, big.join(small, "k", how).select("id", "k", "v", "n").collect()))
    assert skew_join(big, small.limit(0), ["k"], "n", how).count() == (len(keys) if how == "left" else 0)


def test_heavy_baskets_lose_no_pair(spark, monkeypatch):
    rows = [(u, i, float((u * i) % 7 + 1)) for u in range(6) for i in range(3 + 9 * (u % 3))]
    x = spark.createDataFrame(rows, "user int, item int, rating double")
    for how in ("cosine", "jaccard", "pearson"):
        whole = sorted((r.i, r.j, r.support, round(r.similarity, 9)) for r in R.similarity(x, how).collect())
        monkeypatch.setattr(R, "BASKET", 4)
        assert sorted((r.i, r.j, r.support, round(r.similarity, 9)) for r in R.similarity(x, how).collect()) == whole
        monkeypatch.undo()
