import math

import pytest

from lakeloom.operators import recommend as R
from lakeloom.sources.pairs import read_pairs, write_pairs

ROWS = [(1, 10, 4.0), (1, 11, 2.0), (2, 10, 1.0), (2, 11, 3.0), (2, 12, 5.0), (3, 12, 2.0), (3, 10, 2.0), (1, 10, 1.0), (None, 10, 1.0), (4, None, 1.0), (5, 11, None)]


@pytest.fixture(scope="module")
def x(spark):
    return R.interactions(spark.createDataFrame(ROWS, "u int, i int, r double"), "u", "i", "r")


def by_item(x):
    out = {}
    for r in x.collect():
        out.setdefault(r.item, {})[r.user] = r.rating
    return out


def test_interactions(x):
    assert by_item(x) == {10: {1: 5.0, 2: 1.0, 3: 2.0}, 11: {1: 2.0, 2: 3.0}, 12: {2: 5.0, 3: 2.0}}


@pytest.mark.parametrize("how", ["cosine", "jaccard", "pearson", "adjusted_cosine"])
def test_similarity(x, how):
    own = by_item(x)
    if how == "adjusted_cosine":
        users = {u: [v[u] for v in own.values() if u in v] for u in (1, 2, 3)}
        own = {i: {u: r - sum(users[u]) / len(users[u]) for u, r in v.items()} for i, v in own.items()}
    want = {}
    for i in own:
        for j in own:
            both = own[i].keys() & own[j].keys()
            if i < j and both:
                a, b = [own[i][u] for u in both], [own[j][u] for u in both]
                if how == "jaccard":
                    want[i, j] = len(both) / len(own[i].keys() | own[j].keys())
                elif how == "pearson":
                    ma, mb = sum(a) / len(a), sum(b) / len(b)
                    va, vb = sum((p - ma) ** 2 for p in a), sum((q - mb) ** 2 for q in b)
                    if va and vb:
                        want[i, j] = sum((p - ma) * (q - mb) for p, q in zip(a, b)) / math.sqrt(va * vb)
                else:
                    norm = math.sqrt(sum(v * v for v in own[i].values()) * sum(v * v for v in own[j].values()))
                    want[i, j] = sum(p * q for p, q in zip(a, b)) / norm
    got = {(r.i, r.j): r.similarity for r in R.similarity(x, how).collect()}
    assert got == pytest.approx(want)
    assert all(-1 - 1e-9 <= s <= 1 + 1e-9 for s in got.values())


def test_neighbours_are_symmetric_without_self(x):
    nb = [(r.item, r.neighbour) for r in R.neighbours(R.similarity(x), 8).collect()]
    assert {(b, a) for a, b in nb} == set(nb) and all(a != b for a, b in nb)


def test_predict_and_recommend(x):
    nb = R.neighbours(R.similarity(x), 5)
    got = {(r.user, r.item): r.prediction for r in R.predict(x, nb).collect()}
    sim = {(r.item, r.neighbour): r.similarity for r in nb.collect()}
    a, b = sim[12, 10], sim[12, 11]
    assert got[1, 12] == pytest.approx((a * 5 + b * 2) / (a + b))
    seen = {(r.user, r.item) for r in x.collect()}
    assert not seen & {(r.user, r.item) for r in R.recommend(x, nb, 3).collect()}


def test_cap(x):
    assert sorted((r.user, r.item) for r in R.cap_per_user(x, 1).collect()) == [(1, 10), (2, 10), (3, 10)]


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 1.0)], "user int, item int, rating double")
    pred = spark.createDataFrame([(1, 1, 3.0, 1), (2, 5, 1.0, 1)], "user int, item int, prediction double, rank int")
    assert R.rmse(pred, truth).first().rmse == pytest.approx(1)
    m = R.precision_recall(pred, truth, 1).first()
    assert (m.users, m.precision, m.recall) == (2, pytest.approx(0.5), pytest.approx(0.25))


def test_pairs_round_trip(spark, tmp_path):
    rows = [("1", "2"), ("2", "1"), ("9", "3")]
    write_pairs(spark.createDataFrame(rows, "src string, dst string"), f"{tmp_path}/p", text=True)
    assert sorted(map(tuple, read_pairs(spark, f"{tmp_path}/p").collect())) == rows
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "part-00000").write_text("(u'1', u'2')\nno pair\n(u'4', u'8')\n")
    assert sorted(map(tuple, read_pairs(spark, f"{tmp_path}/old").collect())) == [("1", "2"), ("4", "8")]


@pytest.mark.parametrize("how", ["cosine", "jaccard", "pearson", "adjusted_cosine"])
def test_only_pairs_that_recur_become_rows(spark, monkeypatch, how):
    """Pairs below the support are left out before rows are made of them, and no other pair is."""
    rows = [(u, f"i{(u * 7 + k * k * (1 + u % 5)) % 90}", float((u * k) % 7 + 1)) for u in range(60) for k in range(2 + u % 25)]
    x = R.interactions(spark.createDataFrame(rows, "u int, i string, r double"), "u", "i", "r")

    def result():
        return sorted((r.i, r.j, r.support, round(r.similarity, 9)) for r in R.similarity(x, how, 3).collect())

    whole, most = result(), max(r.n for r in x.groupBy("user").count().toDF("u", "n").collect())
    made = []
    monkeypatch.setattr(R, "FEW", 0)
    real = R._recurring
    monkeypatch.setattr(R, "_recurring", lambda *a: made.append(real(*a)) or made[-1])
    assert result() == whole and len(whole) > 20
    monkeypatch.setattr(R, "CHUNK", 64)  # many buckets
    monkeypatch.setattr(R, "BASKET", most // 3)  # blocks
    assert result() == whole
    marks, _, wide = made[0]
    recurring = R.cooccur(x, 3).count()
    assert recurring <= sum(bin(b).count("1") for b in marks) + 2 and sum(bin(b).count("1") for b in marks) <= 1.1 * recurring < 0.5 * R.cooccur(x).count()
