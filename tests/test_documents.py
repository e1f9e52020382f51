import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.text import normalise, tokens
from lakeloom.operators import documents as D
from lakeloom.plans import documents as P

TEXTS = [(1, "The cat sat on the mat today."), (2, "the CAT sat, on the mat today"), (3, "A dog ran off with a bone"), (4, ""), (5, None), (6, "one two"), (7, "The cat sat on the mat yesterday")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string")


def words(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()


def test_normalise(spark):
    got = spark.createDataFrame([("  Straße--ÉTÉ 42!\n",), ("...",)], "t string").select(normalise("t").alias("x"), F.size(tokens("t")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("straße été 42", 3), ("", 0)]


def test_shingles(docs):
    got = {}
    for r in D.shingles(docs, 3).collect():
        got.setdefault(r.doc, []).append(r.shingle)
    want = {i: {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, t in TEXTS if (w := words(t))}
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    chars = {r.shingle for r in D.shingles(docs.where("doc_id = 6"), 3, unit="char").collect()}
    assert chars == {"one", "ne ", "e t", " tw", "two"}


def test_minhash_and_groups(docs):
    sets = D.shingle_sets(docs, 2)
    sig = D.minhash(docs, 6, 2)
    got = {r.doc: list(r.signature) for r in sig.collect()}
    own = {" ".join(words(TEXTS[0][1])[k : k + 2]) for k in range(6)}
    numbers = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % (2**31 - 1) for s in own]
    assert got[1] == [min((a * x + b) % (2**31 - 1) for x in numbers) for a, b in D.hash_parameters(6)]
    assert got[1] == got[2] and set(got) == {1, 2, 3, 6, 7}
    pairs = D.candidates(sig, 6, 1)
    assert (1, 2) in {tuple(r) for r in pairs.collect()}
    checked = {(r.a, r.b): r.jaccard for r in D.verify(pairs, sets, 0.5).collect()}
    assert checked[1, 2] == 1.0
    if (1, 7) in checked:
        assert checked[1, 7] == pytest.approx(5 / 7)
    assert {r.doc: r.group for r in D.groups(D.verify(pairs, sets, 0.5)).collect()}[2] == 1


def test_groups_of_the_registered_bands_equal_brute_force(spark):
    """Chains of texts around a similarity of 0.5: the bands lose next to none of the links."""
    rnd = random.Random(4)
    texts = []
    for g in range(12):
        own = [f"g{g}w{k}" for k in range(60)]
        for _ in range(6):
            own = [f"x{rnd.random()}" if rnd.random() < 0.05 else w for w in own]
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pairs = D.verify(D.candidates(D.minhash(df, P.HASHES, P.WIDTH), P.BANDS, P.HASHES // P.BANDS), D.shingle_sets(df, P.WIDTH), P.THRESHOLD)
    found = {(r.a, r.b) for r in pairs.collect()}
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (words(t) for t in texts)]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    first = {b: next(a for a in range(b + 1) if sets[a] == sets[b]) for b in range(len(texts))}  # a copy is tied to the first of its kind
    single = {(a, b) for a, b in want if first[a] == a and first[b] in (a, b)}
    assert found <= want and len(found & single) >= 0.98 * len(single) > 50
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc: r.group for r in D.groups(pairs).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == root


def test_silhouette(spark):
    points = np.random.default_rng(2).standard_normal((50, 3))
    centre = np.array([min(i % 4, 2) for i in range(49)] + [9])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    assigned = spark.createDataFrame([(i, int(c)) for i, c in enumerate(centre)], "id int, centre int")
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    scores = []
    for i, c in enumerate(centre):
        own = (centre == c) & (np.arange(50) != i)
        b = min(d[i, centre == k].mean() for k in set(centre.tolist()) - {c})
        scores.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own.any() else 0.0)
    got = D.silhouette(df, assigned).first()
    assert got.n == 50 and got.silhouette == pytest.approx(np.mean(scores))
    assert D.silhouette(df, assigned.withColumn("centre", F.lit(1))).first().silhouette is None


def test_assign_and_purity(spark):
    points = np.random.default_rng(0).standard_normal((40, 3))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    centres = df.where("id < 4").select(F.col("id").alias("centre"), F.col("v").alias("c"))
    got = {r.id: (r.centre, r.distance2) for r in D.assign(df, centres).collect()}
    d = ((points[:, None] - points[None, :4]) ** 2).sum(-1)
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    labels = df.select("id", (F.col("id") % 2).alias("label"))
    assert 0.5 <= D.purity(D.assign(df, centres), labels).first().purity <= 1


def test_kmeans_inertia_never_rises(spark):
    points = np.random.default_rng(1).standard_normal((200, 2))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    costs = [D.inertia(D.assign(df, D.centres_of(D.kmeans(df, 4, seed=3, max_iter=n), spark))).first().inertia for n in (1, 3, 10)]
    assert costs == sorted(costs, reverse=True)


def test_signature_vectors(docs):
    rows = D.signature_vectors(D.minhash(docs, 4, 2)).collect()
    by = {r.doc: r.features for r in rows}
    assert by[1].squared_distance(by[2]) == 0 and by[1].squared_distance(by[3]) >= 4


def test_digests_and_signatures_of_many_texts(docs, spark, monkeypatch):
    """Texts beyond the basic plane, of one word and of several slices of a task."""
    texts = [(i, t) for i, t in TEXTS] + [(8, "é𝄞𐐷 ß𐐷𐐷é x𐐷𐐷é"), (9, "ab" * 4000), (10, "!?")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    plain = {r.doc_id: r.plain for r in df.select("doc_id", normalise("text").alias("plain")).collect() if r.plain}
    want = {}
    for i, t in plain.items():
        own = {t[k : k + 5] for k in range(max(1, len(t) - 4))}
        want[i] = (len(own), hashlib.md5("|".join(sorted(own, key=str.encode)).encode()).hexdigest())
    assert {r.doc: (r.n, r.shingles) for r in D.shingle_digests(df, 5).collect()} == want and set(want) == {1, 2, 3, 6, 7, 8, 9}
    sig = {r.doc: list(r.signature) for r in D.minhash(df, 3, 4, unit="char").collect()}
    for i, t in plain.items():
        numbers = [int(hashlib.md5(t[k : k + 4].encode()).hexdigest()[:8], 16) % (2**31 - 1) for k in range(max(1, len(t) - 3))]
        assert sig[i] == [min((a * x + b) % (2**31 - 1) for x in numbers) for a, b in D.hash_parameters(3)]


def test_shingles_are_made_without_lambdas_per_element(docs, capsys):
    for df in (D.minhash(docs, 6, 2), D.shingle_digests(docs, 5)):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("basket", [1024, 4])
def test_candidates_are_given_once_and_bounds_lose_no_link(spark, monkeypatch, basket):
    """Pairs of equal bands leave their tasks once, also in blocks; sketches drop most far pairs and no near one."""
    rnd = random.Random(9)
    common = [f"c{k}" for k in range(12)]
    texts = [" ".join(rnd.choice(common) for _ in range(rnd.randint(4, 60))) for _ in range(60)]
    texts += [t + " c1 c2" for t in texts[:20]] + texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sig = D.minhash(df, 12, 1, sketch=True)
    monkeypatch.setattr(D.R, "BASKET", basket)
    rows = [(r.doc, tuple(r.signature)) for r in sig.collect()]
    least = {s: min(d for d, t in rows if t == s) for _, s in rows}
    same = [(d, s) for s, d in least.items()]
    want = {(least[s], d) for d, s in rows if d != least[s]} | {(a, b) for a, s in same for b, t in same if a < b and any(s[k : k + 2] == t[k : k + 2] for k in range(0, 12, 2))}
    plan = D.matches(sig, 6, 2)
    got = [(r.a, r.b) for r in plan.collect()]
    assert sorted(got) == sorted(want)
    agree = dict(rows)
    assert all(r.same == sum(x == y for x, y in zip(agree[r.a], agree[r.b])) for r in plan.collect())
    sets = {i: set(words(t)) for i, t in enumerate(texts)}
    near = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    few = {(r.a, r.b) for r in D.candidates(sig, 6, 2, 0.8).collect()}
    assert near <= few <= want and len(few - near) < 0.2 * len(want - near)
