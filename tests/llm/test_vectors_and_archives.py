import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest

from lakeloom.llm import ann, topk, warc

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 12)) / 4
    v[50:60] = v[3]
    v[100] = 0
    out = [(i, [float(x) for x in r]) for i, r in enumerate(v.astype(np.float32))]
    out += [(1000, None), (1050, []), (1100, [1.0, None] + [0.0] * 10), (1150, [NAN] * 12), (1200, [INF] + [0.0] * 11), (None, [1.0] * 12), (1250, [0.5, -0.5]), (1300, [0.25, 0.5]), (3, out[3][1])]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, rank string").repartition(4)


def valid(rows):
    return {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}


def test_exact_topk(df, rows):
    own = {i: np.floor(256 * v).astype(int) for i, v in valid(rows).items()}
    want = []
    for q in (i for i in own if i % 50 == 0):
        scored = sorted((-int(own[q] @ own[c]), c) for c in own if c != q and len(own[c]) == len(own[q]))[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    for size in (100, 8192):
        got = [tuple(r) for r in topk.exact_topk(df, df.where("vec_id % 50 = 0"), shard_rows=size).collect()]
        assert sorted(got) == sorted(want)


def test_exact_topk_of_large_values_and_none(spark, df):
    big = spark.createDataFrame([(50, [1e7, 1e7]), (1, [1e7, 1.0]), (2, [1e7 + 1, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_topk(big, big.where("vec_id = 50"), k=2).orderBy("rank").collect()]
    a = 2560000000
    assert got == [(50, 1, 2, a * (a + 256) + a * 256), (50, 2, 1, a * a + a * 256)]
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5000, 2))
    lists = topk.SortedLists(np.arange(5000), x)
    ids, scores = lists.search(-1, np.array([1.0, 0.5]), 3)
    want = np.argsort(-(x @ [1.0, 0.5]))[:3]
    assert ids.tolist() == want.tolist() and 0 < lists.depth < 2500


def test_scores_beyond_64_bits_are_an_error(spark):
    huge = spark.createDataFrame([(50, [1e14]), (1, [1e14])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.exact_topk(huge, huge.where("vec_id = 50")).collect()


def test_cosines_of_tiny_and_huge_vectors(spark):
    rows = [(0, [3e-200, 4e-200]), (1, [4e200, 3e200]), (2, [1.0, 0.0]), (3, [1e-320, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.ann_cosine(df, df.where("vec_id = 0")).collect()}
    assert got == {1: pytest.approx(0.96), 2: pytest.approx(0.6), 3: pytest.approx(0.6)}


def test_ann_recall(df, rows):
    own = {i: v for i, v in valid(rows).items() if v.any()}
    got = defaultdict(list)
    for r in ann.ann_cosine(df, df.where("vec_id % 50 = 0"), shard_rows=200).collect():
        v, q = own[r.vec_id], own[r.query_id]
        assert r.score == pytest.approx(float(v @ q / np.sqrt((v @ v) * (q @ q))), abs=1e-12)
        got[r.query_id].append((r["rank"], r.vec_id))
    hit = total = 0
    for q in (i for i in own if i % 50 == 0):
        near = sorted((-(own[q] @ own[c]) / np.sqrt((own[c] @ own[c]) * (own[q] @ own[q])), c) for c in own if c != q and len(own[c]) == len(own[q]))[:5]
        assert [r for r, _ in sorted(got[q])] == list(range(1, len(near) + 1))
        hit += len({c for _, c in got[q]} & {c for _, c in near})
        total += len(near)
    assert hit / total >= 0.9
    assert 100 not in got and not {1000, 1050, 1100, 1150, 1200} & set(got)


def test_ann_ties_and_none(spark, df):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = ann.ann_cosine(same, same.where("vec_id = 3")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4, 5] and len({r.score for r in got}) == 1
    assert ann.ann_cosine(df.limit(0), df.limit(0)).count() == 0
    assert ann.chi_square_cdf(15.507, 8) == pytest.approx(0.95, abs=1e-3)


def pages():
    long, other = "<p>" + "wörd " * 400, "y" * 999
    out = [(1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (3, "http://a/3", other), (4, "http://a/4", other), (5, "http://a/\r\nX: 1", None), (6, "u", ""), (None, "n", "z" * 2000), (None, "n", "q"), (11, "t", "z" * 2000), (12, "t", "x" * 1000), (12, "t", "x" * 1000)]
    return out + [(100 + i, f"http://b/{i}", f"page {i} " * (i * 7)) for i in range(60)]


def want(rows):
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h] = max(p, last.get(h, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and h in last and p != last[h]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    return sorted(out, key=str)


def test_archives(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "page_id long, url string, html string, shard int, kind string")
    made = {}
    for name, parts in (("a", 2), ("b", 7)):
        folder = f"file://{tmp_path}/{name}"
        warc.write_archives(df.repartition(parts), folder, shard_bytes=20_000, roll_bytes=2_000)
        got = warc.read_archives(spark, folder)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == want(rows)
        files = [f for f in os.listdir(tmp_path / name) if f.endswith(".warc.gz")]
        assert len(files) > 5 and not (tmp_path / name / "_temporary").exists()
        made[name] = {f: (tmp_path / name / f).read_bytes() for f in files}
    assert made["a"] == made["b"]  # whatever the partitions


def test_shards_are_ranges_of_bounded_size(spark, tmp_path):
    """Ids over all 64 bits, most of them in one small range, and one id with many payloads."""
    rows = [(-(1 << 63), "u", "a"), ((1 << 63) - 1, "u", "b"), (None, "u", "c")] + [(1000 + i, "u", f"p{i} " * 60) for i in range(400)] + [(5, "u", f"q{i} " * 60) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(df, f"file://{tmp_path}/w", shard_bytes=20_000, roll_bytes=1 << 20)
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == len(rows)
    shards = []
    for name in sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")):
        with open(tmp_path / "w" / name, "rb") as f:
            heads = [warc.parse(m)[0] for m in warc.members(f)]
        pages = [int(h["X-Page-Id"]) if "X-Page-Id" in h else -(1 << 70) for h in heads]
        assert pages == sorted(pages) and sum(int(h["X-Payload-Length"]) + 200 for h in heads) <= 20_000
        shards.append((pages[0], pages[-1]))
    assert shards == sorted(shards) and all(a[1] <= b[0] for a, b in zip(shards, shards[1:])) and 10 < len(shards) < 60


def test_what_lost_attempts_leave(spark, tmp_path):
    """Files of attempts that never ended, with the same names but for the attempt, are not read and go."""
    folder = tmp_path / "w"
    lost = warc._Writer(f"file://{folder}", 1 << 20)
    lost.write(0, warc.record(1, "u", b"other body", None, "1970-01-01T00:00:00Z"))
    lost.stream.flush()
    assert len(os.listdir(folder / "_temporary")) == 1
    df = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{folder}")
    assert [bytes(r.payload) for r in warc.read_archives(spark, f"file://{folder}").collect()] == [b"body"]
    assert not (folder / "_temporary").exists()
    # a commit that is tried again finds its files in place
    names = os.listdir(folder)
    warc.commit_files(spark, f"file://{folder}")
    assert sorted(os.listdir(folder)) == sorted(names)


def test_archive_of_nothing_and_torn_files(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    data = warc.record(1, "http://x", b"body", None, "2020-01-01T00:00:00Z")
    head, block = warc.parse(data)
    assert block.endswith(b"body") and head["WARC-Target-URI"] == "http://x"
    with pytest.raises(ValueError):
        warc.parse(data[:-3])
