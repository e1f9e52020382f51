"""Registered queries against their SQL, and the stages of the pipeline."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from lakeloom.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"word{i} the of and" for i in range(60))
    extra = "long clean text about a river and its many towns along the quiet banks of the south"
    noise = " ".join("qzxjvkw"[i % 7] * 3 + "xqjz"[i % 4] * 2 + "wvkq"[i % 3] * 2 for i in range(30))
    rows = [(1, base, "en"), (2, base, "en"), (3, base.replace("word7 ", "wordX "), "en"), (4, extra, "de"), (5, None, "en"), (6, "123 ½", None), (7, "der die das und ist " * 400, "de"), (8, noise, None), (9, extra + " with some more of it to learn " + extra, "en"), (10, "und das ist die " * 8, None)]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1, "y") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, _n_dropped int, lang_pred string")
    docs, kept = df, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if n < 4:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[n] = sorted(r.doc_id for r in docs.select("doc_id").distinct().collect())
        if n == 0:
            assert {r.doc_id: r.lang for r in docs.collect()} == {1: "en", 2: "en", 3: "en", 4: "en", 7: "de", 9: "en", 10: "de"}
    assert kept[0] == [1, 2, 3, 4, 7, 9, 10] and {4, 7} <= set(kept[3]) and kept[2] == [1, 4, 7, 9, 10] and kept[4] == kept[3]
    german = corpus_pipeline.language(spark, df, "", languages=("de",))
    assert sorted(r.doc_id for r in german.collect()) == [7, 10]
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
