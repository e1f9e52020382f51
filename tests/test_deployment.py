import pytest

from lakeloom import session
from lakeloom.__main__ import main
from lakeloom.sources.corpus import read_corpus


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class NoDir:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            isDefined = staticmethod(lambda: False)

                        return Empty

                return NoDir

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_batch_runs(spark, sf, tmp_path, capsys):
    main(["list"])
    assert "graph_pagerank" in capsys.readouterr().out
    main(["run", "graph_nodes", sf, f"{tmp_path}/nodes"])
    assert spark.read.parquet(f"{tmp_path}/nodes").count() > 0
    main(["sql", "select n_name from nation where n_regionkey = 1", sf, f"{tmp_path}/names"])
    assert spark.read.parquet(f"{tmp_path}/names").count() == 5
    with pytest.raises(SystemExit):
        main(["run", "nothing", sf, f"{tmp_path}/no"])


def test_small_files_are_packed_when_the_query_runs(spark, tmp_path):
    for split in ("x-train", "x-test"):
        for group in ("a", "b"):
            folder = tmp_path / split / group
            folder.mkdir(parents=True)
            for k in range(50):
                (folder / str(k)).write_text(f"From: me\n\n{split} {group} {k}")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    got = read_corpus(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 4 and spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert {(r.split, r.group, r.doc) for r in got.collect()} == {(s, g, str(k)) for s in ("train", "test") for g in "ab" for k in range(50)}
    labels = spark.createDataFrame([("a", 1)], "group string, label int")
    assert got.join(labels, "group").count() == 100 == labels.join(got, "group").count()


def test_views(spark, sf):
    session.register(spark, sf)
    assert spark.sql("select count(*) as n from lineitem join orders on l_orderkey = o_orderkey").first().n > 0
