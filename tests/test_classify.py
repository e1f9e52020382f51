import math

import pytest

from lakeloom.operators import classify as C
from lakeloom.sources.corpus import header, leakage, parse_message, read_corpus

ROWS = [(i, f"good fine {'great' if i % 3 else 'nice'} w{i % 5}", 1) for i in range(0, 40)] + [(100 + i, f"bad poor {'awful' if i % 3 else 'nice'} w{i % 5}", 0) for i in range(0, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc int, text string, label int")


def test_idf(docs):
    got = {r.token: (r.df, r.idf) for r in C.idf(C.token_rows(docs, "doc"), 80).collect()}
    assert got["good"] == (40, pytest.approx(math.log(81 / 41)))


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "l string")
    assert sorted((r.label, r["index"]) for r in C.label_index(df, "l").collect()) == [("a", 0.0), ("b", 1.0), ("c", 2.0)]


def test_best_split(docs):
    top = C.best_split(C.token_rows(docs, "doc"), docs.select("doc", "label")).orderBy("gini", "token").first()
    assert top.gini == 0 and top.token in ("bad", "fine", "good", "poor")


@pytest.mark.parametrize("fit", [lambda d: C.fit_tree(d, 3), lambda d: C.fit_forest(d, 5, 3)])
def test_trees_beat_the_majority(docs, fit):
    pred = fit(docs.where("doc % 4 <> 0")).transform(docs.where("doc % 4 = 0"))
    assert C.metrics(pred).first().accuracy > 0.9


def test_forest_importance_and_grid(spark, docs):
    model = C.fit_forest(docs, 5, 3)
    values = [r.importance for r in C.importance(model, spark).collect()]
    assert values == sorted(values, reverse=True) and sum(values) <= 1 + 1e-9
    assert len(C.grid_search(docs, [1, 2], folds=2, size=256).avgMetrics) == 2


def test_confusion_and_metrics(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, prediction int")
    got = {r.label: (r.predicted_0, r.predicted_1) for r in C.confusion(pred, [0, 1]).collect()}
    assert got == {0: (1, 1), 1: (0, 2), 2: (0, 1)}
    m = {r.label: r for r in C.metrics(pred).collect()}
    assert m[1].precision == 0.5 and m[1].recall == 1 and m[0].f1 == pytest.approx(2 / 3) and m[2].precision is None and m[0].accuracy == pytest.approx(0.6)
    assert C.confusion_totals(pred).where("label is null and prediction is null").first().n == 5


MESSAGE = "From: a@b.c (A)\nSubject: Re: folded\n line\nLines: 3\nlines: dog\n\nHello\n> quoted\nBye\n--\nsignature\n"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    files = {("x-train", "g1", "1"): MESSAGE, ("x-train", "g2", "1"): " orphan\nSubject: s\n\nsame body", ("x-test", "g1", "7"): "Lines: 1\r\n\r\nsame body", ("x-test", "g1", "8"): "Only: headers\n", ("x-test", "g2", "9"): " "}
    for (a, b, c), text in files.items():
        (top / a / b).mkdir(parents=True, exist_ok=True)
        (top / a / b / c).write_bytes(text.encode())
    return parse_message(read_corpus(spark, str(top))).cache()


def test_corpus_keys(corpus):
    assert sorted((r.split, r.group, r.doc) for r in corpus.collect()) == [("test", "g1", "7"), ("test", "g1", "8"), ("test", "g2", "9"), ("train", "g1", "1"), ("train", "g2", "1")]


def test_headers(corpus):
    rows = {(r.split, r.group, r.doc): r for r in corpus.collect()}
    one = rows["train", "g1", "1"]
    assert [tuple(h) for h in one.headers] == [("From", "a@b.c (A)"), ("Subject", "Re: folded line"), ("Lines", "3"), ("lines", "dog")]
    assert one.body.startswith("Hello\n")
    assert rows["train", "g2", "1"].headers[0].name is None and rows["train", "g2", "1"].headers[1].value == "s"
    assert rows["test", "g1", "8"].body == "" and rows["test", "g2", "9"].headers == []
    got = {r.doc: r.n for r in corpus.selectExpr("*").withColumn("n", header("LINES").try_cast("int")).where("split = 'test'").collect()}
    assert got["7"] == 1 and got["8"] is None


def test_stripping_and_leakage(corpus):
    own = parse_message(corpus.drop("headers", "body"), strip_quotes=True, strip_signature=True).where("group = 'g1' and split = 'train'").first()
    assert own.body.strip() == "Hello\nBye"
    assert [(r.train, r.test) for r in leakage(corpus).collect()] == [(1, 1)]
