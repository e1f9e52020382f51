"""Classification queries: documents and their quality labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens
from lakeloom.operators import classify as C
from lakeloom.session import table


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality is not null").select(F.col("doc_id").alias("doc"), F.col("quality").alias("label"))


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return C.token_rows(table(spark, d, "documents"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").join(_labels(spark, d), "doc")
    test = F.crc32(F.col("doc").cast("string").cast("binary")) % 4 == 2
    return own.where(~test), own.where(test)


def text_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(tokens("text")).alias("position", "token"))


def text_tf(spark, d):
    return _tf(spark, d)


def text_idf(spark, d):
    return C.idf(_tf(spark, d), table(spark, d, "documents").count()).select("token", "df", F.round("idf", 8).alias("idf"))


def text_tfidf(spark, d):
    rows = C.tfidf(_tf(spark, d), table(spark, d, "documents").count())
    return rows.select("doc", "token", F.round("tfidf", 8).alias("tfidf"))


def text_hashed(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, d, "documents").where("text is not null")
    done = Pipeline(stages=C.text_features("text")).fit(docs).transform(docs)
    return done.select("doc_id", F.posexplode(vector_to_array("features")).alias("feature", "value")).where("value <> 0")


def label_index(spark, d):
    return C.label_index(table(spark, d, "documents"), "lang").select("label", F.col("index").cast("int").alias("index"))


def tree_best_split(spark, d):
    found = C.best_split(_tf(spark, d), _labels(spark, d)).select("token", "n", F.round("gini", 10).alias("gini"))
    return found.orderBy("gini", "token").limit(20)


def _rule(spark, d) -> DataFrame:
    """Predictions of the best single split: doc, label, prediction."""
    tf, labels = _tf(spark, d), _labels(spark, d)
    best = C.best_split(tf, labels).withColumn("gini", F.round("gini", 10)).orderBy("gini", "token").limit(1).select("token", (F.col("pos") * 2 > F.col("n")).cast("int").alias("inside"))
    have = tf.join(F.broadcast(best), "token").select("doc", "inside")  # one row
    docs = labels.join(tf.select("doc").distinct(), "doc", "left_semi").join(have, "doc", "left")
    other = best.select((1 - F.col("inside")).alias("outside"))
    return docs.crossJoin(F.broadcast(other)).select("doc", "label", F.coalesce("inside", "outside").alias("prediction"))


def eval_confusion(spark, d):
    return C.confusion(_rule(spark, d), [0, 1])


def eval_confusion_totals(spark, d):
    return C.confusion_totals(_rule(spark, d))


def eval_metrics(spark, d):
    m = C.metrics(_rule(spark, d))
    return m.select("label", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def tree_fit(spark, d):
    train, test = _labelled(spark, d)
    return C.metrics(C.fit_tree(train).transform(test), prediction="prediction")


def forest_fit(spark, d):
    train, test = _labelled(spark, d)
    return C.metrics(C.fit_forest(train).transform(test), prediction="prediction")


def forest_importance(spark, d):
    train, _ = _labelled(spark, d)
    return C.importance(C.fit_forest(train, n=10), spark)


def tree_grid(spark, d):
    train, _ = _labelled(spark, d)
    depths = [2, 4]
    scores = C.grid_search(train, depths).avgMetrics
    return spark.createDataFrame([(k, float(s)) for k, s in zip(depths, scores)], "depth int, f1 double")


_TF = r"""docs as (select doc_id as doc, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) as plain from documents),
words as (select doc, unnest(string_split(plain, ' ')) as token from docs where plain <> ''),
tf as materialized (select doc, token, count(*) as tf from words group by 1, 2)"""
_SPLIT = _TF + """, lab as (select doc_id as doc, quality as label from labels where quality is not null),
known as (select l.doc, l.label from lab l where l.doc in (select doc from tf)),
al as (select count(*) as na, sum(label) as pa from known),
c as (select token, count(*) as n, sum(label) as pos from tf join lab l on tf.doc = l.doc group by 1),
g as (select token, n, pos, (n * (2 * (pos / n) * (1 - pos / n)) + (na - n) * (2 * ((pa - pos) / (na - n)) * (1 - (pa - pos) / (na - n)))) / na as gini from c cross join al where n < na),
best as (select token, n, pos, round(gini, 10) as gini from g order by round(gini, 10), token limit 20)"""
_RULE = _SPLIT + """, one as (select token, cast(pos * 2 > n as integer) as inside from best order by gini, token limit 1),
pred as materialized (select k.doc, k.label, case when t.doc is not null then o.inside else 1 - o.inside end as prediction from known k cross join one o left join tf t on t.doc = k.doc and t.token = o.token)"""

QUERIES = {f.__name__: f for f in (text_tokens, text_tf, text_idf, text_tfidf, text_hashed, label_index, tree_best_split, eval_confusion, eval_confusion_totals, eval_metrics, tree_fit, forest_fit, forest_importance, tree_grid)}
ORACLES = {
    "text_tokens": f"with {_TF} select doc as doc_id, unnest(range(0, len(string_split(plain, ' '))))::integer as position, unnest(string_split(plain, ' ')) as token from docs where plain <> ''",
    "text_tf": f"with {_TF} select doc, token, tf from tf",
    "text_idf": f"with {_TF} select token, count(*) as df, round(ln(((select count(*) from documents) + 1.0::double) / (count(*) + 1.0::double)), 8) as idf from tf group by 1",
    "text_tfidf": f"""with {_TF}, i as (select token, ln(((select count(*) from documents) + 1.0::double) / (count(*) + 1.0::double)) as idf from tf group by 1)
select doc, tf.token, round(tf * idf, 8) as tfidf from tf join i on tf.token = i.token""",
    "label_index": "select lang as label, cast(row_number() over (order by lang) - 1 as integer) as index from (select distinct lang from documents where lang is not null)",
    "tree_best_split": f"with {_SPLIT} select token, n, gini from best",
    "eval_confusion": f"with {_RULE} select label, count(*) filter (where prediction = 0) as predicted_0, count(*) filter (where prediction = 1) as predicted_1 from pred group by 1",
    "eval_confusion_totals": f"with {_RULE} select label, prediction, count(*) as n from pred group by cube (label, prediction)",
    "eval_metrics": f"""with {_RULE}, l as (select label from pred union select prediction from pred),
s as (select l.label, (select count(*) from pred p where p.label = l.label) as support, (select count(*) from pred p where p.prediction = l.label) as predicted, (select count(*) from pred p where p.prediction = l.label and p.label = l.label) as hits from l)
select label, support, round(case when predicted > 0 then hits / predicted end, 8) as precision, round(case when support > 0 then hits / support end, 8) as recall,
       round(case when predicted + support > 0 then 2 * hits / (predicted + support) end, 8) as f1, round((select avg(cast(label = prediction as integer)) from pred), 8) as accuracy from s""",
}
