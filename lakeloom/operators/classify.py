"""Text classification: features, decision trees, random forests, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover, StringIndexer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens


def token_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, token, tf: the term frequencies of each document."""
    return df.select(F.col(id_col).alias("doc"), F.explode(tokens(text_col)).alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))


def idf(tf: DataFrame, n_docs: int) -> DataFrame:
    """token, df, idf = ln((N + 1) / (df + 1))."""
    return tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)))


def tfidf(tf: DataFrame, n_docs: int) -> DataFrame:
    """doc, token, tfidf. The vocabulary grows with the corpus, so the join is by shuffle."""
    return tf.join(idf(tf, n_docs), "token").select("doc", "token", (F.col("tf") * F.col("idf")).alias("tfidf"))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """label, index: labels in alphabetical order from 0."""
    found = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    model = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc").fit(found)
    return model.transform(found)


def best_split(tf: DataFrame, labels: DataFrame) -> DataFrame:
    """token, n, gini: tokens by the weighted Gini impurity of present / absent, best first.

    labels: doc, label (0 or 1). Counts per token are sums over the rows with
    the token; those without it follow from the totals.
    """
    own = tf.join(labels, "doc")
    total = labels.join(tf.select("doc").distinct(), "doc", "left_semi").agg(F.count(F.lit(1)).alias("n_all"), F.sum("label").alias("pos_all"))
    counts = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).crossJoin(F.broadcast(total))  # one row

    def gini(n, pos):
        p = pos / n
        return F.when(n > 0, 2 * p * (1 - p)).otherwise(0.0)

    rest, rest_pos = F.col("n_all") - F.col("n"), F.col("pos_all") - F.col("pos")
    weighted = (F.col("n") * gini(F.col("n"), F.col("pos")) + rest * gini(rest, rest_pos)) / F.col("n_all")
    return counts.where(F.col("n") < F.col("n_all")).select("token", "n", F.col("pos"), weighted.alias("gini"))


def text_features(text_col: str, size: int = 4096) -> list:
    """Stages from text to hashed TF-IDF features."""
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        StopWordsRemover(inputCol="_words", outputCol="_terms"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def _fit(df: DataFrame, text_col: str, label_col: str, size: int, tree) -> PipelineModel:
    index = StringIndexer(inputCol=label_col, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[*text_features(text_col, size), index, tree]).fit(df.where(F.col(text_col).isNotNull()))


def fit_tree(df: DataFrame, depth: int = 5, text_col: str = "text", label_col: str = "label", size: int = 4096, seed: int = 42) -> PipelineModel:
    return _fit(df, text_col, label_col, size, DecisionTreeClassifier(labelCol="label_index", maxDepth=depth, seed=seed))


def fit_forest(df: DataFrame, n: int = 20, depth: int = 5, text_col: str = "text", label_col: str = "label", size: int = 4096, seed: int = 42) -> PipelineModel:
    return _fit(df, text_col, label_col, size, RandomForestClassifier(labelCol="label_index", numTrees=n, maxDepth=depth, seed=seed))


def grid_search(df: DataFrame, depths: list[int], folds: int = 3, text_col: str = "text", label_col: str = "label", size: int = 1024, seed: int = 42) -> CrossValidatorModel:
    """The tree depth with the best mean F1 over the folds."""
    tree = DecisionTreeClassifier(labelCol="label_index", seed=seed)
    index = StringIndexer(inputCol=label_col, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    ready = Pipeline(stages=[*text_features(text_col, size), index]).fit(df).transform(df).select("features", "label_index")
    grid = ParamGridBuilder().addGrid(tree.maxDepth, depths).build()
    judge = MulticlassClassificationEvaluator(labelCol="label_index", metricName="f1")
    return CrossValidator(estimator=tree, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=2).fit(ready)


def importance(model: PipelineModel, spark, top: int = 20) -> DataFrame:
    """feature, importance of a fitted tree or forest, largest first."""
    values = model.stages[-1].featureImportances
    rows = sorted(zip(values.indices.tolist(), values.values.tolist()), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(int(i), float(v)) for i, v in rows], "feature int, importance double")


def confusion(pred: DataFrame, labels: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label and a column predicted_<l> for each of ``labels``."""
    counts = pred.groupBy(F.col(label).alias("label")).pivot(prediction, labels).count()
    return counts.select("label", *[F.coalesce(F.col(str(x)), F.lit(0)).alias(f"predicted_{x}") for x in labels])


def confusion_totals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, prediction, n with totals as nulls (cube)."""
    return pred.cube(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, support, precision, recall, f1, and the accuracy over all on each row; nulls where undefined."""
    rows = pred.select(
        F.explode(F.array(F.struct(F.col(label).alias("l"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(prediction).alias("l"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"),
        (F.col(label) == F.col(prediction)).cast("int").alias("hit"),
    )
    per = rows.groupBy(F.col("x.l").alias("label")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.t")).alias("hits"))
    every = pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))
    precision = F.try_divide(F.col("hits").cast("double"), F.col("predicted").cast("double"))
    recall = F.try_divide(F.col("hits").cast("double"), F.col("support").cast("double"))
    f1 = F.try_divide(2.0 * F.col("hits"), (F.col("predicted") + F.col("support")).cast("double"))
    return per.crossJoin(F.broadcast(every)).select("label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "accuracy")  # one row
