"""A corpus of text files, one document each: split/group/doc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """split, group, doc, raw from ``path``/*-{train,test}/{group}/{doc}.

    Whole files, one row each. Small files are packed into partitions: Spark
    counts 4 MB for opening each by default, which would give a task to every
    few dozen files. The files are read in a session of their own, with the
    settings of ``spark`` but for that cost, so that it holds when the query
    runs and no other reader sees it. A filter on split or group is pushed to
    the file list through the path.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.openCostInBytes", "4096")
    files = own.read.text(f"{path}/*/*/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    at = r"([^/]+)/([^/]+)/([^/]+)$"
    split = F.regexp_extract(F.regexp_extract("path", at, 1), "(train|test)$", 1)
    return files.select(split.alias("split"), F.regexp_extract("path", at, 2).alias("group"), F.regexp_extract("path", at, 3).alias("doc"), F.col("value").alias("raw"))


def parse_message(df: DataFrame, strip_quotes: bool = False, strip_signature: bool = False, raw: str = "raw") -> DataFrame:
    """Adds headers (array of name, value) and body.

    Headers are the lines before the first blank one. A line that starts with
    white space continues the header before it; one with no header before it
    becomes an entry without a name. Names repeat, so this is no map.
    """
    text = F.regexp_replace(raw, "\r\n?", "\n")
    at = F.locate("\n\n", text)
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(F.rtrim(text))
    body = F.when(at > 0, F.substr(text, at + 2)).otherwise(F.lit(""))
    unfolded = F.regexp_replace(head, r"\n[ \t]+", " ")
    named = r"^([^\s:][^:]*):\s*(.*)$"
    entries = F.transform(
        F.filter(F.split(unfolded, "\n"), lambda x: F.trim(x) != ""),
        lambda x: F.struct(
            F.when(x.rlike(named), F.regexp_extract(x, named, 1)).alias("name"),
            F.trim(F.when(x.rlike(named), F.regexp_extract(x, named, 2)).otherwise(x)).alias("value"),
        ),
    )
    if strip_signature:
        body = F.regexp_replace(body, r"(?s)(^|\n)-- ?\n.*$", "")
    if strip_quotes:
        body = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.ltrim(x).startswith(">")), "\n")
    return df.withColumns({"headers": entries, "body": body})


def header(name: str):
    """The first value of a header, whatever the case of its name; null if absent."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def leakage(df: DataFrame) -> DataFrame:
    """Bodies that occur in both splits: code, train, test (documents of each)."""
    rows = df.groupBy(F.sha1(F.col("body").cast("binary")).alias("code")).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    return rows.where("train > 0 and test > 0")
