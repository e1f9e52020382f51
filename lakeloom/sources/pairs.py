"""Pairs of ids as text part files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pairs(df: DataFrame, path: str, src: str = "src", dst: str = "dst", parts: int = 4, text: bool = False) -> None:
    """Write pairs, dealt by the first id into ``parts`` files: Parquet, or lines like ``('1', '2')``."""
    dealt = df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).repartition(parts, "src")
    if text:
        dealt.select(F.format_string("('%s', '%s')", "src", "dst").alias("value")).write.mode("overwrite").text(path)
    else:
        dealt.write.mode("overwrite").parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of printed pairs such as ``('1', '2')`` or ``(u'1', u'2')``; other lines are left out."""
    pattern = r"^\(u?'([^']*)', u?'([^']*)'\)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("src"), F.regexp_extract("value", pattern, 2).alias("dst"))
