"""Counts of a stream by key and window of time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import shared_dir, table


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """key, start, n of a streaming (or plain) DataFrame; rows over ``late`` behind the newest time are left out of a stream, and a window's state is dropped then. Rows with a null time are left out."""
    rows = stream.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.col(key).alias("key"), F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), "n")


def count_windows(spark: SparkSession, folder: str, name: str, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """All there is of the table ``name`` in ``folder``, run through a stream until it is used up.

    The state and the results are in the shared folder, so a run that stops
    goes on where it was. Results are complete counts by window, the last of
    each window counting.
    """
    own = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, folder, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is tried again writes the same folder
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{own}/out/number={number}")

    query = windowed_counts(stream, ts, key, width, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None or not any(p.batchId >= 0 and p.numInputRows for p in query.recentProgress):
        return windowed_counts(table(spark, folder, name).limit(0), ts, key, width, late)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{own}/out")
    return rows.groupBy("key", "start").agg(F.max_by("n", "batch").alias("n"))
