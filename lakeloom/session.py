"""Session helpers shared by every operator."""

from __future__ import annotations

import itertools
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lakeloom", cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LAKELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables of a data directory.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str) -> None:
    """The tables of a data directory as temporary views, for ``spark.sql``."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it is not installed there."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lakeloom"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset in a local session (tests, notebooks) a temporary folder takes its
    place; on a cluster, executors would each write to a disk of their own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Cuts between two collections of the driver's garbage.
TIDY = 8
_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    The copy outlives any executor, unlike a local checkpoint. Spark removes
    the shuffle files and checkpoints of what came before once the driver's
    garbage is collected, which a driver of little memory use may not do for
    half an hour: so it is asked to now and then.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    if next(_cuts) % TIDY == 0:
        spark._jvm.System.gc()
    return done


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of this session has; clusters size it to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
