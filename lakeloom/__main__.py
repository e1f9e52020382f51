"""Batch runs and a shell.

    spark-submit --py-files lakeloom.zip run.py run QUERY DATA OUT
    python -m lakeloom run QUERY DATA OUT     a registered query, written as Parquet
    python -m lakeloom sql TEXT DATA OUT      SQL over the tables, written as Parquet
    python -m lakeloom list                   the registered queries
    python -m lakeloom shell DATA             Python with ``spark`` and the tables as views
"""

from __future__ import annotations

import argparse
import code

from pyspark.sql import SparkSession

from lakeloom import catalog
from lakeloom.session import register, ship


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lakeloom")
    sub = p.add_subparsers(dest="what", required=True)
    for name, first in (("run", "query"), ("sql", "text")):
        own = sub.add_parser(name)
        own.add_argument(first)
        own.add_argument("data")
        own.add_argument("out")
    sub.add_parser("list")
    sub.add_parser("shell").add_argument("data")
    a = p.parse_args(args)
    if a.what == "list":
        print("\n".join(catalog.QUERIES))
        return
    if a.what == "run" and a.query not in catalog.QUERIES:
        p.error(f"no query {a.query}")
    spark = SparkSession.builder.appName("lakeloom").getOrCreate()
    ship(spark)
    if a.what == "run":
        catalog.QUERIES[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)
        return
    register(spark, a.data)
    if a.what == "sql":
        spark.sql(a.text).write.mode("overwrite").parquet(a.out)
    else:
        code.interact(banner="spark; spark.sql(...)", local={"spark": spark, "queries": catalog.QUERIES})


if __name__ == "__main__":
    main()
