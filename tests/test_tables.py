import datetime

from pyspark.sql import functions as F

from lakeloom.plans import tables as T
from lakeloom.session import table
from lakeloom.streaming.series import count_windows, windowed_counts


def test_estimated_users(spark, sf):
    got = {r.event_type: r.users for r in T.events_users(spark, sf).collect()}
    want = {r.event_type: r.n for r in table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - n) <= 0.15 * n for k, n in want.items())


def test_windowed_counts(spark):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [("a", at(0, 5)), ("a", at(0, 59)), ("a", at(1, 0)), ("b", at(0, 5)), (None, at(0, 5)), ("a", None)]
    got = windowed_counts(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", "k").collect()
    assert {(r.key, r.start.hour, r.n) for r in got} == {("a", 0, 2), ("a", 1, 1), ("b", 0, 1), (None, 0, 1)}


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "k string, ts timestamp").write.parquet(f"{tmp_path}/none.parquet")
    assert count_windows(spark, str(tmp_path), "none", "ts", "k").count() == 0
