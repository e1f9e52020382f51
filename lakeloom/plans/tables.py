"""SQL over the tables, JSON, messages and streams.

The ``sql_`` queries are text for ``spark.sql`` over temporary views, and the
same text is their SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import register, table
from lakeloom.sources.corpus import header, parse_message
from lakeloom.streaming.series import count_windows

SQL = {
    "sql_rollup": """
select r_name, n_name, count(*) as customers, cast(round(sum(c_acctbal), 2) as decimal(18, 2)) as balance
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by grouping sets ((r_name, n_name), (r_name), ())""",
    "sql_running_total": """
select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row), 2) as total,
       round(max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following), 2) as most
from orders""",
    "sql_intersect": """
select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_quantity >= 45
except select p_partkey from part where p_size > 40""",
    "sql_ctes": """
with spent as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey),
ranked as (select n_name, c_custkey, total, row_number() over (partition by n_name order by total desc, c_custkey) as place from spent join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select n_name, c_custkey, round(total, 2) as total, cast(place as integer) as place from ranked where place <= 3""",
}


def _sql(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d)
        return spark.sql(text)

    return run


def events_props(spark, d):
    """JSON properties as columns, and as a map."""
    kinds = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", kinds["k"].alias("k"), F.element_at(F.from_json("props", "map<string,string>"), "k").alias("k_text"))


def events_users(spark, d):
    """Distinct users by type, estimated by HyperLogLog at 5 %."""
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.05).alias("users"))


def corpus_parse(spark, d):
    """Messages of header and body, made of conversation turns, taken apart again."""
    turns = table(spark, d, "conversations").where("role is not null and text is not null")
    raw = F.concat(F.lit("From: "), "role", F.lit("\r\nSubject: turn "), "turn", F.lit("\n  of "), "conv_id", F.lit("\n\n"), "text")
    done = parse_message(turns.select("conv_id", "turn", raw.alias("raw")))
    return done.select("conv_id", "turn", F.size("headers").alias("n"), header("from").alias("sender"), header("Subject").alias("subject"), "body")


def stream_hourly(spark, d):
    """Events by type and hour, counted in a stream with a watermark."""
    return count_windows(spark, d, "events", "ts", "event_type").select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {**{name: _sql(text) for name, text in SQL.items()}, **{f.__name__: f for f in (events_props, events_users, corpus_parse, stream_hourly)}}
ORACLES = {
    **SQL,
    "events_props": "select event_id, cast(props ->> '$.k' as integer) as k, props ->> '$.k' as k_text from events",
    "corpus_parse": """select conv_id, turn, cast(2 as integer) as n, role as sender, 'turn ' || turn || ' of ' || conv_id as subject,
replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as body from conversations where role is not null and text is not null""",
    "stream_hourly": "select event_type as key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events where ts is not null group by all",
}
