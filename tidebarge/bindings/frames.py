"""Frames the queries share, each with the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables


def epoch(col) -> Column:
    return F.unix_timestamp(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def ts_text(col) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_epoch(x: str) -> str:
    return f"(epoch_us({x}) // 1000000)"


def sql_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def versions(t: Tables) -> DataFrame:
    """Repeated versions of a key: line items by order and line number, stamped by ship date."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), "l_partkey",
        epoch("l_shipdate").alias("pull_time"),
    )


VERSIONS = f"""v as (select l_orderkey k1, l_linenumber k2, l_partkey, {sql_epoch('l_shipdate')} pull_time
from lineitem)"""


def table_logs(t: Tables) -> DataFrame:
    """Folded table run logs: job = user, table = event id mod 3, views never stop, errors fail."""
    start = epoch("ts")
    stopped = F.col("event_type") != "view"
    return (
        t.events.select(
            F.col("user_id").alias("job_id"),
            (F.col("event_id") % 3).alias("table_id"),
            start.alias("start_time"),
            F.when(stopped, start + F.col("event_id") * 37 % 8000).alias("stop_time"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.col("props")))
            .when(stopped, F.lit(""))
            .alias("error_info"),
            F.when(stopped, F.col("event_id") * 7 % 1000).alias("record_count"),
        )
        .groupBy("job_id", "table_id", "start_time")
        .agg(
            F.max("stop_time").alias("stop_time"), F.max("error_info").alias("error_info"),
            F.max("record_count").alias("record_count"),
        )
        .withColumn(
            "status",
            F.when(F.col("stop_time").isNull(), "running").when(F.col("error_info") != "", "failed").otherwise("completed"),
        )
        .withColumn("error_info", F.coalesce("error_info", F.lit("")))
    )


TABLE_LOGS = f"""logs as (select job_id, table_id, start_time, stop_time, coalesce(error_info,'') error_info, record_count,
case when stop_time is null then 'running' when error_info <> '' then 'failed' else 'completed' end status
from (select user_id job_id, event_id % 3 table_id, {sql_epoch('ts')} start_time,
max(case when event_type <> 'view' then {sql_epoch('ts')} + event_id * 37 % 8000 end) stop_time,
max(case when event_type = 'error' then 'failed ' || props when event_type <> 'view' then '' end) error_info,
max(case when event_type <> 'view' then event_id * 7 % 1000 end) record_count
from events group by 1, 2, 3) q)"""


def system_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("log_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("log_date"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("log_time"),
        F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("log_locate"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").otherwise("info")
        .alias("log_type"),
        F.col("props").alias("log_info"),
    )


SYSTEM_LOG = """sys_log as (select event_id log_id, strftime(ts, '%Y-%m-%d') log_date,
strftime(ts, '%Y-%m-%d %H:%M:%S') log_time, 'host' || (user_id % 5) log_locate,
case event_type when 'error' then 'error' when 'view' then 'debug' else 'info' end log_type, props log_info from events)"""


def statements(t: Tables) -> DataFrame:
    """SQL statements stand-in: whole document and conversation texts."""
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("statement_id"), "text")
    talk = t.conversations.select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("statement_id"),
        "text",
    )
    return docs.unionByName(talk)


STATEMENTS = """st as (select 'd' || doc_id statement_id, text from documents
union all select 'c-' || conv_id || '-' || turn, text from conversations)"""


# windows of six hours that open at a request, two requests each
BURSTS = """with recursive w(user_id, s) as (select user_id, min(ts) from events group by 1
  union all select w.user_id, min(e.ts) from w join events e on e.user_id = w.user_id and e.ts >= w.s + interval 6 hours
  group by w.user_id),
c as (select w.user_id, w.s, count(*) n from w join events e
  on e.user_id = w.user_id and e.ts >= w.s and e.ts < w.s + interval 6 hours group by 1, 2)
select cast(user_id as varchar) client, cast(sum(n) as bigint) requests, cast(sum(greatest(n - 2, 0)) as bigint) refused,
  count(*) windows from c group by 1"""
