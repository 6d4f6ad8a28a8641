"""Predicates, joins, paging, run logs, retention and request logs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators import filters, numbering, ranked, relations, requests, retention, runlog, versions
from ..plans.specs import FilterCondition
from ..session import fresh_path
from ..sources.tables import run_select
from . import frames
from .frames import BURSTS, SYSTEM_LOG, TABLE_LOGS, sql_ts, system_log, table_logs, ts_text
from .registry import Tables, query

# --- predicates -----------------------------------------------------------------


@query(
    "filter_equals_all",
    "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH'",
)
def filter_equals_all(t: Tables) -> DataFrame:
    found = filters.equals_all(t.orders, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})
    return found.select("o_orderkey", "o_custkey")


@query(
    "filter_since",
    f"select event_id, {sql_ts('ts')} ts from events where ts > timestamp '2024-01-16 00:00:00' and event_id > 7",
)
def filter_since(t: Tables) -> DataFrame:
    state = [FilterCondition("ts", "datetime", "2024-01-16T00:00:00Z"), FilterCondition("event_id", "integer", "7")]
    return filters.since(t.events, state).select("event_id", ts_text("ts").alias("ts"))


@query(
    "typed_filter_values",
    f"""with c as (select event_id, 'ts' filter_column, 'datetime' data_type, {sql_ts('ts')} "value" from events
      union all select event_id, 'value', 'float', cast(value as varchar) from events
      union all select event_id, 'user_id', 'integer', cast(user_id as varchar) from events
      union all select event_id, 'event_type', event_type, event_type from events)
    select event_id, filter_column, data_type, '' string_value,
      coalesce(case data_type when 'integer' then cast("value" as bigint) end, -1) integer_value,
      coalesce(case data_type when 'float' then cast("value" as double) end, -1) float_value,
      case data_type when 'datetime' then "value" else '' end time_value from c""",
)
def typed_filter_values(t: Tables) -> DataFrame:
    """Every event's watermark JSON, decoded into typed values; an unknown type stays NULL."""
    entries = [
        ("ts", F.lit("datetime"), ts_text("ts")),
        ("value", F.lit("float"), F.col("value").cast("string")),
        ("user_id", F.lit("integer"), F.col("user_id").cast("string")),
        ("event_type", F.col("event_type"), F.col("event_type")),
    ]
    text = versions.encode_watermark([(F.lit(c), d, v) for c, d, v in entries])
    rows = versions.decode_watermarks(t.events.select("event_id", text.alias("filter_val"))).drop("reason")
    return filters.typed_values(rows, "data_type", "value").select(
        "event_id", "filter_column", "data_type",
        F.coalesce("string_value", F.lit("")).alias("string_value"),
        F.coalesce("integer_value", F.lit(-1)).alias("integer_value"),
        F.coalesce("float_value", F.lit(-1.0)).alias("float_value"),
        F.coalesce(ts_text("time_value"), F.lit("")).alias("time_value"),
    )


@query(
    "search_contains",
    "select p_partkey, p_name, p_brand from part where p_name like '%ring%' or p_brand like '%#1%'",
)
def search_contains(t: Tables) -> DataFrame:
    return filters.contains_any(t.part, {"p_name": "ring", "p_brand": "#1"}).select("p_partkey", "p_name", "p_brand")


@query(
    "filter_status",
    f"with {TABLE_LOGS} select job_id, table_id, start_time, error_info from logs where status = 'failed'",
)
def filter_status(t: Tables) -> DataFrame:
    return filters.with_status(table_logs(t), "failed").select("job_id", "table_id", "start_time", "error_info")


@query(
    "filter_id_list",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P') and l_linenumber in (1, 3, 5)
    and cast(l_orderkey as varchar) not in (select cast(3 * i as varchar) from range(0, 5000) r(i))
    union all select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    where cast(l_orderkey as varchar) in (select cast(3 * i as varchar) from range(0, 5000) r(i)) and l_linenumber = 2""",
)
def filter_id_list(t: Tables) -> DataFrame:
    """Short and long lists, of numbers and of text, and a frame of ids."""
    many = [str(3 * i) for i in range(5000)]
    coded = t.lineitem.withColumn("code", F.col("l_orderkey").cast("string"))
    listed = filters.in_id_list(coded, "code", many)
    lines = filters.in_id_list(coded.where(~F.col("code").isin(many)), "l_linenumber", [1, 3, 5])
    open_orders = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    found = filters.in_id_list(lines, "l_orderkey", open_orders).unionByName(filters.in_id_list(listed, "l_linenumber", [2]))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "filter_type_in_date_locate",
    f"""with {SYSTEM_LOG} select log_id, log_time, log_type, log_info from sys_log
    where log_date = '2024-01-10' and log_type in ('error', 'info') and log_locate = 'host3'""",
)
def filter_type_in_date_locate(t: Tables) -> DataFrame:
    found = filters.system_log(system_log(t), "2024-01-10", ["error", "info"], "host3")
    return found.select("log_id", "log_time", "log_type", "log_info")


@query("skip_hours", "select event_id, user_id from events where event_id % 7 = 0 or hour(ts) not in (1, 2, 3, 23)")
def skip_hours(t: Tables) -> DataFrame:
    """Every seventh trigger has no time."""
    timed = t.events.withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return filters.outside_skip_hours(timed, "ts", [1, 2, 3, 23]).select("event_id", "user_id")


# --- joins ------------------------------------------------------------------------


def _owners(t: Tables, logs: DataFrame, ids: list[str]) -> DataFrame:
    """Owners with their last run, and customers that never ran."""
    ran = logs.groupBy(*ids).agg(F.max("start_time").alias("last_run"))
    never = t.customer.select(
        (F.col("c_custkey") + 1_000_000).alias("job_id"),
        *([F.lit(0).cast("bigint").alias("table_id")] if "table_id" in ids else []),
        F.lit(0).cast("bigint").alias("last_run"),
    )
    return ran.unionByName(never)


TABLE_OWNERS = f"""{TABLE_LOGS}, owners as (select job_id, table_id, max(start_time) last_run from logs group by 1, 2
union all select c_custkey + 1000000, 0, 0 from customer),
seen as (select o.job_id, o.table_id, o.last_run, coalesce(l.status, '') run_status, coalesce(l.error_info, '') last_error
from owners o left join logs l on o.job_id = l.job_id and o.table_id = l.table_id and o.last_run = l.start_time)"""


@query("table_last_run", f"with {TABLE_OWNERS} select * from seen")
def table_last_run(t: Tables) -> DataFrame:
    logs = table_logs(t)
    return relations.last_run(_owners(t, logs, ["job_id", "table_id"]), logs, ["job_id", "table_id"])


def job_logs(t: Tables) -> DataFrame:
    """One log per job and start, folded from its tables' logs."""
    logs = table_logs(t)
    errors = logs.groupBy("job_id", "start_time").agg(F.max("error_info").alias("error_info"))
    status = runlog.job_status(logs, ["job_id", "start_time"]).select("job_id", "start_time", "status")
    return status.join(errors, ["job_id", "start_time"])


@query(
    "job_last_run",
    f"""with {TABLE_LOGS}, jl as (select job_id, start_time, case when bool_or(status = 'failed') then 'failed'
      when bool_or(status = 'running') then 'running' else 'completed' end status, max(error_info) error_info from logs group by 1, 2), owners as (select job_id, max(start_time) last_run from jl group by 1
    union all select c_custkey + 1000000, 0 from customer)
    select o.job_id, o.last_run, coalesce(l.status, '') run_status, coalesce(l.error_info, '') last_error
    from owners o left join jl l on o.job_id = l.job_id and o.last_run = l.start_time""",
)
def job_last_run(t: Tables) -> DataFrame:
    logs = job_logs(t)
    return relations.last_run(_owners(t, logs, ["job_id"]), logs, ["job_id"])


@query(
    "first_gap",
    """with ids as (select o_orderkey + 1 id from orders where o_orderstatus <> 'P'),
    lines as (select distinct l_orderkey g, l_linenumber id from lineitem)
    select cast(-1 as bigint) owner, cast(min(a) + 1 as bigint) first_gap from (select id a from ids union all select 0) x
      where not exists (select 1 from ids b where b.id = x.a + 1)
    union all select g, cast(min(a) + 1 as bigint) from (select g, id a from lines union all select distinct g, 0 from lines) y
      where not exists (select 1 from lines b where b.g = y.g and b.id = y.a + 1) group by g""",
)
def first_gap(t: Tables) -> DataFrame:
    """Over all orders (owner -1), and per order over its line numbers."""
    ids = t.orders.where("o_orderstatus <> 'P'").select((F.col("o_orderkey") + 1).alias("id"))
    overall = relations.first_gap(ids, "id").select(F.lit(-1).cast("bigint").alias("owner"), "first_gap")
    lines = t.lineitem.select(F.col("l_orderkey").alias("owner"), "l_linenumber")
    return overall.unionByName(relations.first_gap(lines, "l_linenumber", ["owner"]))


@query(
    "status_overlay",
    """with p as (select c_custkey plugin_uuid, case when c_acctbal < 0 then '' else c_name end plugin_file_name,
      case when c_mktsegment = 'BUILDING' then '' else 'host' || c_nationkey end host_uuid from customer),
    r as (select user_id plugin_uuid, event_type reported_status from events
      qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select p.*, coalesce(r.reported_status, case when plugin_file_name = '' then '待上传'
      when host_uuid = '' then '待部署' else '已失联' end) status from p left join r using (plugin_uuid)""",
)
def status_overlay(t: Tables) -> DataFrame:
    plugins = t.customer.select(
        F.col("c_custkey").alias("plugin_uuid"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("plugin_file_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "")
        .otherwise(F.concat(F.lit("host"), F.col("c_nationkey").cast("string")))
        .alias("host_uuid"),
    )
    latest = versions.latest_version(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", ["event_id"])
    reports = latest.select(F.col("user_id").alias("plugin_uuid"), F.col("event_type").alias("reported_status"))
    return relations.status_overlay(plugins, reports)


@query(
    "tag_loaded",
    """select c_custkey job_id, case when c_custkey in (select user_id from events) then 'loaded' else 'unloaded' end load_status
    from customer""",
)
def tag_loaded(t: Tables) -> DataFrame:
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"))
    return relations.tag_loaded(jobs, t.events.select(F.col("user_id").alias("job_id")), "job_id")


JOINS_SQL = """select r.r_name, n.n_name, o.o_orderpriority, count(*) line_count,
    cast(sum(cast(l.l_quantity as bigint)) as bigint) quantity
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
left join (select c_custkey, c_nationkey from {customer} where c_acctbal > 0) c on c.c_custkey = o.o_custkey, {nation} n, {region} r
where n.n_nationkey = coalesce(c.c_nationkey, 0) and r.r_regionkey = n.n_regionkey
group by r.r_name, n.n_name, o.o_orderpriority"""

NAMES = ("lineitem", "orders", "customer", "nation", "region")


@query("user_select_joins", JOINS_SQL.format(**{n: n for n in NAMES}))
def user_select_joins(t: Tables) -> DataFrame:
    views = {f"user_{n}": getattr(t, n) for n in NAMES}
    return run_select(t.spark, JOINS_SQL.format(**{n: f"user_{n}" for n in NAMES}), (), views)


AGGS_SQL = """select coalesce(l_returnflag, '*') returnflag, coalesce(l_linestatus, '*') linestatus, count(*) line_count,
    count(distinct l_suppkey) suppliers, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) cents
from {lineitem} where l_shipdate > ? group by rollup (l_returnflag, l_linestatus) having count(*) > 1"""


@query("user_select_aggs", AGGS_SQL.format(lineitem="lineitem").replace("?", "timestamp '1997-01-01 00:00:00'"))
def user_select_aggs(t: Tables) -> DataFrame:
    since = FilterCondition("l_shipdate", "date", "1997-01-01")
    return run_select(t.spark, AGGS_SQL.format(lineitem="user_lineitem"), [since], {"user_lineitem": t.lineitem})


# --- distinct lists -----------------------------------------------------------------


@query("distinct_log_dates", f"with {SYSTEM_LOG} select distinct log_date from sys_log")
def distinct_log_dates(t: Tables) -> DataFrame:
    return system_log(t).select("log_date").distinct().orderBy(F.col("log_date").desc())


@query("distinct_log_locates", f"with {SYSTEM_LOG} select distinct log_locate from sys_log")
def distinct_log_locates(t: Tables) -> DataFrame:
    return system_log(t).select("log_locate").distinct().orderBy("log_locate")


@query("distinct_drivers", "select distinct string_split(url, ':')[1] driver from pages")
def distinct_drivers(t: Tables) -> DataFrame:
    """Schemes of the known urls, standing for the drivers of known data sources."""
    return t.pages.select(F.substring_index("url", ":", 1).alias("driver")).distinct()


# --- paging --------------------------------------------------------------------------


@query(
    "page_desc",
    f"""with {SYSTEM_LOG} select log_id, log_time, log_type, (select count(*) from sys_log) total from sys_log
    order by log_id desc limit 50 offset (select (count(*) // 100) * 50 from sys_log)""",
)
def page_desc(t: Tables) -> DataFrame:
    """The page in the middle of the system log, sought in its ranked table."""
    logs = system_log(t).select("log_id", "log_time", "log_type")
    ranked_logs = ranked.write_ranked(logs, [F.col("log_id").desc()], fresh_path(t.spark, "ranked"))
    return ranked_logs.page(ranked_logs.total // 100 + 1, 50).drop("position")


@query(
    "page_asc",
    """with f as (select * from customer where c_mktsegment like '%BUILD%')
    select c_custkey, c_name, c_nationkey, (select count(*) from f) total from f
    order by c_custkey limit 10 offset (select (count(*) // 20) * 10 from f)""",
)
def page_asc(t: Tables) -> DataFrame:
    """The page in the middle of the customers found, with how many there are."""
    found = filters.contains_any(t.customer, {"c_mktsegment": "BUILD"}).select("c_custkey", "c_name", "c_nationkey")
    customers = ranked.write_ranked(found, [F.col("c_custkey")], fresh_path(t.spark, "ranked"))
    return customers.page(customers.total // 20 + 1, 10).drop("position")


@query(
    "page_numbers",
    """select event_id, position, (position - 1) // 50 + 1 page from
    (select event_id, row_number() over (order by ts desc, event_id desc) position from events) q""",
)
def page_numbers(t: Tables) -> DataFrame:
    ids = t.events.select("event_id", "ts")
    return numbering.page_numbers(ids, [F.col("ts").desc(), F.col("event_id").desc()], 50).drop("ts")


@query(
    "group_sequence",
    f"""with {SYSTEM_LOG} select log_id, log_date, row_number() over (partition by log_date order by log_time, log_id) seq
    from sys_log""",
)
def group_sequence(t: Tables) -> DataFrame:
    """The first half of the month is numbered already; the rest goes on per date where needed."""
    logs = system_log(t).select("log_id", "log_date", "log_time")
    old = logs.where("log_time < '2024-01-15 12:00:00'")
    new = logs.where("log_time >= '2024-01-15 12:00:00'")
    order = [F.col("log_time"), F.col("log_id")]
    numbered = numbering.group_sequence(old, None, "log_date", order, "seq")
    return numbered.unionByName(numbering.group_sequence(new, numbered, "log_date", order, "seq")).drop("log_time")


@query(
    "union_with_sentinel",
    "select o_orderkey from orders where o_orderstatus = 'P' union all select 0",
)
def union_with_sentinel(t: Tables) -> DataFrame:
    return relations.with_sentinel(t.orders.where("o_orderstatus = 'P'"), "o_orderkey")


# --- run logs --------------------------------------------------------------------------


def run_events(t: Tables) -> DataFrame:
    """Start events of all runs, stop events of those that stopped."""
    start = frames.epoch("ts")
    ids = [F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("table_id"), start.alias("start_time")]
    none = F.lit(None)
    starts = t.events.select(
        *ids, none.cast("bigint").alias("stop_time"), none.cast("string").alias("error_info"),
        none.cast("bigint").alias("record_count"),
    )
    stops = t.events.where("event_type <> 'view'").select(
        *ids,
        (start + F.col("event_id") * 37 % 8000).alias("stop_time"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.col("props"))).otherwise("").alias("error_info"),
        (F.col("event_id") * 7 % 1000).alias("record_count"),
    )
    return starts.unionByName(stops)


@query(
    "fold_run_events",
    f"""with {TABLE_LOGS} select job_id, table_id, start_time, coalesce(stop_time, -1) stop_time, error_info,
    coalesce(record_count, -1) record_count, status from logs""",
)
def fold_run_events(t: Tables) -> DataFrame:
    folded = runlog.fold_run_events(run_events(t), ["job_id", "table_id"])
    return folded.fillna(-1, ["stop_time", "record_count"]).fillna("", ["error_info"])


SPENT_SQL = """coalesce(case when d >= 3600 then (d // 3600) || '时' end, '') ||
coalesce(case when d % 3600 >= 60 then (d % 3600 // 60) || '分' end, '') ||
coalesce(case when d % 60 > 0 or d = 0 then (d % 60) || '秒' end, '')"""


@query("time_spent", f"select event_id, {SPENT_SQL} time_spent from (select event_id, event_id * 37 % 8000 d from events) q")
def time_spent(t: Tables) -> DataFrame:
    start = frames.epoch("ts")
    return t.events.select("event_id", times.time_spent(start + F.col("event_id") * 37 % 8000, start).alias("time_spent"))


@query(
    "run_info",
    f"""with {TABLE_OWNERS}, s as (select *, '[' || strftime(make_timestamp(last_run * 1000000), '%Y-%m-%d %H:%M:%S') || ']'
      || run_status stamp from seen)
    select job_id, table_id, case when last_run <= 0 then '' when last_error <> '' then stamp || ':' || last_error
      when run_status <> '' then stamp else '' end run_info from s""",
)
def run_info(t: Tables) -> DataFrame:
    return runlog.run_info(table_last_run(t)).select("job_id", "table_id", "run_info")


@query(
    "log_page",
    f"""with {TABLE_LOGS}, l as (select *, abs(stop_time - start_time) d from logs where job_id = 7 and status = 'completed'
      order by start_time desc, table_id desc limit 5 offset 5)
    select job_id, table_id, start_time, stop_time, {SPENT_SQL} time_spent,
      (select count(*) from logs where job_id = 7 and status = 'completed') total from l""",
)
def log_page(t: Tables) -> DataFrame:
    mine = filters.with_status(table_logs(t).where("job_id = 7"), "completed").select("job_id", "table_id", "start_time", "stop_time")
    order = [F.col("start_time").desc(), F.col("table_id").desc()]
    page = ranked.write_ranked(mine, order, fresh_path(t.spark, "ranked")).page(2, 5, strict=False)
    return runlog.with_time_spent(page).select("job_id", "table_id", "start_time", "stop_time", "time_spent", "total")


STUCK_AT = 1706745600


@query(
    "stuck_runs",
    f"""with {TABLE_LOGS} select job_id, table_id, start_time, {STUCK_AT} - start_time age from logs
    where status = 'running' and {STUCK_AT} - start_time > 86400""",
)
def stuck_runs(t: Tables) -> DataFrame:
    return runlog.stuck_runs(table_logs(t), STUCK_AT, 86400).select("job_id", "table_id", "start_time", "age")


@query(
    "failure_isolation",
    f"""with {TABLE_LOGS} select job_id, start_time // 86400 as "day", count(*) tables,
      count(*) filter (status = 'failed') failed_tables, case when count(*) filter (status = 'failed') > 0 then 'failed'
      when count(*) filter (status = 'running') > 0 then 'running' else 'completed' end status from logs group by 1, 2""",
)
def failure_isolation(t: Tables) -> DataFrame:
    """A job's outcome per day, from its tables' runs."""
    daily = table_logs(t).withColumn("day", F.expr("start_time div 86400"))
    return runlog.job_status(daily, ["job_id", "day"])


# --- retention ---------------------------------------------------------------------------


@query(
    "keep_latest_log",
    f"""with {TABLE_LOGS} select coalesce(nullif(job_id, 3), -1) job_id, table_id, start_time, status from logs
    qualify job_id = 3 or start_time = max(start_time) over (partition by job_id, table_id)""",
)
def keep_latest_log(t: Tables) -> DataFrame:
    """The logs of one job have lost their owner."""
    logs = table_logs(t).withColumn("job_id", F.nullif(F.col("job_id"), F.lit(3)))
    kept = retention.keep_latest(logs, ["job_id", "table_id"])
    return kept.select(F.coalesce("job_id", F.lit(-1)).alias("job_id"), "table_id", "start_time", "status")


@query(
    "delete_one_log",
    f"with {SYSTEM_LOG} select log_id, log_date, log_type from sys_log where not (log_date = '2024-01-01' and log_id = 5)",
)
def delete_one_log(t: Tables) -> DataFrame:
    return retention.delete_one(system_log(t), {"log_date": "2024-01-01", "log_id": 5}).select(
        "log_id", "log_date", "log_type"
    )


def dated_log(t: Tables) -> DataFrame:
    """The system log, in which the entries of one day have lost their date."""
    return system_log(t).withColumn("log_date", F.nullif(F.col("log_date"), F.lit("2024-01-12")))


def dated(df: DataFrame) -> DataFrame:
    return df.select("log_id", F.coalesce("log_date", F.lit("")).alias("log_date"))


_DATED = f"with {SYSTEM_LOG}, d as (select log_id, coalesce(nullif(log_date, '2024-01-12'), '') log_date from sys_log)"


@query("delete_before_date", f"{_DATED} select * from d where log_date >= '2024-01-20' or log_date = ''")
def delete_before_date(t: Tables) -> DataFrame:
    return dated(retention.delete_before_date(dated_log(t), "2024-01-20"))


@query("delete_on_date", f"{_DATED} select * from d where log_date <> '2024-01-20'")
def delete_on_date(t: Tables) -> DataFrame:
    return dated(retention.delete_on_date(dated_log(t), "2024-01-20"))


@query(
    "keep_n_dates",
    f"""{_DATED} select * from d where log_date = '' or log_date in
    (select distinct log_date from d where log_date <> '' order by 1 desc limit 7)""",
)
def keep_n_dates(t: Tables) -> DataFrame:
    return dated(retention.keep_n_dates(dated_log(t), 7))


@query(
    "clear_user_log",
    "select user_id, event_id log_id, event_type from events where user_id <> 7 and not (user_id = 8 and event_id = 0)",
)
def clear_user_log(t: Tables) -> DataFrame:
    logs = t.events.select("user_id", F.col("event_id").alias("log_id"), "event_type")
    return retention.clear_user_log(retention.clear_user_log(logs, 7), 8, 0)


@query(
    "cascade_delete",
    f"""with {TABLE_LOGS}, doomed as (select distinct user_id job_id from events where event_type = 'error' and ts >= timestamp '2024-01-29'),
    kept as (select * from logs where job_id not in (select job_id from doomed))
    select 'jobs' kind, job_id, cast(0 as bigint) table_id, cast(0 as bigint) start_time from (select distinct job_id from kept) j
    union all select 'tables', job_id, table_id, 0 from (select distinct job_id, table_id from kept) k
    union all select 'job_logs', job_id, 0, start_time from (select distinct job_id, start_time from kept) l
    union all select 'table_logs', job_id, table_id, start_time from kept""",
)
def cascade_delete(t: Tables) -> DataFrame:
    """Jobs that failed lately go, with their tables and both kinds of log."""
    logs = table_logs(t).select("job_id", "table_id", "start_time")
    failed = (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    doomed = t.events.where(failed).select(F.col("user_id").alias("job_id")).distinct()
    # the logs that stay tell which jobs, tables and job logs stay
    kept = retention.cascade_delete(doomed, ["job_id"], table_logs=logs)["table_logs"]
    left = {
        "jobs": kept.select("job_id").distinct(),
        "tables": kept.select("job_id", "table_id").distinct(),
        "job_logs": kept.select("job_id", "start_time").distinct(),
        "table_logs": kept,
    }
    none = F.lit(0).cast("bigint")
    parts = [
        df.select(
            F.lit(kind).alias("kind"), "job_id",
            F.col("table_id") if "table_id" in df.columns else none.alias("table_id"),
            F.col("start_time") if "start_time" in df.columns else none.alias("start_time"),
        )
        for kind, df in left.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- requests ------------------------------------------------------------------------------


@query(
    "body_class",
    """select 'page' kind, page_id id, case when html = '' then 'Empty response' when not json_valid(html) then 'Invalid JSON'
      else html end body from pages
    union all select 'event', event_id, case when props = '' then 'Empty body' when not json_valid(props) then 'Invalid JSON'
      else props end from (select event_id, case event_type when 'view' then '' when 'click' then props || '}' else props end
      props from events) q""",
)
def body_class(t: Tables) -> DataFrame:
    pages = t.pages.select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        requests.body_class(F.col("html"), requests.EMPTY_RESPONSE).alias("body"),
    )
    sent = F.when(F.col("event_type") == "view", "").when(
        F.col("event_type") == "click", F.concat("props", F.lit("}"))
    ).otherwise(F.col("props"))
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), sent.alias("b"))
    return pages.unionByName(events.select("kind", "id", requests.body_class(F.col("b")).alias("body")))


@query(
    "latency",
    """with n as (select count(*) n from pages), q as (select url uri, (event_id * 37 % 8000 + 1) * 1000 us
      from events, n join pages on page_id = event_id % n.n)
    select uri, count(*) requests, cast(sum(us) as bigint) total_us, cast(sum(us) // count(*) as bigint) mean_us,
      max(us) max_us from q group by 1""",
)
def latency(t: Tables) -> DataFrame:
    """Requests are events, their uris the pages in turn, their ends the starts plus some milliseconds."""
    pages = t.pages.select("page_id", F.col("url").alias("uri"))
    took = (F.col("event_id") * 37 % 8000 + 1) * 1000
    asked = t.events.select(
        (F.col("event_id") % t.pages.count()).alias("page_id"),
        F.col("ts").cast("timestamp").alias("start"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + took).alias("stop"),
    )
    return requests.latency_by(asked.join(pages, "page_id"), "uri", "start", "stop")


@query("burst_audit", BURSTS)
def burst_audit(t: Tables) -> DataFrame:
    """At most two requests in six hours per user (events are minutes to hours apart)."""
    marked = requests.burst_audit(t.events, "user_id", "ts", "event_id", limit=2, window_seconds=6 * 3600)
    return requests.burst_summary(marked)
