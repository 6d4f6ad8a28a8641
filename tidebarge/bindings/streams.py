"""Streams over the given tables, drained to the end and returned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.requests import burst_summary
from ..plans.specs import PushSpec
from ..session import fresh_path
from ..sinks import tables as sinks
from ..sinks.keyed import KeyedTable
from ..streaming import bursts, feed, jobs
from .frames import BURSTS, sql_ts, ts_text
from .registry import Tables, query

NOW = "2024-01-30 23:00:00"
RUN = 1735689600  # the first run of a scheduled job, epoch seconds


def _stream(t: Tables, name: str, max_files: int | None = None) -> DataFrame:
    return feed.table_stream(t.spark, f"{t.folder.rstrip('/')}/{name}.parquet", max_files)


def _changes(loads: DataFrame) -> DataFrame:
    """Every event is a load of the table named by its type, done by one of 25 hosts."""
    loads = loads.withColumn("change_id", F.col("event_id")).withColumn("host", F.col("user_id") % 25)
    return feed.change_messages(loads, "warehouse", "event_type", "host", "ts")


@query(
    "change_feed",
    f"""select event_id change_id, 'warehouse:' || event_type message, user_id % 25 origin, {sql_ts('ts')} ts from events""",
)
def change_feed(t: Tables) -> DataFrame:
    return feed.drain_to_table(_changes(_stream(t, "events")), "changes").withColumn("ts", ts_text("ts"))


@query(
    "change_fanout",
    """select event_id change_id, 'warehouse:' || event_type message, cast(n_nationkey as bigint) receiver
    from events join nation on n_nationkey <> user_id % 25""",
)
def change_fanout(t: Tables) -> DataFrame:
    hosts = t.nation.select(F.col("n_nationkey").cast("bigint").alias("host_id"))
    delivered = feed.fan_out(_changes(_stream(t, "events")), hosts)
    return feed.drain_to_table(delivered.select("change_id", "message", "receiver"), "fanout")


@query(
    "host_liveness",
    f"""select user_id host_id, {sql_ts('max(ts)')} last_seen,
    epoch_us(timestamp '{NOW}') - epoch_us(max(ts)) >= 60000000 is_expired from events group by 1""",
)
def host_liveness(t: Tables) -> DataFrame:
    last = feed.liveness_stream(_stream(t, "events"), "user_id", "ts")
    return feed.with_expiry(last, NOW).withColumn("last_seen", ts_text("last_seen"))


@query(
    "scheduled_pull",
    """with a as (select event_id, event_type, value, 0 pull_time from events where ts <= timestamp '2024-01-16'
    union all select event_id, upper(event_type), value, 1 from events where ts > timestamp '2024-01-08')
    select event_id, event_type, value from a qualify row_number() over (partition by event_id order by pull_time desc) = 1""",
)
def scheduled_pull(t: Tables) -> DataFrame:
    """An existing load is caught up by a drained stream that overlaps it by a week."""
    columns = ["event_id", "event_type", "value"]
    target = KeyedTable(t.spark, fresh_path(t.spark, "scheduled"))
    target.merge(sinks.stamp(t.events.where("ts <= timestamp_ntz '2024-01-16 00:00:00'").select(*columns), 0))
    changed = _stream(t, "events").where("ts > timestamp_ntz '2024-01-08 00:00:00'").withColumn(
        "event_type", F.upper("event_type")
    )
    keyed = KeyedTable(t.spark, target.root, ["event_id"])
    return jobs.scheduled_pull(changed.select(*columns), keyed, ["value"], clock=lambda: RUN).drop("pull_time")


@query(
    "push_on_change",
    """select c_custkey, coalesce(e.c_name, c.c_name) c_name from customer c left join
    (select user_id, event_type || '#' || event_id c_name from events where event_type in ('signup', 'purchase')
      qualify row_number() over (partition by user_id order by case event_type when 'signup' then 1 else 0 end desc, ts desc, event_id desc) = 1) e
    on e.user_id = c.c_custkey
    union all select user_id, event_type || '#' || event_id from events where event_type in ('signup', 'purchase')
      and user_id not in (select c_custkey from customer)
      qualify row_number() over (partition by user_id order by case event_type when 'signup' then 1 else 0 end desc, ts desc, event_id desc) = 1""",
)
def push_on_change(t: Tables) -> DataFrame:
    """Customers take the name of their latest purchase, then of their latest signup, once those tables change."""
    specs = [
        PushSpec(s, "customer", "", key_columns=("c_custkey",), order_columns=("ts", "event_id"))
        for s in ("purchase", "signup", "refund")
    ]

    def rows_of(spec: PushSpec) -> DataFrame:
        return t.events.where(F.col("event_type") == spec.source_table).select(
            F.col("user_id").alias("c_custkey"),
            F.concat_ws("#", "event_type", F.col("event_id").cast("string")).alias("c_name"),
            "ts", "event_id",
        )

    base = KeyedTable(t.spark, fresh_path(t.spark, "pushed"))
    base.merge(t.customer.select("c_custkey", "c_name"))
    target = KeyedTable(t.spark, base.root, ["c_custkey"])
    return jobs.push_on_change(_changes(_stream(t, "events")), specs, rows_of, target, "event_id")


@query(
    "change_deliveries",
    """with e as (select event_id, event_type, user_id % 25 origin from events),
    r as (select cast(n_nationkey as bigint) receiver, n_nationkey * 997 cur from nation)
    select receiver, 'warehouse:' || event_type message, count(*) filter (event_id > cur) pending,
      coalesce(max(event_id) filter (event_id > cur), -1) newest
    from e, r where receiver <> origin group by 1, 2""",
)
def change_deliveries(t: Tables) -> DataFrame:
    """What every host still has to be told of every table, from its cursor in the one change log."""
    changes = _changes(t.events).withColumn("offset", F.col("change_id"))
    cursors = t.nation.select(F.col("n_nationkey").cast("bigint").alias("receiver"), (F.col("n_nationkey") * 997).cast("bigint").alias("cursor"))
    return feed.pending(changes, cursors).fillna(-1, ["newest"])


@query("burst_stream", BURSTS)
def burst_stream(t: Tables) -> DataFrame:
    """The request limit of ``burst_audit``, kept by a stream."""
    return burst_summary(bursts.burst_stream(_stream(t, "events"), "user_id", "ts", "event_id", limit=2, window_seconds=6 * 3600))


_GAP = 36 * 3600


@query(
    "host_expiries",
    f"""with b as (select user_id, ts, lag(ts) over (partition by user_id order by ts) before from events),
    s as (select user_id, ts, sum(case when before is null or epoch_us(ts) - epoch_us(before) >= {_GAP}000000 then 1 else 0 end)
      over (partition by user_id order by ts rows unbounded preceding) up from b),
    g as (select user_id, min(ts) up_from, max(ts) last_seen from s group by user_id, up)
    select user_id host_id, {sql_ts('up_from')} up_from, {sql_ts('last_seen')} last_seen,
      {sql_ts(f'last_seen + interval {_GAP} seconds')} expired_at from g
    where epoch_us(last_seen) + {_GAP}000000 - 1 <= (select epoch_us(max(ts)) // 1000 * 1000 - 60000000 from events)""",
)
def host_expiries(t: Tables) -> DataFrame:
    """Every time a host was lost: no heartbeat for 36 hours, found without waiting for its next one."""
    lost = feed.drain_to_table(feed.expiry_stream(_stream(t, "events"), "user_id", "ts", _GAP), "expiries")
    return lost.select("host_id", *[ts_text(c).alias(c) for c in ("up_from", "last_seen", "expired_at")])
