"""Scans, sinks, versions and watermarks over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, profile, relations, versions
from ..functions.text import length_from_comment, strip_nullable
from ..plans import jobs, movement
from ..plans.specs import FilterCondition, PullSpec, PushSpec
from ..session import fresh_path
from ..sinks import tables as sinks
from ..sinks.keyed import KeyedTable, Run
from ..sources import ranges
from ..sources.jdbc import slice_predicates
from ..sources.tables import run_select
from . import frames
from .frames import sql_epoch, sql_ts, ts_text
from .registry import TABLES, Tables, query

RUN = 1735689600  # a run start, epoch seconds
EARLIER = 1735603200
SINCE = FilterCondition("ts", "datetime", "2024-01-16T00:00:00Z")

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _profile_sql() -> str:
    digits = {"int": 10, "bigint": 19, "double": 22, "timestamp_ntz": 6}
    parts = []
    for table, text in COLUMNS.items():
        for i, field in enumerate(text.split(", "), 1):
            name, dtype = field.split(" ", 1)
            length = f"coalesce(max(length({name})), 0)" if dtype == "string" else "cast(0 as bigint)"
            is_key = str(name in KEYS.get(table, ())).lower()
            parts.append(
                f"select '{table}' table_code, '{name}' column_code, {i} ordinal, '{dtype}' data_type, {is_key} is_key, "
                f"{length} max_length, {digits.get(dtype, 0)} \"precision\", 0 scale, "
                f"count(*) > count({name}) has_null, count(*) - count({name}) null_count, count(*) row_count, '' \"comment\" from {table}"
            )
    return " union all ".join(parts)


# --- scans ------------------------------------------------------------------


@query(
    "source_select",
    f"""select o_orderkey, o_custkey, o_totalprice, {sql_ts('o_orderdate')} o_orderdate from orders
    where o_orderdate > timestamp '1998-06-01 00:00:00' and o_orderstatus = 'F'""",
)
def source_select(t: Tables) -> DataFrame:
    found = run_select(
        t.spark,
        "select o_orderkey, o_custkey, o_totalprice, o_orderdate from pulled_orders "
        "where o_orderdate > ? and o_orderstatus = ?",
        [FilterCondition("o_orderdate", "datetime", "1998-06-01"), FilterCondition("o_orderstatus", "string", "F")],
        {"pulled_orders": t.orders},
    )
    return found.withColumn("o_orderdate", ts_text("o_orderdate"))


@query(
    "source_select_partitioned",
    """with b as (select min(l_orderkey) lo, (max(l_orderkey) - min(l_orderkey)) // 8 step from lineitem)
    select cast(least(7, (l_orderkey - lo) // step) as integer) slice, count(*) row_count
    from lineitem, b group by 1""",
)
def source_select_partitioned(t: Tables) -> DataFrame:
    """Rows per slice of a partitioned read; bounds are two values from the file statistics."""
    lo, hi = t.lineitem.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    slices = slice_predicates("l_orderkey", lo, hi, 8)
    which = F.coalesce(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(slices)])
    return t.lineitem.select(which.alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "source_select_equi_depth",
    """select case when l_orderkey % 3 = 0 then 7 else l_orderkey end hot_key, l_orderkey, l_linenumber, l_partkey, true is_even
    from lineitem""",
)
def source_select_equi_depth(t: Tables) -> DataFrame:
    """Rows of eight ranges, read one by one; a third of all rows has one key. ``is_even``: the range holds an eighth, to a tenth."""
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("l_orderkey"))
    lines = t.lineitem.select(hot.alias("hot_key"), "l_orderkey", "l_linenumber", "l_partkey")
    columns = ["hot_key", "l_orderkey", "l_linenumber"]
    cuts = ranges.equi_depth_bounds(lines, columns, 8)
    parts = [lines.where(p).withColumn("slice", F.lit(i)) for i, p in enumerate(ranges.range_predicates(columns, cuts))]
    read = reduce(DataFrame.unionByName, parts)
    sizes = read.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    fair = sizes.agg(F.sum("n") / 8).first()[0] or 0
    even = sizes.select("slice", F.col("n").between(0.9 * fair, 1.1 * fair).alias("is_even"))
    return read.join(F.broadcast(even), "slice").drop("slice")  # a row per range


@query(
    "warehouse_select",
    """select l_returnflag, l_linestatus, count(*) row_count, cast(sum(cast(l_quantity as bigint)) as bigint) quantity
    from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00' group by 1, 2""",
)
def warehouse_select(t: Tables) -> DataFrame:
    return run_select(
        t.spark,
        "select l_returnflag, l_linestatus, count(*) row_count, sum(cast(l_quantity as bigint)) quantity "
        "from stored_lineitem where l_shipdate >= ? group by all",
        [FilterCondition("l_shipdate", "timestamp", "883612800")],
        {"stored_lineitem": t.lineitem},
    )


@query(
    "table_inventory",
    " union all ".join(f"select '{n}' table_code, '' table_name, count(*) row_count from {n}" for n in TABLES),
)
def table_inventory(t: Tables) -> DataFrame:
    return profile.table_inventory({n: getattr(t, n) for n in TABLES})


@query("column_profile", _profile_sql())
def column_profile(t: Tables) -> DataFrame:
    return profile.profile_tables({n: getattr(t, n) for n in TABLES}, KEYS)


@query(
    "key_column_join",
    """select l_returnflag table_schema, l_orderkey table_id, l_linenumber column_no,
    case when exists (select 1 from lineitem k where k.l_linestatus = 'O' and k.l_returnflag = c.l_returnflag
      and k.l_orderkey = c.l_orderkey and k.l_linenumber = c.l_linenumber) then '是' else '否' end is_key
    from lineitem c""",
)
def key_column_join(t: Tables) -> DataFrame:
    cols = t.lineitem.select(
        F.col("l_returnflag").alias("table_schema"), F.col("l_orderkey").alias("table_id"),
        F.col("l_linenumber").alias("column_no"), "l_linestatus",
    )
    usage = cols.where("l_linestatus = 'O'")
    return relations.key_columns(cols.drop("l_linestatus"), usage, ["table_schema", "table_id", "column_no"])


@query(
    "length_from_comment",
    """select p_partkey, coalesce(try_cast(string_split(c, '_')[-1] as bigint), 0) max_length from (
    select p_partkey, replace(p_name, ' ', '_') || case when p_size > 10 then '_' || p_size else '' end c from part) q""",
)
def _length_from_comment(t: Tables) -> DataFrame:
    comment = F.concat(
        F.translate("p_name", " ", "_"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise(F.lit("")),
    )
    return t.part.select("p_partkey", length_from_comment(comment).alias("max_length"))


@query("strip_nullable", "select p_partkey, p_type data_type, p_size > 25 is_nullable from part")
def _strip_nullable(t: Tables) -> DataFrame:
    declared = F.when(F.col("p_size") > 25, F.concat(F.lit("Nullable("), F.col("p_type"), F.lit(")"))).otherwise(
        F.col("p_type")
    )
    name, nullable = strip_nullable(declared)
    return t.part.select("p_partkey", name.alias("data_type"), nullable.alias("is_nullable"))


# --- sinks ------------------------------------------------------------------


@query(
    "load_append",
    f"""select event_id, user_id, event_type, value, cast(case when ts <= timestamp '2024-01-16 00:00:00'
    then {EARLIER} else {RUN} end as bigint) pull_time from events""",
)
def load_append(t: Tables) -> DataFrame:
    """Two loads appended to one table."""
    out = fresh_path(t.spark, "append")
    rows = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    old = rows.where("ts <= timestamp_ntz '2024-01-16 00:00:00'").drop("ts")
    new = rows.where("ts > timestamp_ntz '2024-01-16 00:00:00'").drop("ts")
    sinks.append_counted(sinks.stamp(old, EARLIER), out)
    sinks.append_counted(sinks.stamp(new, RUN), out)
    return t.spark.read.parquet(out)


@query(
    "load_full_refresh",
    f"""select o_orderkey, o_custkey, o_totalprice, cast({RUN} as bigint) pull_time from orders
    where o_orderstatus <> 'P'""",
)
def load_full_refresh(t: Tables) -> DataFrame:
    name = "refresh_" + fresh_path(t.spark, "t")[-12:]
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    kept = ["o_orderkey", "o_custkey", "o_totalprice"]
    sinks.swap_in(t.spark, name, sinks.stamp(rows.select(*kept), EARLIER), fresh_path(t.spark, "refresh"))
    fresh = movement.pull(PullSpec(name, ""), rows.where("o_orderstatus <> 'P'").select(*kept), None, RUN)
    sinks.swap_in(t.spark, name, fresh.target, fresh_path(t.spark, "refresh"))
    return t.spark.table(name)


def _event_loads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An earlier load, and what the source returns from the watermark on: newer rows and changed errors."""
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    old = sinks.stamp(rows.where("ts <= timestamp_ntz '2024-01-16 00:00:00'"), EARLIER)
    changed = rows.withColumn("ts", F.when(F.col("event_type") == "error", F.expr("ts + interval 30 days")).otherwise(
        F.col("ts"))).withColumn("event_type", F.when(F.col("event_type") == "error", "fixed").otherwise(
            F.col("event_type")))
    return old, changed


_EVENT_LOADS = """old as (select event_id, ts, user_id, event_type, value from events
  where ts <= timestamp '2024-01-16 00:00:00'),
src as (select event_id, case event_type when 'error' then ts + interval 30 days else ts end ts, user_id,
  case event_type when 'error' then 'fixed' else event_type end event_type, value from events),
new as (select * from src where ts > timestamp '2024-01-16 00:00:00'),
both_loads as (select *, {a} pull_time from old union all select *, {b} from new),
merged as (select * from both_loads qualify row_number() over
  (partition by event_id order by pull_time desc, ts desc) = 1)""".format(a=EARLIER, b=RUN)


def incremental_pull(t: Tables) -> KeyedTable:
    """The table after an earlier load and a pull from its watermark on; the pull writes its own rows only."""
    old, source = _event_loads(t)
    spec = PullSpec(
        "events", "select event_id, ts, user_id, event_type, value from source_events where ts > ?", (SINCE,),
        ("event_id",), ("ts",),
    )
    root = fresh_path(t.spark, "events")
    KeyedTable(t.spark, root).merge(old, run=Run("pull", EARLIER))
    rows = run_select(t.spark, spec.select_sql, spec.filter_val, {"source_events": source})
    target = KeyedTable(t.spark, root, spec.key_columns)
    state = [SINCE, FilterCondition("event_id", "integer", "0")]
    target.merge(sinks.stamp(rows, RUN), spec.tiebreak, state, Run("pull", RUN))
    return target


@query(
    "load_incremental",
    f"""with {_EVENT_LOADS} select event_id, {sql_ts('ts')} ts, user_id, event_type, value,
    cast(pull_time as bigint) pull_time from merged""",
)
def load_incremental(t: Tables) -> DataFrame:
    return incremental_pull(t).read().withColumn("ts", ts_text("ts"))


@query(
    "push_truncate_insert",
    """select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_returnflag = 'A'""",
)
def push_truncate_insert(t: Tables) -> DataFrame:
    """The content is replaced by one new version; a failed write leaves the old one."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    target = KeyedTable(t.spark, fresh_path(t.spark, "truncate-insert"))
    target.merge(t.lineitem.where("l_returnflag = 'R'").select(*columns))
    spec = PushSpec("lineitem", "pushed_lineitem", "", insert_columns=tuple(columns))
    target.merge(movement.push(spec, t.lineitem.where("l_returnflag = 'A'"), target.read()), whole=True)
    return target.read()


def order_changes(t: Tables) -> DataFrame:
    """A push batch for orders: open ones twice (closed, then priced up), and copies under new keys."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    first = o.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("F")).withColumn("seq", F.lit(1))
    second = first.withColumn("o_totalprice", F.col("o_totalprice") + 1000).withColumn("seq", F.lit(2))
    added = o.where("o_orderstatus = 'O'").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000).withColumn(
        "seq", F.lit(1)
    )
    return first.unionByName(second).unionByName(added)


@query(
    "push_replace_into",
    """select o_orderkey, o_custkey, case o_orderstatus when 'P' then 'F' else o_orderstatus end o_orderstatus,
    case o_orderstatus when 'P' then o_totalprice + 1000 else o_totalprice end o_totalprice, false is_reject from orders
    union all select o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, false from orders
    where o_orderstatus = 'O'
    union all select -1, o_custkey, o_orderstatus, o_totalprice, true from orders where o_custkey % 5 = 0""",
)
def push_replace_into(t: Tables) -> DataFrame:
    """The target after the push, and the batch rows that have no key."""
    spec = PushSpec("changes", "orders", "", key_columns=("o_orderkey",), order_columns=("seq",))
    target = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lost = t.orders.where("o_custkey % 5 = 0").select(
        F.lit(None).cast("bigint").alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("seq")
    )
    batch = order_changes(t).unionByName(lost)
    root = fresh_path(t.spark, "orders")
    KeyedTable(t.spark, root).merge(target)
    pushed = KeyedTable(t.spark, root, spec.key_columns)
    pushed.merge(batch, spec.order_columns, helper="seq")
    rows = pushed.read().withColumn("is_reject", F.lit(False))
    rejects = pushed.rejects().drop("reason").withColumn("is_reject", F.lit(True))
    return rows.unionByName(rejects).withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1).cast("bigint")))


@query(
    "key_integrity",
    """with l as (select nullif(l_orderkey, 5) k1, l_linenumber k2, count(*) n from lineitem group by 1, 2),
    o as (select o_orderkey k1, count(*) n from orders group by 1)
    select 'lineitem' table_code, cast(sum(n) as bigint) "rows", count(*) filter (n > 1) repeated_keys,
      cast(coalesce(sum(n) filter (k1 is null or k2 is null), 0) as bigint) null_key_rows, false is_fit from l
    union all select 'orders', cast(sum(n) as bigint), count(*) filter (n > 1),
      cast(coalesce(sum(n) filter (k1 is null), 0) as bigint), true from o""",
)
def key_integrity(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.nullif("l_orderkey", F.lit(5)).alias("k1"), F.col("l_linenumber").alias("k2"))
    return movement.key_integrity(lines, "lineitem", ["k1", "k2"]).unionByName(
        movement.key_integrity(t.orders, "orders", ["o_orderkey"])
    )


@query("truncate_target", "select count(*) rows_before, cast(0 as bigint) rows_after from customer")
def truncate_target(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "truncate")
    t.customer.write.parquet(out)
    before = t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows_before")).first()[0]
    sinks.emptied(t.customer).write.mode("overwrite").parquet(out)
    return t.spark.read.parquet(out).agg(
        F.lit(before).cast("bigint").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    )


def _batched_sql(batch: int) -> str:
    columns = {n: len(c.split(", ")) for n, c in COLUMNS.items()}
    return " union all ".join(
        f"select '{n}' table_code, count(*) \"rows\", true within_cap, "
        f"(count(*) + least({batch}, 65534 // {c}) - 1) // least({batch}, 65534 // {c}) <= count(*) has_files, "
        f"least({batch}, 65534 // {c}) per_statement, "
        f"cast(ceil(count(*) / least({batch}, 65534 // {c})) as bigint) statements, "
        f"cast(greatest(count(*) - 1, 0) % least({batch}, 65534 // {c}) + least(count(*), 1) as bigint) last_rows from {n}"
        for n, c in columns.items()
    )


@query("batched_write", _batched_sql(2000))
def batched_write(t: Tables) -> DataFrame:
    """Every table written in batches of 2000 rows (a wide one in smaller ones), told from the files, and the statements of such a push."""
    return reduce(
        DataFrame.unionByName,
        [sinks.batch_report(getattr(t, n), fresh_path(t.spark, f"batches-{n}"), 2000).withColumn("table_code", F.lit(n)) for n in TABLES],
    )


@query("load_count", "select 'orders' table_code, count(*) written, count(*) record_count from orders")
def load_count(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "count")
    written = sinks.append_counted(t.orders, out)
    return sinks.load_count(t.spark.read.parquet(out)).select(
        F.lit("orders").alias("table_code"), F.lit(written).cast("bigint").alias("written"), "record_count"
    )


# --- versions and watermarks --------------------------------------------------


@query(
    "drop_oldest_version",
    f"""with {frames.VERSIONS}, dd as (select k1, k2, min(pull_time) pt from v group by k1, k2 having count(*) > 1)
    select v.* from v left join dd on v.k1 = dd.k1 and v.k2 = dd.k2 and v.pull_time = dd.pt where dd.pt is null""",
)
def drop_oldest_version(t: Tables) -> DataFrame:
    return versions.drop_oldest_version(frames.versions(t), ["k1", "k2"])


@query(
    "latest_version",
    f"""with {frames.VERSIONS} select * from v qualify
    row_number() over (partition by k1, k2 order by pull_time desc, l_partkey desc) = 1""",
)
def latest_version(t: Tables) -> DataFrame:
    return versions.latest_version(frames.versions(t), ["k1", "k2"], tiebreak=["l_partkey"])


@query(
    "duplicate_keys",
    f"with {frames.VERSIONS} select k1, k2, count(*) versions from v group by 1, 2 having count(*) > 1",
)
def duplicate_keys(t: Tables) -> DataFrame:
    return versions.duplicate_keys(frames.versions(t), ["k1", "k2"])


@query(
    "group_min_having",
    f"with {frames.VERSIONS} select k1, k2, min(pull_time) pull_time from v group by 1, 2 having count(*) > 1",
)
def group_min_having(t: Tables) -> DataFrame:
    return versions.oldest_of_repeated(frames.versions(t), ["k1", "k2"])


@query(
    "composite_in_subquery",
    f"""with {frames.VERSIONS} select * from v where (k1, k2, pull_time) in
    (select (k1, k2, min(pull_time)) from v group by k1, k2 having count(*) > 1)""",
)
def composite_in_subquery(t: Tables) -> DataFrame:
    v = frames.versions(t)
    return versions.in_grouped(v, versions.oldest_of_repeated(v, ["k1", "k2"]), ["k1", "k2", "pull_time"])


@query(
    "advance_watermark",
    f"""with {_EVENT_LOADS} select '[{{"column":"ts","dataType":"datetime","value":"' || {sql_ts('max(ts)')} ||
    '"}},{{"column":"event_id","dataType":"integer","value":"' || max(event_id) || '"}}]' filter_val from merged""",
)
def advance_watermark(t: Tables) -> DataFrame:
    """The watermark that the table's version holds after the pull."""
    return t.spark.createDataFrame([(incremental_pull(t).version().state,)], "filter_val string")


_CODED = f"""'[{{"column":"ts","dataType":"datetime","value":"' || {sql_ts('ts')} ||
      '"}},{{"column":"event_id","dataType":"integer","value":"' || id || '"}}]'"""


@query(
    "watermark_codec",
    f"""with e as (select user_id, event_type, max(ts) ts, max(event_id) id from events group by 1, 2),
    s as (select *, case user_id % 10 when 3 then 'no list' when 4 then '' else {_CODED} end filter_val from e)
    select user_id, event_type, filter_val, 'ts' filter_column, 'datetime' data_type, {sql_ts('ts')} "value", '' reason
      from s where user_id % 10 not in (3, 4)
    union all select user_id, event_type, filter_val, 'event_id', 'integer', cast(id as varchar), ''
      from s where user_id % 10 not in (3, 4)
    union all select user_id, event_type, filter_val, '', '', '',
      case user_id % 10 when 3 then 'unreadable state' else 'no state' end from s where user_id % 10 in (3, 4)""",
)
def watermark_codec(t: Tables) -> DataFrame:
    """A state per (user, type) encoded to JSON and decoded again; some states are empty and some cannot be read."""
    top = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max("event_id").alias("id"))
    text = versions.encode_watermark(
        [
            (F.lit("ts"), F.lit("datetime"), ts_text("ts")),
            (F.lit("event_id"), F.lit("integer"), F.col("id").cast("string")),
        ]
    )
    kind = F.col("user_id") % 10
    state = top.select("user_id", "event_type", F.when(kind == 3, "no list").when(kind == 4, "").otherwise(text).alias("filter_val"))
    decoded = versions.decode_watermarks(state.withColumn("coded", F.col("filter_val")), "coded")
    names = ["filter_column", "data_type", "value", "reason"]
    return decoded.withColumns({c: F.coalesce(c, F.lit("")) for c in names})


@query(
    "pull_time_since",
    f"with {frames.VERSIONS} select * from v where pull_time >= 883612800",
)
def pull_time_since(t: Tables) -> DataFrame:
    return versions.since_pull(frames.versions(t), 883612800)


@query("rows_per_pull", f"with {frames.VERSIONS} select pull_time, count(*) record_count from v group by 1")
def rows_per_pull(t: Tables) -> DataFrame:
    return versions.rows_per_pull(frames.versions(t))


@query(
    "max_per_column",
    f"""select max(l_orderkey) l_orderkey, max(l_extendedprice) l_extendedprice, {sql_ts('max(l_shipdate)')} l_shipdate
    from lineitem""",
)
def max_per_column(t: Tables) -> DataFrame:
    top = versions.max_per_column(t.lineitem, ["l_orderkey", "l_extendedprice", "l_shipdate"])
    return top.withColumn("l_shipdate", ts_text("l_shipdate"))


# --- whole jobs ---------------------------------------------------------------

_MIDDLE, _OVERLAP = "2024-01-16 00:00:00", "2024-01-10 00:00:00"


def _pull_twice(t: Tables) -> jobs.Store:
    """Two runs of a pull job: events up to the middle, then all after the watermark with some corrected.

    One table fails; users of 100 have no key and those of 101 one that is no number. Every run is done twice.
    """
    store = jobs.Store(t.spark, fresh_path(t.spark, "job"))
    columns = ["event_id", "ts", "user_id", "event_type"]
    specs = [
        PullSpec("events", "select * from source where ts > ?", (FilterCondition("ts", "datetime", "1970-01-01 00:00:00"),), ("event_id",), ("ts",)),
        PullSpec("users", "select distinct user_id from source", key_columns=("user_id",)),
        PullSpec("broken", "select nothing"),
        PullSpec("off", "select nothing", enabled=False),
    ]
    early = t.events.where(f"ts <= timestamp_ntz '{_MIDDLE}'").select(*columns)
    fixed = t.events.where(f"event_type = 'error' and ts <= timestamp_ntz '{_MIDDLE}'").select(
        "event_id", F.expr("ts + interval 60 days").alias("ts"), "user_id", F.lit("fixed").alias("event_type")
    )
    late = t.events.where(f"ts > timestamp_ntz '{_OVERLAP}'").select(*columns).unionByName(fixed)
    for now, source in ((EARLIER, early), (RUN, late)):

        def rows_of(spec: PullSpec, source: DataFrame = source) -> DataFrame:
            if spec.dest_table == "broken":
                raise ValueError("no such table")
            if spec.filter_val:
                return filters.since(source, spec.filter_val)
            users = source.select(F.col("user_id").cast("string").alias("user_id")).distinct()
            return users.withColumn("user_id", F.when(F.col("user_id") == "101", "n/a").when(F.col("user_id") != "100", F.col("user_id")))

        for _ in range(2):
            jobs.run_pull_job(store, 1, specs, rows_of, now, casts={"users": {"user_id": "int64"}})
    return store


_PULLED = f"""first as (select * from events where ts <= timestamp '{_MIDDLE}'),
low as (select max(ts) m from first),
fixed as (select event_id, ts + interval 60 days ts, user_id, 'fixed' event_type from events where event_type = 'error' and ts <= timestamp '{_MIDDLE}'),
late as (select event_id, ts, user_id, event_type from events where ts > timestamp '{_OVERLAP}' union all select * from fixed),
second as (select late.* from late, low where ts > m),
pulled as (select event_id, user_id, event_type, {EARLIER} pull_time from first where event_id not in (select event_id from second)
  union all select event_id, user_id, event_type, {RUN} from (select * from second qualify row_number() over (partition by event_id order by ts desc) = 1) q)"""


@query(
    "pull_job_run",
    f"""with {_PULLED} select 'events' kind, event_id id, event_type note, cast(pull_time as bigint) stamp, 0 "rows" from pulled
    union all select 'users', user_id, '', {RUN}, 0 from (select distinct user_id from late) u where user_id not in (100, 101)
    union all select 'reject', 0, case user_id when 100 then 'no key' else '[{{"column":"user_id","reason":"not a number"}}]' end, {RUN}, 0
      from (select distinct user_id from late) u where user_id in (100, 101)
    union all select 'log', 1, 'completed', {EARLIER}, count(*) from first
    union all select 'log', 1, 'completed', {RUN}, count(*) from second
    union all select 'log', 2, 'completed', {EARLIER}, count(distinct user_id) from first
    union all select 'log', 2, 'completed', {RUN}, count(distinct user_id) from late
    union all select 'log', 3, 'failed', {EARLIER}, 0 union all select 'log', 3, 'failed', {RUN}, 0
    union all select 'change', 0, 'warehouse:events', {EARLIER}, 0 union all select 'change', 0, 'warehouse:events', {RUN}, 0
    union all select 'change', 0, 'warehouse:users', {EARLIER}, 0 union all select 'change', 0, 'warehouse:users', {RUN}, 0""",
)
def pull_job_run(t: Tables) -> DataFrame:
    """Both tables of a pull job after two runs, its rejects, logs and change messages."""
    store = _pull_twice(t)
    none = F.lit(0).cast("bigint")
    line = lambda kind, id_, note, at, rows: [
        F.lit(kind).alias("kind"), id_.cast("bigint").alias("id"), note.alias("note"), at.cast("bigint").alias("stamp"), rows.cast("bigint").alias("rows")
    ]
    parts = [
        store.table("events").select(*line("events", F.col("event_id"), F.col("event_type"), F.col("pull_time"), none)),
        store.table("users").select(*line("users", F.col("user_id"), F.lit(""), F.col("pull_time"), none)),
        store.rejects("users").select(*line("reject", none, F.col("reason"), F.col("pull_time"), none)),
        store.logs().select(*line("log", F.col("table_id"), F.col("status"), F.col("start_time"), F.col("record_count"))),
        store.changes().select(*line("change", none, F.col("message"), F.col("ts"), none)),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "push_job_run",
    f"""with {_PULLED} select 'target' kind, event_id id, event_type note, 0 "rows" from pulled
    union all select 'log', {EARLIER}, 'completed', count(*) from first
    union all select 'log', {RUN}, 'completed', count(*) from pulled where pull_time >= {EARLIER} + 1""",
)
def push_job_run(t: Tables) -> DataFrame:
    """A push after each of two pulls: the second sends what was loaded since the first."""
    store = _pull_twice(t)
    rows = store.table("events").select("event_id", "event_type", "pull_time")
    before = t.events.where(f"ts <= timestamp_ntz '{_MIDDLE}'").select("event_id", "event_type", F.lit(EARLIER).cast("bigint").alias("pull_time"))
    spec = PushSpec("events", "sent", "", key_columns=("event_id",))
    for frame, now in ((before, EARLIER + 1), (rows, RUN + 1), (rows, RUN + 1)):
        jobs.run_push_job(store, 2, [spec], lambda _, frame=frame: frame, now)
    none = F.lit(0).cast("bigint")
    logs = store.logs().where("job_id = 2").select(
        F.lit("log").alias("kind"), (F.col("start_time") - 1).alias("id"), F.col("status").alias("note"), F.col("record_count").alias("rows")
    )
    sent = store.table("sent").select(F.lit("target").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("note"), none.alias("rows"))
    return sent.unionByName(logs)
