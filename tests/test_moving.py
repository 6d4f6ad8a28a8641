"""Sinks, sources and streams."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidebarge.bindings import QUERIES, TABLES
from tidebarge.operators import conform, filters, normalize
from tidebarge.plans import movement
from tidebarge.plans.movement import push
from tidebarge.plans.specs import ColumnDescriptor as Col
from tidebarge.plans.specs import FilterCondition, PullSpec, PushSpec
from tidebarge.session import fresh_path
from tidebarge.sinks import tables as sinks
from tidebarge.sinks.keyed import KeyedTable
from tidebarge.sources import jdbc
from tidebarge.sources.tables import bind_values, run_select
from tidebarge.streaming import feed, jobs


def test_append_counts_and_adds(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.append_counted(sinks.stamp(spark.range(7), 5), path) == 7
    assert sinks.append_counted(sinks.stamp(spark.range(3), 6), path, max_rows_per_file=2) == 3
    assert rows(spark.read.parquet(path).groupBy("pull_time").count()) == [(5, 7), (6, 3)]


def test_swap_keeps_old_content_when_the_load_fails(spark):
    sinks.swap_in(spark, "swapped", spark.range(3), fresh_path(spark, "swap"))
    sinks.swap_in(spark, "swapped", spark.range(5), fresh_path(spark, "swap"))
    assert spark.table("swapped").count() == 5
    broken = spark.range(9).select(F.raise_error(F.lit("source went away")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="source went away"):
        sinks.swap_in(spark, "swapped", broken, fresh_path(spark, "swap"))
    assert spark.table("swapped").count() == 5


def test_truncate_keeps_the_schema(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("emptied")
    sinks.truncate(spark, "emptied")
    assert spark.table("emptied").count() == 0 and spark.table("emptied").columns == ["id"]


@pytest.mark.parametrize("n", [0, 3, 4, 9])
def test_written_files(spark, tmp_path, n):
    files = sinks.written_files(spark.range(n).coalesce(1), str(tmp_path / "out"), 4).collect()
    assert sum(r.rows for r in files) == n and len(files) == -(-n // 4) and all(r.rows <= 4 for r in files)


@pytest.mark.parametrize("n", [0, 3, 4, 9])
def test_batches_are_written(spark, tmp_path, n):
    got = sinks.batch_report(spark.range(n).coalesce(1), str(tmp_path / "out"), 4).first()
    assert tuple(got) == (n, True, True, 4, -(-n // 4), n - 4 * max(0, -(-n // 4) - 1))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_the_batched_query_writes_every_table(spark, tmp_path, monkeypatch):
    for i, name in enumerate(TABLES):
        spark.range(2001 * (i % 2) + i).write.parquet(str(tmp_path / f"{name}.parquet"))
    made = []
    monkeypatch.setattr(sinks, "written_files", lambda df, path, most, f=sinks.written_files: made.append(path) or f(df, path, most))
    got = {r.table_code: r for r in QUERIES["batched_write"](spark, str(tmp_path)).collect()}
    assert sorted(spark.read.parquet(p).count() for p in made) == sorted(2001 * (i % 2) + i for i in range(len(TABLES)))
    assert all(r.within_cap and r.has_files for r in got.values())
    assert got["nation"].rows == 2002 and got["nation"].statements == 2 and got["nation"].last_rows == 2 and got["region"].statements == 0


def test_winner_of_a_tie_does_not_depend_on_partitions(spark):
    batch = spark.createDataFrame([(i % 3, 1, f"row{i}") for i in range(60)], "k int, v int, name string")
    spec = PullSpec("t", "", (FilterCondition("v", "integer", "0"),), ("k",))
    got = {tuple(rows(movement.pull(spec, batch.repartition(n), None, 5).target)) for n in (1, 2, 3, 7, 20)}
    assert len(got) == 1


def test_rows_without_a_key_are_rejects(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    batch = spark.createDataFrame([(None, "x"), (None, "x"), (1, "b")], "k int, v string")
    spec = PushSpec("s", "t", "", key_columns=("k",))
    once = movement.push(spec, batch, target)
    assert rows(once) == rows(movement.push(spec, batch, once)) == [(1, "b")]
    assert rows(movement.null_key_rows(batch, ["k"])) == [(None, "x"), (None, "x")]
    assert movement.pull(PullSpec("t", "", (), ("k",)), batch, None, 5).rejects.count() == 2


def test_a_wide_table_goes_in_smaller_statements():
    assert sinks.rows_per_statement(1000, 65) == 1000 and sinks.rows_per_statement(2000, 47) == 1394
    assert sinks.rows_per_statement(10, 70_000) == 1


@pytest.mark.parametrize("lower, upper, n", [(0, 100, 8), (0, 3, 8), (5, 5, 4), (-10, 10, 3), (0, 100, 1)])
def test_slices_hold_every_row_once(spark, lower, upper, n):
    df = spark.createDataFrame([(i,) for i in [None, *range(-20, 120)]], "k int")
    hits = sum(F.when(F.expr(p), 1).otherwise(0) for p in jdbc.slice_predicates("k", lower, upper, n))
    assert [r[0] for r in df.select(hits.alias("h")).distinct().collect()] == [1]


class FakeConnection:
    """Records what a keyed replace sends."""

    def __init__(self, fail_at=None):
        self.sent, self.commits, self.rollbacks, self.closed, self.fail_at = [], 0, 0, False, fail_at

    def cursor(self):
        return self

    def execute(self, sql, values):
        if len(self.sent) == self.fail_at:
            raise RuntimeError("lost connection")
        self.sent.append((sql, values))

    def commit(self):
        self.commits += 1

    def rollback(self):
        self.rollbacks += 1

    def close(self):
        self.closed = True


def test_replace_sends_batches_in_transactions():
    c = FakeConnection()
    jdbc.replace_partition(lambda: c, "t", ["a", "b"], 2)([(1, "x"), (2, "y"), (3, "z")])
    assert c.sent == [("replace into t(a,b) values (?,?),(?,?)", [1, "x", 2, "y"]), ("replace into t(a,b) values (?,?)", [3, "z"])]
    assert c.commits == 2 and c.closed


def test_replace_rolls_back_the_failed_batch():
    c = FakeConnection(fail_at=1)
    with pytest.raises(RuntimeError):
        jdbc.replace_partition(lambda: c, "t", ["a"], 1)([(1,), (2,)])
    assert (c.commits, c.rollbacks, c.closed) == (1, 1, True)


def test_bound_values(spark):
    got = bind_values(spark, [
        FilterCondition("a", "string", "x"), FilterCondition("b", "integer", "7"), FilterCondition("c", "float", "1.5"),
        FilterCondition("d", "datetime", "2021-05-10T17:36:14Z"), FilterCondition("e", "weird", "1"),
    ])
    assert got == ["x", 7, 1.5, "2021-05-10 17:36:14.000000", None]
    with pytest.raises(ValueError):
        bind_values(spark, [FilterCondition("d", "date", "yesterday")])


def _scan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_watermark_filters_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    state = [FilterCondition("ts", "datetime", "2024-01-16T00:00:00Z")]
    by_frame = _scan(filters.since(events, state).select("event_id"))
    by_sql = _scan(run_select(spark, "select event_id from e where ts > ?", state, {"e": events}))
    for plan in (by_frame, by_sql):
        assert "GreaterThan(ts,2024-01-16T00:00)" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_id_list_goes_to_the_scan_or_to_a_semi_join(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert "In(o_orderkey, [1,2])" in _scan(filters.in_id_list(orders, "o_orderkey", [1, 2]))
    many = [str(i) for i in range(5000)]
    text = orders.select(F.col("o_orderkey").cast("string").alias("k"))
    assert filters.in_id_list(text, "k", many).count() == orders.where("o_orderkey < 5000").count()
    frame = orders.select("o_orderkey").limit(3)
    assert "LeftSemi" in filters.in_id_list(orders, "o_orderkey", frame)._jdf.queryExecution().toString()
    assert filters.in_id_list(orders, "o_orderkey", range(1200)).count() == 1200


# --- type maps ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "column, want",
    [(Col("a", "tinyint unsigned", is_nullable=False), ("UInt8", "smallint")), (Col("a", "int"), ("Nullable(Int32)", "int")),
     (Col("a", "int(11)"), ("Nullable(String)", "string")), (Col("a", "decimal", precision=9, scale=2), ("Nullable(Decimal32(2))", "decimal(9,2)")),
     (Col("a", "decimal", precision=19, scale=0), ("Nullable(Decimal64(0))", "decimal(19,0)")),
     (Col("a", "decimal", precision=65, scale=30), ("Nullable(Decimal256(30))", "string")),
     (Col("a", "datetime", precision=3), ("Nullable(DateTime64(3))", "timestamp")), (Col("a", "date", is_nullable=False), ("Date", "date")),
     (Col("a", "json"), ("Nullable(String)", "string")), (Col("a", "bigint unsigned", is_nullable=False), ("UInt64", "decimal(20,0)"))],
)
def test_warehouse_types(column, want):
    assert conform.warehouse_type(column) == want


@pytest.mark.parametrize(
    "column, want",
    [(Col("a", "UInt64"), "bigint unsigned"), (Col("a", "DateTime64", precision=7), "varchar(50)"),
     (Col("a", "DateTime64", precision=6), "datetime(6)"), (Col("a", "Decimal", precision=65, scale=30), "decimal(65,30)"),
     (Col("a", "Decimal", precision=66), "text"), (Col("a", "Decimal", precision=40, scale=31), "text"),
     (Col("a", "String", max_length=20), "varchar(20)"), (Col("a", "String", max_length=70000), "text"),
     (Col("a", "String"), "text"), (Col("a", "UUID"), "text")],
)
def test_target_types(column, want):
    assert conform.target_type(column) == want


def test_spark_schema_carries_keys_and_stamp():
    schema = conform.spark_schema([Col("id", "bigint", is_key=True, is_nullable=False), Col("name", "varchar", max_length=9)])
    assert schema.simpleString() == "struct<id:bigint,name:string,pull_time:bigint>"
    assert schema["id"].metadata["is_key"] and not schema["id"].nullable and schema["name"].metadata["max_length"] == 9


@pytest.mark.parametrize(
    "kind, precision, rule",
    [("decimal", 39, "as_text"), ("decimal", 38, "unchanged"), ("datetime", 10, "datetime_text"), ("timestamp", 6, "unchanged"),
     ("time", 0, "time_text"), ("year", 0, "year_text"), ("bit", 0, "bit_text"), ("enum", 0, "as_text"), ("set", 0, "as_text"),
     ("varbinary", 0, "base64_text"), ("longblob", 0, "base64_text"), ("json", 0, "json_text"), ("multipolygon", 0, "point_wkt"),
     ("bigint unsigned", 0, "unchanged"), ("date", 0, "unchanged"), ("mediumtext", 0, "unchanged"), ("uuid", 0, "as_text")],
)
def test_pull_rules(kind, precision, rule):
    assert normalize.pull_rule(Col("a", kind, precision=precision)).__name__ == rule


@pytest.mark.parametrize(
    "kind, precision, scale, rule",
    [("DateTime64", 7, 0, "as_text"), ("DateTime", 0, 0, "unchanged"), ("Decimal128", 38, 31, "as_text"), ("Decimal64", 18, 2, "unchanged"),
     ("UUID", 0, 0, "as_text"), ("Array(String)", 0, 0, "json_of"), ("Map(String, String)", 0, 0, "json_of"), ("IPv6", 0, 0, "as_text"),
     ("FixedString(8)", 0, 0, "fixed_string_text"), ("UInt8", 0, 0, "unchanged"), ("String", 0, 0, "unchanged"),
     ("Date", 0, 0, "unchanged"), ("Date32", 0, 0, "as_text"), ("Bool", 0, 0, "as_text")],
)
def test_push_rules(kind, precision, scale, rule):
    assert normalize.push_rule(Col("a", kind, precision=precision, scale=scale)).__name__ == rule


def test_no_columns_is_an_error(spark):
    with pytest.raises(ValueError):
        normalize.normalize_pull(spark.range(1), [])
    with pytest.raises(ValueError):
        normalize.insert_columns(spark.range(1).withColumn("x", F.lit(1)), ["id"])


# --- streams ---------------------------------------------------------------------------


def test_fan_out_skips_the_sender_only(spark):
    changes = spark.createDataFrame([("w:t", 1, 10), ("w:u", 2, 11)], "message string, origin bigint, change_id bigint")
    hosts = spark.createDataFrame([(i,) for i in range(1, 21)], "host_id bigint")
    got = feed.fan_out(changes, hosts)
    assert sorted((r.change_id, r.receiver) for r in got.collect()) == sorted(
        (c, h) for c, o in ((10, 1), (11, 2)) for h in range(1, 21) if h != o
    )


def test_expiry_at_sixty_seconds(spark):
    df = spark.sql("select 1 host_id, timestamp '2024-01-01 00:00:00' last_seen union all select 2, timestamp '2024-01-01 00:00:01'")
    assert rows(feed.with_expiry(df, "2024-01-01 00:01:00").select("host_id", "is_expired")) == [(1, True), (2, False)]


def _log(spark, path, batches):
    for b in batches:
        spark.createDataFrame(b, "id int, v string").coalesce(1).write.mode("append").parquet(path)


def test_scheduled_pull_keeps_the_newest_batch(spark, tmp_path):
    path = str(tmp_path / "source")
    _log(spark, path, [[(1, "a"), (2, "b")], [(2, "B"), (3, "c")]])
    target = KeyedTable(spark, str(tmp_path / "target"), ["id"])
    got = jobs.scheduled_pull(feed.table_stream(spark, path, max_files=1), target, ["v"], clock=lambda: 500)
    assert rows(got.select("id", "v")) == [(1, "a"), (2, "B"), (3, "c")]
    assert got.agg(F.max("pull_time")).first()[0] == 501  # two batches in one second


def test_a_silent_host_expires_without_a_further_beat(spark, tmp_path):
    path, out, state = str(tmp_path / "beats"), str(tmp_path / "out"), str(tmp_path / "state")

    def beat(*pairs):
        spark.createDataFrame([(h, s) for h, s in pairs], "host string, s long").selectExpr("host", "timestamp_seconds(s) ts").coalesce(1).write.mode("append").parquet(path)
        stream = feed.expiry_stream(feed.table_stream(spark, path, max_files=1), "host", "ts", 60, "10 seconds")
        got = feed.drain_to_table(stream, "expiry-test", out, state)
        return rows(got.selectExpr("host_id", "unix_seconds(up_from)", "unix_seconds(last_seen)", "unix_seconds(expired_at)"))

    assert beat(("a", 0), ("b", 0), ("a", 50), ("b", 59), ("a", 109)) == []
    assert beat(("a", 128)) == []  # b may still come, up to ten seconds late
    lost = [("b", 0, 59, 119)]
    assert beat(("a", 129)) == lost
    assert beat(("b", 189), ("a", 189)) == lost  # exactly sixty seconds: a was lost at 189
    assert beat(("a", 199)) == sorted(lost + [("a", 0, 129, 189)], key=repr)
    assert beat(("c", 9999)) == sorted(lost + [("a", 0, 129, 189), ("a", 189, 199, 259), ("b", 189, 189, 249)], key=repr)


def test_liveness_over_batches(spark, tmp_path):
    path = str(tmp_path / "beats")
    for lo in (0, 50):
        spark.range(lo, lo + 50).selectExpr("id % 5 host", "timestamp_seconds(id) ts").coalesce(1).write.mode("append").parquet(path)
    got = feed.liveness_stream(feed.table_stream(spark, path, max_files=1), "host", "ts", "beats-test")
    assert rows(got.selectExpr("host_id", "unix_seconds(last_seen)")) == [(i, 95 + i) for i in range(5)]


def _pushed(spark, path, *rows_):
    KeyedTable(spark, path).merge(spark.createDataFrame(list(rows_), "k int, v string"))
    return KeyedTable(spark, path, ["k"])


def test_push_on_change_runs_named_specs_only(spark, tmp_path):
    path = str(tmp_path / "changes")
    spark.createDataFrame([("w:a", 1), ("w:other", 2)], "message string, change_id int").coalesce(1).write.parquet(path)
    specs = [PushSpec(s, "t", "", key_columns=("k",)) for s in ("a", "b")]
    data = {s: spark.createDataFrame([(1, v, 5)], "k int, v string, pull_time long") for s, v in (("a", "new"), ("b", "wrong"))}
    target = _pushed(spark, str(tmp_path / "t"), (1, "old"), (2, "kept"))
    got = jobs.push_on_change(feed.table_stream(spark, path), specs, lambda s: data[s.source_table], target)
    assert rows(got) == [(1, "new"), (2, "kept")]
    assert rows(push(specs[0], data["a"].drop("pull_time"), got)) == rows(got)


def test_push_on_change_sends_what_lies_beyond_the_cursor(spark, tmp_path):
    path, state = str(tmp_path / "changes"), str(tmp_path / "state")
    schema = "k int, v string, pull_time long"
    data = {"a": [(1, "a", 1), (2, "a", 1)], "b": [(1, "b", 1)]}
    specs = [PushSpec(s, "t", "", key_columns=("k",)) for s in ("a", "b")]
    target = _pushed(spark, str(tmp_path / "t"), (1, "old"), (3, "kept"))

    def run(*tables, checkpoint=state):
        if tables:
            spark.createDataFrame([(f"w:{m}",) for m in tables], "message string").coalesce(1).write.mode("append").parquet(path)
        stream = feed.table_stream(spark, path)
        return rows(jobs.push_on_change(stream, specs, lambda s: spark.createDataFrame(data[s.source_table], schema), target, checkpoint=checkpoint))

    assert run("b", "a") == [(1, "b"), (2, "a"), (3, "kept")]  # the later spec wins within a batch
    data["a"] += [(2, "new", 2), (4, "new", 2)]
    before = target.version()
    assert run("a") == [(1, "b"), (2, "new"), (3, "kept"), (4, "new")]
    assert sum(n for f, (n, _) in target.version().folders.items() if f not in before.folders) == 2  # not the whole source
    number = target.version().number
    assert len(run("a")) == 4 and len(run(checkpoint=str(tmp_path / "lost"))) == 4 and target.version().number == number
    with pytest.raises(ValueError):
        jobs.push_on_change(feed.table_stream(spark, path), [PushSpec("a", "t", "")], lambda s: None, target)


def test_pending_changes_are_those_of_others_beyond_the_cursor(spark):
    log = [("t", o, i) for i, o in enumerate([1, 2, 1, 3, 1, 1])] + [("u", 1, 9)]
    cursors = [(1, 2), (2, -1), (3, 99), (4, 3)]
    got = feed.pending(spark.createDataFrame(log, "message string, origin long, offset long"), spark.createDataFrame(cursors, "receiver long, cursor long"))
    want = []
    for r, c in cursors:
        for m in "tu":
            others = [i for n, o, i in log if n == m and o != r]
            if others:
                left = [i for i in others if i > c]
                want.append((r, m, len(left), max(left, default=None)))
    assert rows(got) == sorted(want, key=repr)


def test_write_with_watermark(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (5, None)], "id int, ts timestamp")
    state = (FilterCondition("id", "integer", "0"), FilterCondition("ts", "datetime", "2020-01-01"))
    count, moved = sinks.write_with_watermark(df, str(tmp_path / "t"), state)
    assert count == 2 and moved == (FilterCondition("id", "integer", "5"), state[1])


def test_write_split_casts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "5"), (2, "x")], "id int, a string")
    good, bad = sinks.write_split(conform.cast_table(df, {"a": "int8"}, ["id"]), str(tmp_path / "t"))
    assert rows(good) == [(1, 5)]
    assert rows(conform.rejected_values(bad, ["id"])) == [(2, "a", "not a number")]


def test_streams_without_input(spark, tmp_path):
    path = str(tmp_path / "nothing")
    spark.createDataFrame([], "id int, v string, message string, ts timestamp").write.parquet(path)
    assert feed.drain_to_table(feed.table_stream(spark, path), "none").count() == 0
    assert feed.liveness_stream(feed.table_stream(spark, path), "id", "ts", "none").count() == 0
    existing = spark.createDataFrame([(1, "a", 0)], "id int, v string, pull_time bigint")
    stream = feed.table_stream(spark, path).select("id", "v")
    target = KeyedTable(spark, str(tmp_path / "target"), ["id"])
    target.merge(existing.withColumn("pull_time", F.col("pull_time").cast("bigint")))
    assert rows(jobs.scheduled_pull(stream, target, ["v"])) == [(1, "a", 0)]
    assert rows(jobs.push_on_change(feed.table_stream(spark, path), [PushSpec("a", "t", "", key_columns=("id",))], lambda s: existing, target)) == [(1, "a", 0)]


def test_streams_over_an_empty_folder(spark, tmp_path):
    path = tmp_path / "empty"
    path.mkdir()
    stream = spark.readStream.schema("id int, v string").parquet(str(path))
    assert feed.drain_to_table(stream, "void").count() == 0
    assert jobs.scheduled_pull(stream, KeyedTable(spark, str(tmp_path / "void"), ["id"]), ["v"]).columns == ["id", "v", "pull_time"]


@pytest.mark.parametrize(
    "sql, error",
    [("select 1 from t where x drop table t", "unsafe"), ("select 1 -- c", "unsafe"), ("select 1", "no table"),
     ("select * from select", "reserved"), ("select * from `select`", None), ("select id from checked_t where id > ?", None)],
)
def test_statements_are_checked_before_they_run(spark, sql, error):
    from tidebarge.sources.tables import check_select

    if error is None:
        check_select(spark, sql)
        return
    with pytest.raises(ValueError, match=error):
        run_select(spark, sql)


def test_run_select_binds_in_order(spark):
    got = run_select(
        spark, "select id from checked_t where id >= ? and id < ?",
        [FilterCondition("id", "integer", "3"), FilterCondition("id", "integer", "5")], {"checked_t": spark.range(9)})
    assert rows(got) == [(3,), (4,)]


def test_a_scheduled_pull_goes_on_where_it_stopped(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    target, now = KeyedTable(spark, str(tmp_path / "out"), ["k"]), [1000]
    spark.createDataFrame([(1, "a"), (2, "a"), (None, "lost")], "k int, v string").write.parquet(source)

    def run():
        stream = feed.table_stream(spark, source + "/")
        return rows(jobs.scheduled_pull(stream, target, ["v"], checkpoint=state, clock=lambda: now[0]))

    assert run() == [(1, "a", 1000), (2, "a", 1000)]
    version, now[0] = target.version().number, 4600
    assert run() == [(1, "a", 1000), (2, "a", 1000)] and target.version().number == version  # nothing new, nothing written
    spark.createDataFrame([(2, "b")], "k int, v string").write.mode("append").parquet(source)
    assert run() == [(1, "a", 1000), (2, "b", 4600)] and target.rejects().count() == 1
    log = [(v.number, list(v.runs.values())[0]["note"]) for v in target.history()]
    assert [note for _, note in log] == ["1000", "4600"]


def test_a_replayed_batch_keeps_its_stamp(spark, tmp_path):
    """The stream's own state is lost after the commit: the batch comes again and is not applied again."""
    source = str(tmp_path / "in")
    target, now = KeyedTable(spark, str(tmp_path / "out"), ["k"]), [1000]
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(source)
    for attempt in ("state", "state-lost"):
        got = jobs.scheduled_pull(feed.table_stream(spark, source), target, ["v"], checkpoint=str(tmp_path / attempt), clock=lambda: now[0])
        assert rows(got) == [(1, "a", 1000)]
        now[0] += 3600


def test_columns_in_the_types_that_drivers_deliver(spark):
    df = spark.createDataFrame([(True, bytearray(b"\x01\x02"), "POLYGON((0 0,1 1,0 1,0 0))", 2)], "a boolean, b binary, g string, e tinyint")
    got = normalize.normalize_pull(df, [Col("a", "bit"), Col("b", "bit"), Col("g", "polygon")]).first()
    assert tuple(got) == ("1", "100000010", "POLYGON((0 0,1 1,0 1,0 0))")
    assert normalize.normalize_push(df, [Col("e", "Enum8", labels=((1, "low"), (2, "high")))]).first()[0] == "high"
