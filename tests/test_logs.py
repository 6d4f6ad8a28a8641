"""Run logs, retention, joins, requests and audits on literal frames."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidebarge.operators import filters, governance, profile, relations, requests, retention, runlog, versions


def test_fold_is_idempotent(spark):
    events = spark.createDataFrame(
        [(1, 10, None, None, None), (1, 10, 15, "", 3), (1, 20, None, None, None), (1, 30, None, None, None), (1, 30, 31, "bad", 0)],
        "job_id int, start_time bigint, stop_time bigint, error_info string, record_count bigint")
    want = [(1, 10, 15, "", 3, "completed"), (1, 20, None, None, None, "running"), (1, 30, 31, "bad", 0, "failed")]
    assert rows(runlog.fold_run_events(events, ["job_id"])) == sorted(want, key=repr)
    assert rows(runlog.fold_run_events(events.unionByName(events), ["job_id"])) == sorted(want, key=repr)


def test_last_run_and_info(spark):
    owners = spark.createDataFrame([(1, 10), (2, 99), (3, 0), (4, 20)], "job_id int, last_run bigint")
    logs = spark.createDataFrame([(1, 10, "failed", "x"), (4, 20, "completed", "")], "job_id int, start_time bigint, status string, error_info string")
    seen = relations.last_run(owners, logs, ["job_id"])
    assert rows(runlog.run_info(seen).select("job_id", "run_info")) == [
        (1, "[1970-01-01 00:00:10]failed:x"), (2, ""), (3, ""), (4, "[1970-01-01 00:00:20]completed")]


def test_stuck_runs(spark):
    logs = spark.createDataFrame([(1, 0, "running"), (2, 95, "running"), (3, 0, "failed")], "job_id int, start_time bigint, status string")
    assert rows(runlog.stuck_runs(logs, 100, 50)) == [(1, 0, "running", 100)]


LOGS = "job_id int, start_time bigint"


def test_retention(spark):
    logs = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (2, 2)], LOGS)
    assert rows(retention.keep_latest(logs, ["job_id"])) == [(1, 3), (2, 2), (2, 2)]
    assert rows(retention.delete_one(logs, {"job_id": 1, "start_time": 1})) == [(1, 3), (2, 2), (2, 2)]
    left = retention.cascade_delete(spark.createDataFrame([(2,)], "job_id int"), ["job_id"], logs=logs, jobs=logs.select("job_id").distinct())
    assert rows(left["logs"]) == [(1, 1), (1, 3)] and rows(left["jobs"]) == [(1,)]


def test_keep_n_dates_counts_dates_present(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), ("2024-01-05",), ("2024-02-01",)], "log_date string")
    assert rows(retention.keep_n_dates(df, 2)) == [("2024-01-05",), ("2024-01-05",), ("2024-02-01",)]


def test_delete_one_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (1, 1)], "user_id int, log_id int")
    assert rows(retention.clear_user_log(df, 1)) == [(None, 1)]


def test_relations(spark):
    cols = spark.createDataFrame([("s", "t", "a"), ("s", "t", "b")], "schema string, tab string, col string")
    keys = spark.createDataFrame([("s", "t", "a"), ("s", "t", "a")], "schema string, tab string, col string")
    assert rows(relations.key_columns(cols, keys, ["schema", "tab", "col"])) == [("s", "t", "a", "是"), ("s", "t", "b", "否")]
    plugins = spark.createDataFrame([("a", "", ""), ("b", "f", ""), ("c", "f", "h"), ("d", "f", "h")],
                                    "plugin_uuid string, plugin_file_name string, host_uuid string")
    reports = spark.createDataFrame([("d", "运行中")], "plugin_uuid string, reported_status string")
    assert [r.status for r in relations.status_overlay(plugins, reports).orderBy("plugin_uuid").collect()] == [
        "待上传", "待部署", "已失联", "运行中"]
    jobs = spark.createDataFrame([(1,), (2,)], "job_id int")
    assert rows(relations.tag_loaded(jobs, spark.createDataFrame([(2,), (2,)], "job_id int"), "job_id")) == [(1, "unloaded"), (2, "loaded")]
    assert rows(relations.with_sentinel(jobs, "job_id")) == [(0,), (1,), (2,)]


def test_status_filter_is_optional(spark):
    df = spark.createDataFrame([("a",), ("b",)], "status string")
    assert filters.with_status(df, None).count() == 2 and filters.with_status(df, "a").count() == 1


JSON = ['{"a":1}', '{"a":1}}', "1", "1,2", '"x"', "[1]", "1]", "1],[2", '1,"x":2', "{}", '{"a":1,"a":2}', "{'a':1}", "NaN", "01",
        "  ", "null", "true", "tru", '{"a":[1,{"b":null}]} ', '{"a":1} x', '"a\tb"', "-1.5e3", "1.", "[1,]", '{"a":1,}', '"\\x"', "/*c*/1", "1 // c"]


def test_json_check_agrees_with_a_second_parser(spark):
    def ok(text):
        try:
            json.loads(text, parse_constant=lambda v: 1 / 0)
            return True
        except Exception:
            return False

    df = spark.createDataFrame([(x, ok(x)) for x in JSON], "s string, want boolean")
    assert df.where(requests.is_json(F.col("s")) != F.col("want")).collect() == []
    body = df.select(requests.body_class(F.col("s")).alias("b")).collect()
    assert body[0].b == '{"a":1}' and body[1].b == requests.INVALID_JSON
    assert spark.range(1).select(requests.body_class(F.lit(""))).first()[0] == requests.EMPTY_BODY


def test_watermark_codec(spark):
    df = spark.createDataFrame([(1, '[{"column":"a","dataType":"integer","value":"5"}]'), (2, "[]"), (3, None)], "id int, filter_val string")
    df = df.unionByName(spark.createDataFrame([(4, "oops"), (5, '[{"value":"5"}]'), (6, " ")], df.schema))
    assert rows(versions.decode_watermarks(df)) == [
        (1, "a", "integer", "5", None), (2, None, None, None, "no conditions"), (3, None, None, None, "no state"),
        (4, None, None, None, "unreadable state"), (5, None, None, None, "unreadable state"), (6, None, None, None, "no state"),
    ]


def test_statement_checks(spark):
    samples = [("select 1 -- x", False, False), ("select a from t", True, True), ("drop table t", True, False),
               ("x drop table t", False, False), ("x DROP\nt", True, False), ("dropped updates", True, True), ("a /* b", False, False),
               ("overcreate x", True, True)]
    df = spark.createDataFrame([(s,) for s, *_ in samples], "s string")
    got = {r.s: (r.is_safe, r.is_safe_strict) for r in governance.sql_safety(df, "s").collect()}
    assert got == {s: (a, b) for s, a, b in samples}
    assert rows(governance.sql_safety_counts(df, "s")) == [("--", 1), ("/*", 1), ("drop", 1)]


@pytest.mark.parametrize(
    "sql, want",
    [("select * from a, b x, `c`.`d` where 1=1", ["a", "b"]), ("select * from a , b,c join d on 1=1 LEFT JOIN s.e", ["a", "b", "c", "d", "s.e"]),
     ("select * from (select * from inner1 join [i2] on 1) t", ["inner1", "[i2]"]), ("select 1 /* from z */ from y -- from x", ["y"]),
     ("select 1 from y -- from x\nwhere 1", ["y", "x"]), ("select 1", []), ('select * from "q"', ['"q"']), ("select 1 from a . b", ["a"])],
)
def test_table_names(spark, sql, want):
    got = spark.range(1).select(governance.table_names(F.lit(sql))).first()[0]
    assert got == want


def test_strict_comments(spark):
    sql = F.lit("select 1 from y -- from x\nwhere 1")
    assert spark.range(1).select(governance.table_names(sql, True)).first()[0] == ["y"]


def test_reserved_names(spark):
    df = spark.createDataFrame([("select",), ("`select`",), ("orders",)], "n string")
    want = [("`select`", False), ("orders", False), ("select", True)]
    assert rows(governance.reserved_names(df, "n")) == want
    words = spark.createDataFrame([("SELECT",), ("select",)], "word string")
    assert rows(governance.reserved_names(df, "n", words)) == want


def test_protect_round_trip(spark):
    df = spark.createDataFrame([("secret",), (None,)], "c string")
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    hidden = governance.protect(df, "c", key)
    assert rows(governance.reveal(hidden, "c", key)) == rows(df)
    assert rows(governance.reveal(hidden, "c", other)) == [(None,), (None,)]
    assert "secret" not in hidden.where("c is not null").first()[0]


def test_profile(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "é", 1.5)], "id bigint, name string, x double")
    got = {r.column_code: r for r in profile.column_profile(df, "t", ["id"]).collect()}
    assert (got["id"].is_key, got["id"].precision, got["name"].max_length, got["x"].null_count, got["x"].has_null) == (True, 19, 3, 1, True)
    df.createOrReplaceTempView("profiled_view")
    assert ("profiled_view", "") in rows(profile.catalog_inventory(spark))
