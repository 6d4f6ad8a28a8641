"""Whole pull and push jobs: repeated, dying and partly bad runs."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidebarge.plans import jobs
from tidebarge.plans.specs import FilterCondition, PullSpec, PushSpec
from tidebarge.session import fresh_path
from tidebarge.sinks.keyed import KeyedTable

SINCE = (FilterCondition("v", "integer", "0"),)


@pytest.fixture
def store(spark):
    return jobs.Store(spark, fresh_path(spark, "store"))


def source(spark, *pairs):
    frame = spark.createDataFrame(list(pairs), "k long, v long")

    def rows_of(spec):
        return frame.where(F.col("v") > int(spec.filter_val[0].value)) if spec.filter_val else frame

    return rows_of


def content(store, name="t"):
    return rows(store.table(name).select("k", "v"))


@pytest.mark.parametrize("state, keys", [((), ()), ((), ("k",)), (SINCE, ()), (SINCE, ("k",))])
def test_a_repeated_run_changes_nothing(spark, store, state, keys):
    """Full refresh or watermark, with and without keys."""
    spec = PullSpec("t", "", state, keys)
    for _ in range(2):
        assert jobs.run_pull_job(store, 1, [spec], source(spark, (1, 1), (2, 2)), 100)
        assert content(store) == [(1, 1), (2, 2)]
    for _ in range(2):
        assert jobs.run_pull_job(store, 1, [spec], source(spark, (2, 5), (3, 3)), 200)
    first = [(1, 1)] if state else []
    again = [(2, 2)] if state and not keys else []
    assert content(store) == sorted(first + again + [(2, 5), (3, 3)], key=repr)
    assert rows(store.logs().select("start_time", "record_count")) == [(100, 2), (200, 2)]
    assert rows(store.changes()) == [("warehouse:t", 100), ("warehouse:t", 200)]
    assert [(c.column, c.value) for c in store.keyed("t").state()] == ([("v", "5")] if state else [])
    # and a further run goes on from the watermark
    assert jobs.run_pull_job(store, 1, [spec], source(spark, (2, 5), (3, 3)), 300)
    assert len(content(store)) == len(first + again) + 2


def test_rows_that_cannot_be_placed_are_kept_and_the_others_move(spark, store):
    frame = spark.createDataFrame([("1", "7"), (None, "8"), ("x", "9"), ("4", "high")], "k string, v string")
    specs = [PullSpec("t", "", key_columns=("k",)), PullSpec("u", "", key_columns=("k",))]
    cast = {"t": {"k": "int64", "v": "int64"}}
    assert jobs.run_pull_job(store, 1, specs, lambda _: frame, 100, casts=cast)
    assert content(store) == [(1, 7)]
    assert rows(store.rejects("t").select("k", "v", "reason")) == sorted([
        (None, 8, "no key"), (None, 9, '[{"column":"k","reason":"not a number"}]'), (4, None, '[{"column":"v","reason":"not a number"}]')], key=repr)
    assert content(store, "u") == [("1", "7"), ("4", "high"), ("x", "9")] and store.rejects("u").count() == 1


def test_a_job_that_dies_before_its_logs_is_done_again(spark, store, monkeypatch):
    spec = PullSpec("t", "", SINCE, ("k",))
    written = jobs.Store._put

    def die(self, name, *rest):
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs.Store, "_put", die)
    with pytest.raises(RuntimeError):
        jobs.run_pull_job(store, 1, [spec], source(spark, (1, 1)), 100)
    monkeypatch.setattr(jobs.Store, "_put", written)
    version = store.keyed("t").version().number
    assert jobs.run_pull_job(store, 1, [spec], source(spark, (1, 1)), 100)
    assert store.keyed("t").version().number == version and rows(store.logs().select("record_count")) == [(1,)]


def test_a_failed_table_is_logged_and_the_others_go_on(spark, store):
    def rows_of(spec):
        if spec.dest_table == "bad":
            raise ValueError("no such column\nmore")
        return spark.range(3).select(F.col("id").alias("k"), F.col("id").alias("v"))

    specs = [PullSpec("t", ""), PullSpec("bad", ""), PullSpec("off", "", enabled=False)]
    assert not jobs.run_pull_job(store, 1, specs, rows_of, 100)
    assert rows(store.logs().select("table_id", "status", "error_info", "record_count")) == [(1, "completed", "", 3), (2, "failed", "no such column", 0)]
    assert jobs.run_pull_job(store, 1, specs, rows_of, 3600 * 5, skip_hours=[5]) and store.logs().count() == 2


def test_a_push_sends_what_is_new_in_its_order(spark, store):
    frame = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 2, 10), (2, "a", 1, 10)], "k long, v string, seq int, pull_time long")
    more = frame.union(spark.createDataFrame([(1, "c", 0, 20), (3, "d", 0, 20)], frame.schema))
    spec = PushSpec("s", "t", "", key_columns=("k",), order_columns=("seq",), insert_columns=("k", "v"))
    for df, now in ((frame, 15), (frame, 15), (more, 25), (more, 25)):
        assert jobs.run_push_job(store, 1, [spec], lambda _, df=df: df, now)
    assert content(store) == [(1, "c"), (2, "a"), (3, "d")]
    assert rows(store.logs().select("start_time", "record_count")) == [(15, 3), (25, 2)]
    whole = PushSpec("s", "w", "")
    for df, now in ((frame, 15), (more, 25), (more, 25)):
        assert jobs.run_push_job(store, 2, [whole], lambda _, df=df: df, now)
    assert KeyedTable(spark, f"{store.root}/tables/w").read().count() == 5
