"""The merge-on-read table: contents, sizes of what is written, runs that die, replays."""

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebarge.plans.specs import FilterCondition
from tidebarge.session import fresh_path
from tidebarge.sinks import keyed
from tidebarge.sinks.keyed import CommitConflict, KeyedTable, Run


def table(spark, *keys):
    return KeyedTable(spark, fresh_path(spark, "keyed table"), keys or ("k",))


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def written(spark, t, kind):
    return {n: spark.read.parquet(f"{t.root}/{kind}/{n}").count() for n in t._names(kind)}


def test_a_batch_writes_its_rows_only(spark):
    t = table(spark)
    assert t.merge(spark.range(50_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))) == 50_000
    before = set(t._names("data"))
    assert t.merge(frame(spark, (7, "new"), (60_000, "new"), (8, "a"), (8, "b")), ["v"]) == 4
    sizes = written(spark, t, "data")
    assert [n for f, n in sizes.items() if f not in before] == [3] and sum(written(spark, t, "deletes").values()) == 2
    got = t.read()
    assert got.count() == t.version().rows == 50_001
    assert rows(got.where("v <> 'old'")) == [(60_000, "new"), (7, "new"), (8, "b")]


def test_reads_keys_in_range_only(spark):
    t = table(spark)
    t.merge(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    plan = t._live(t.version(), t.version().folders).where(F.col("k").between(3, 5)).select("k", "__row")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in text and "v:string" not in text and "Exchange" not in text


@pytest.mark.parametrize("at", ["data", "rejects", "deletes", "version"])
def test_a_run_that_dies_leaves_old_or_new(spark, at):
    t = table(spark)
    state = (FilterCondition("k", "integer", "0"),)
    t.merge(frame(spark, (1, "a"), (2, "b")), state=state, run=Run("job", 1))

    def die(step):
        if step == at:
            raise RuntimeError("lost")

    batch = frame(spark, (2, "c"), (9, "d"), (None, "e"))
    with pytest.raises(RuntimeError):
        t.merge(batch, run=Run("job", 2), step=die)
    old, new = [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (9, "d")]
    assert rows(t.read()) == (new if at == "version" else old)
    assert t.state()[0].value == ("9" if at == "version" else "2")
    assert t.merge(batch, run=Run("job", 2)) == 3
    assert rows(t.read()) == new and rows(t.rejects()) == [(None, "e", "no key")] and t.state()[0].value == "9"
    assert t.vacuum(keep=1, older_than=-60) >= (at != "version") and rows(t.read()) == new


def test_repeated_runs_and_empty_batches(spark):
    t = table(spark)
    assert t.merge(frame(spark), run=Run("job", 1)) == 0 and t.read().count() == 0
    assert t.merge(frame(spark, (1, "a")), run=Run("job", 2)) == 1
    number = t.version().number
    assert t.merge(frame(spark, (1, "z")), run=Run("job", 2)) == 1  # the first result, not a second merge
    assert t.merge(frame(spark)) == 0 and t.version().number == number
    assert rows(t.read()) == [(1, "a")]
    assert t.merge(frame(spark, (1, "y")), run=Run("other", 1)) == 1 and rows(t.read()) == [(1, "y")]


def test_only_one_of_two_writers_wins(spark):
    t = table(spark)
    t.merge(frame(spark, (1, "a")))
    stale = t.version()
    t.merge(frame(spark, (2, "b")))
    with pytest.raises(CommitConflict):
        t._publish(t._next(stale, None, 0))
    assert rows(t.read()) == [(1, "a"), (2, "b")]


def test_watermark_goes_up_only_and_by_type(spark):
    t = table(spark)
    state = (FilterCondition("k", "integer", "9"),)
    t.merge(frame(spark, (5, "a")), state=state)
    assert t.state()[0].value == "9"
    t.merge(frame(spark, (10, "a"), (None, "zzz")))
    assert t.state()[0].value == "10"


def test_rows_added_without_keys_and_replaced(spark):
    t = KeyedTable(spark, fresh_path(spark, "added"))
    t.merge(frame(spark, (1, "a"), (None, "b")), run=Run("j", 1))
    t.merge(frame(spark, (1, "a")), run=Run("j", 2))
    assert rows(t.read()) == [(1, "a"), (1, "a"), (None, "b")]
    old = t.version()
    assert t.merge(spark.range(2), run=Run("j", 3), whole=True) == 2 == t.merge(spark.range(9), run=Run("j", 3), whole=True)
    assert rows(t.read()) == [(0,), (1,)] and t.read(old).count() == 3
    with pytest.raises(ValueError):
        t.merge(frame(spark, (1, "a")))


def test_compaction_keeps_rows(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_FOLDERS", 3)
    t = table(spark)
    want = {}
    for i in range(6):
        batch = {k: f"{i}" for k in range(i * 3, 40 if not i else i * 3 + 5)}
        t.merge(frame(spark, *batch.items()))
        want |= batch
    assert len(t.version().folders) <= 4 and dict(rows(t.read())) == want
    assert all(set(of) <= set(t.version().folders) for of in t.version().deletes.values())


batches = st.lists(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.integers(0, 3), st.sampled_from("xyz")), max_size=8), max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches)
def test_as_a_dictionary(spark, given_batches):
    """Two key columns; the table is what a dictionary would hold."""
    t, want, lost = table(spark, "a", "b"), {}, 0
    for i, batch in enumerate(given_batches):
        made = [(a, b, f"{i}{v}") for a, b, v in batch]
        t.merge(spark.createDataFrame(made, "a long, b long, v string"), ["v"])
        lost += sum(a is None for a, *_ in made)
        want |= {(a, b): v for a, b, v in sorted(made, key=repr) if a is not None}
    if given_batches:
        assert {(a, b): v for a, b, v in rows(t.read())} == want and t.read().count() == len(want)
        assert t.rejects().count() == lost
