from conftest import rows
from pyspark.sql import functions as F

from tidebarge.operators import versions
from tidebarge.plans import movement
from tidebarge.plans.specs import FilterCondition, PullSpec, PushSpec, conditions_from_json, conditions_to_json

VERSIONS = [(1, 10), (1, 20), (2, 5), (2, 5), (3, 7), (None, 1), (None, 2)]


def frame(spark, data=VERSIONS):
    return spark.createDataFrame(data, "k int, pull_time bigint")


def test_drop_oldest_removes_ties_and_keeps_null_keys(spark):
    got = versions.drop_oldest_version(frame(spark), ["k"])
    assert rows(got) == rows(frame(spark, [(1, 20), (3, 7), (None, 1), (None, 2)]))


def test_drop_oldest_leaves_two_of_three(spark):
    got = versions.drop_oldest_version(frame(spark, [(1, 1), (1, 2), (1, 3)]), ["k"])
    assert rows(got) == [(1, 2), (1, 3)]


def test_latest_version_is_one_row_per_key(spark):
    got = versions.latest_version(frame(spark), ["k"])
    assert rows(got) == rows(frame(spark, [(1, 20), (2, 5), (3, 7), (None, 2)]))


def test_latest_version_prunes_before_the_shuffle(spark):
    plan = versions.latest_version(frame(spark), ["k"])._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < partial  # below the exchange in the tree


def test_duplicate_keys(spark):
    assert rows(versions.duplicate_keys(frame(spark), ["k"])) == rows(
        spark.createDataFrame([(1, 2), (2, 2), (None, 2)], "k int, versions bigint")
    )


STATE = (FilterCondition("id", "integer", "5"), FilterCondition("name", "string", "old"))


def test_watermark_advances_per_column_and_survives_empty_input(spark):
    df = spark.createDataFrame([(7, "b"), (9, "a")], "id int, name string")
    text = versions.advance_watermark(df, STATE).first()[0]
    assert conditions_from_json(text) == (FilterCondition("id", "integer", "9"), FilterCondition("name", "string", "b"))
    kept = versions.advance_watermark(df.where("id > 100"), STATE).first()[0]
    assert conditions_from_json(kept) == STATE
    holes = spark.createDataFrame([(None, None)], "id int, name string")
    assert conditions_from_json(versions.advance_watermark(holes, STATE).first()[0]) == STATE


def test_condition_json_round_trip():
    assert conditions_from_json(conditions_to_json(STATE)) == STATE
    assert conditions_from_json("") == ()


SPEC = PullSpec("t", "", (FilterCondition("ts", "integer", "0"),), ("k",), ("ts",))


def load(spark, data):
    return spark.createDataFrame(data, "k int, ts int, v string")


def test_pull_twice_equals_pull_once(spark):
    batch = load(spark, [(1, 1, "a"), (2, 2, "b"), (2, 3, "c")])
    once = movement.pull(SPEC, batch, None, 100).target
    twice = movement.pull(SPEC, batch, once, 200).target
    assert rows(once.drop("pull_time")) == rows(twice.drop("pull_time")) == [(1, 1, "a"), (2, 3, "c")]


def test_pull_result(spark):
    old = movement.pull(SPEC, load(spark, [(1, 1, "a"), (2, 2, "b")]), None, 100).target
    done = movement.pull(SPEC, load(spark, [(2, 5, "B"), (3, 4, "c")]), old, 200)
    assert rows(done.target) == [(1, 1, "a", 100), (2, 5, "B", 200), (3, 4, "c", 200)]
    assert done.moved.first()[0] == 2
    assert conditions_from_json(done.watermark.first()[0])[0].value == "5"


def test_pull_with_oldest_dedup(spark):
    old = load(spark, [(1, 1, "a"), (2, 2, "b")]).withColumn("pull_time", F.lit(100).cast("bigint"))
    done = movement.pull(SPEC, load(spark, [(2, 5, "B")]), old, 200, dedup="oldest")
    assert rows(done.target) == [(1, 1, "a", 100), (2, 5, "B", 200)]


def test_full_pull_replaces_everything(spark):
    done = movement.pull(PullSpec("t", ""), load(spark, [(9, 9, "z")]), load(spark, [(1, 1, "a")]), 5)
    assert rows(done.target) == [(9, 9, "z", 5)] and done.watermark is None


def test_push_replaces_whole_rows_and_is_idempotent(spark):
    spec = PushSpec("s", "t", "", key_columns=("k",), order_columns=("ts",))
    target = load(spark, [(1, 1, "a"), (2, 2, "b")])
    batch = load(spark, [(2, 5, None), (2, 4, "lost"), (3, 1, "c")])
    once = movement.push(spec, batch, target)
    assert rows(once) == rows(load(spark, [(1, 1, "a"), (2, 5, None), (3, 1, "c")]))
    assert rows(movement.push(spec, batch, once)) == rows(once)


def test_push_without_keys_replaces_the_table(spark):
    spec = PushSpec("s", "t", "", insert_columns=("k", "v"))
    got = movement.push(spec, load(spark, [(3, 1, "c")]), load(spark, [(1, 1, "a")]))
    assert rows(got) == [(3, "c")]


def test_key_integrity(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert tuple(movement.key_integrity(df, "t", ["k"]).first()) == ("t", 4, 1, 1, False)
    assert tuple(movement.key_integrity(df.where("k = 2"), "t", ["k"]).first()) == ("t", 1, 0, 0, True)
    assert tuple(movement.key_integrity(df.where("k > 5"), "t", ["k"]).first()) == ("t", 0, 0, 0, True)
