"""Equi-depth ranges of a key."""

import datetime as dt
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebarge.sources import ranges


def sizes(df, columns, cuts):
    return [r[1] for r in rows(df.groupBy(ranges.range_of(columns, cuts).alias("i")).count())]


@pytest.mark.parametrize("parts", [2, 8, 31])
def test_ranges_of_a_skewed_key_are_even(spark, parts):
    """A third of the rows has one key, a tenth has none, the rest crowds at one end."""
    df = spark.range(60_000).repartition(9).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise((F.rand(3) ** 6 * 1e9).cast("int")).cast("long").alias("k"), "id"
    )
    cuts = ranges.equi_depth_bounds(df, ["k", "id"], parts)
    got = sizes(df, ["k", "id"], cuts)
    assert len(got) == parts and sum(got) == 60_000 and max(got) <= 1.1 * min(got)


def test_a_task_with_more_rows_than_it_sorts_at_a_time(spark):
    df = spark.range(2 * ranges.CHUNK + 5, numPartitions=1)
    got = sizes(df, ["id"], ranges.equi_depth_bounds(df, ["id"], 4))
    assert len(got) == 4 and sum(got) == 2 * ranges.CHUNK + 5 and max(got) <= 1.1 * min(got)


def test_one_value_cannot_be_cut(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(i,) for i in range(2, 12)], "k int")
    cuts = ranges.equi_depth_bounds(df, ["k"], 4)
    assert cuts and sum(sizes(df, ["k"], cuts)) == 100 and sizes(df, ["k"], cuts)[0] == 90
    assert ranges.equi_depth_bounds(df.limit(0), ["k"], 4) == [] and ranges.range_predicates(["k"], []) == ["1 = 1"]


value = st.one_of(st.none(), st.integers(-3, 3))
keys = st.tuples(value, value)


@settings(max_examples=100, deadline=None)
@given(st.lists(keys, min_size=1, max_size=60), st.integers(1, 7))
def test_a_summary_keeps_every_row_and_the_order(given_keys, parts):
    table = pa.table({"a": pa.array([k[0] for k in given_keys], pa.int64()), "b": pa.array([k[1] for k in given_keys], pa.int64()),
                      ranges._WEIGHT: pa.array([1] * len(given_keys), pa.int64())})
    for most in (3, 100):
        points = ranges.compress(table, most)
        assert sum(points.column(ranges._WEIGHT).to_pylist()) == len(given_keys) and len(points) <= most
    order = lambda k: tuple((x is not None, x or 0) for x in k)
    cuts = ranges.bounds(points, parts)
    assert cuts == sorted(cuts, key=order) and len(set(cuts)) == len(cuts) < parts + (parts == 0)
    whole = ranges.compress(table, len(given_keys))
    assert [tuple(r[c] for c in "ab") for r in whole.to_pylist()] == sorted(set(given_keys), key=order) or len(set(given_keys)) < len(whole)


def test_every_row_is_in_one_range(spark):
    some = [None, -1, 0, 1, 2]
    df = spark.createDataFrame([(a, b) for a in some for b in some], "a int, b int")
    order = lambda k: tuple((x is not None, x or 0) for x in k)
    every = sorted(((a, b) for a in some for b in some), key=order)
    for cuts in random.Random(4).sample([[every[i], every[j]] for i in range(24) for j in range(i + 1, 24)], 12):
        clauses = ranges.range_predicates(["a", "b"], cuts)
        hits = sum(F.when(F.expr(p), 1).otherwise(0) for p in clauses)
        at = df.select("a", "b", hits.alias("hits"), ranges.range_of(["a", "b"], cuts).alias("i")).collect()
        assert all(r.hits == 1 for r in at)
        assert all(r.i == sum(order((r.a, r.b)) > order(c) for c in cuts) for r in at)


def test_literals():
    got = [ranges.sql_literal(v) for v in (1, True, Decimal("1.50"), "it's", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6))]
    assert got == ["1", "true", "1.50", "'it''s'", "date '2024-01-02'", "timestamp '2024-01-02 03:04:05.000006'"]
    with pytest.raises(TypeError):
        ranges.sql_literal(b"x")


def test_footers_where_they_suffice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sorted files")
    spark.range(40_000).selectExpr("case when id > 30 then id end k").repartitionByRange(100, "k").write.parquet(path)
    monkeypatch.setattr(ranges, "summary", lambda *_: pytest.fail("a column was read"))
    cuts = ranges.parquet_bounds(spark, path, ["k"], 4)
    got = sizes(spark.read.parquet(path), ["k"], cuts)
    assert len(got) == 4 and sum(got) == 40_000 and max(got) <= 1.1 * min(got)
    monkeypatch.undo()
    mixed = str(tmp_path / "mixed")
    spark.range(40_000).selectExpr("id k").repartition(100).write.parquet(mixed)
    assert ranges.footer_points(spark, mixed, "k") is None
    got = sizes(spark.read.parquet(mixed), ["k"], ranges.parquet_bounds(spark, mixed, ["k"], 4))
    assert len(got) == 4 and max(got) <= 1.1 * min(got)
