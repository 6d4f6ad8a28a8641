"""Positions and request windows when one group holds most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebarge.operators import numbering, ranked, relations, requests
from tidebarge.streaming import bursts, feed


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(1)
    data = [(7 if r.random() < 0.6 else r.randrange(40), r.randrange(500), i) for i in range(4000)]
    return data, spark.createDataFrame(data, "g int, t int, id int")


def test_positions_over_many_slices(skewed):
    data, df = skewed
    got = numbering.page_numbers(df, [F.col("t").desc(), F.col("id")], 30, slices=9)
    want = sorted(data, key=lambda x: (-x[1], x[2]))
    assert [(r.id, r.position, r.page) for r in got.orderBy("position").collect()] == [
        (x[2], i + 1, i // 30 + 1) for i, x in enumerate(want)
    ]


def test_group_positions_of_a_group_in_many_slices(skewed):
    data, df = skewed
    got = numbering.with_group_position(df, ["g"], [F.col("t"), F.col("id")], "n", slices=11)
    counts, want = {}, set()
    for g, t, i in sorted(data):
        counts[g] = counts.get(g, 0) + 1
        want.add((g, t, i, counts[g]))
    assert {tuple(r) for r in got.collect()} == want


def test_null_group_is_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "g int, id int")
    got = numbering.with_group_position(df, ["g"], [F.col("id")], "n", slices=3)
    assert rows(got.select("id", "n")) == [(1, 1), (2, 2), (3, 1)]


def test_sequence_goes_on(spark):
    old = spark.createDataFrame([("a", 1, 4)], "g string, id int, seq bigint")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("b", 4)], "g string, id int")
    assert rows(numbering.group_sequence(new, old, "g", [F.col("id")], "seq")) == [("a", 2, 5), ("a", 3, 6), ("b", 4, 1)]


def test_page_out_of_range(spark):
    numbered = numbering.page_numbers(spark.range(5), [F.col("id")], 2)
    assert rows(numbering.fetch_page(numbered, 3, 3).select("id")) == [(4,)]
    with pytest.raises(IndexError):
        numbering.fetch_page(numbered, 4, 3)


def test_first_gap(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x", 4), ("y", 2), ("y", 3)], "g string, id int")
    assert rows(relations.first_gap(df, "id", ["g"])) == [("x", 3), ("y", 1)]
    assert relations.first_gap(df.where("id > 9"), "id").first()[0] == 1


# --- request windows -----------------------------------------------------------------


def brute(times, window, limit):
    passed, start, count = [], None, 0
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        passed.append(count < limit)
        count += count < limit
    return passed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 80), st.integers(1, 5), st.integers(1, 6))
def test_chained_slices_equal_one_fold(times, window, limit, cuts):
    t = np.array(sorted(times), dtype=np.int64)
    whole, *_ = requests.mark_requests(t, None, 0, window, limit)
    assert whole.tolist() == brute(t.tolist(), window, limit)
    start, count, got = None, 0, []
    for part in np.array_split(t, cuts):
        if len(part) == 0:
            continue
        passed, _, after, after_count = requests.mark_requests(part, start, count, window, limit)
        got += passed.tolist()
        upto, exit_start, exit_count = requests.step_function(part, window, limit)
        at = 0 if start is None else int(np.searchsorted(upto, start + window, side="left"))
        if at == len(upto):
            predicted = (start, min(limit, count + len(part)))
        else:
            predicted = (int(exit_start[at]), int(exit_count[at]))
        assert predicted == (after, after_count)
        start, count = after, after_count
    assert got == whole.tolist()


def described(part, window, limit):
    upto, exit_start, exit_count = requests.step_function(part, window, limit)
    return pd.DataFrame({"upto": np.append(upto, requests._END), "exit_start": np.append(exit_start, -1),
                         "exit_count": np.append(exit_count, -1), "n": len(part), "first": part[0]})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=2, max_size=50), st.integers(1, 80), st.integers(1, 5), st.integers(2, 7), st.booleans())
def test_composed_slices_equal_one_fold(times, window, limit, cuts, from_the_right):
    """Any order of composition, and any window that can be open before the first request."""
    t = np.array(sorted(times), dtype=np.int64)
    parts = [described(p, window, limit) for p in np.array_split(t, cuts) if len(p)]
    while len(parts) > 1:
        at = len(parts) - 2 if from_the_right else 0
        parts[at : at + 2] = [requests.compose(parts[at], parts[at + 1], window, limit)]
    whole = parts[0]
    assert len(whole) <= (t < t[0] + window).sum() + 2
    for start, count in [(s, c) for s in range(int(t[0]) - window, int(t[0]) + 1) for c in (1, limit)]:
        *_, want_start, want_count = requests.mark_requests(t, start, count, window, limit)
        row = whole.iloc[int(np.searchsorted(whole["upto"].to_numpy(), start + window, side="left"))]
        got = (start, min(limit, count + len(t))) if row["exit_start"] < 0 else (row["exit_start"], row["exit_count"])
        assert tuple(got) == (want_start, want_count)


def test_a_window_over_many_slices(spark):
    """One client, one window that all slices lie in, and one that a few span."""
    df = spark.range(4000).select("id", F.lit("hot").alias("client"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    for seconds in (60, 1):
        got = requests.burst_audit(df, "client", "ts", "id", limit=10, window_seconds=seconds, slices=16)
        assert got.where("allowed").count() == 10 * (4 // seconds or 1)


def test_burst_audit_with_one_client_across_slices(spark):
    r = random.Random(3)
    data = [(i, "hot" if r.random() < 0.6 else f"c{r.randrange(30)}", r.randrange(20_000)) for i in range(6000)]
    df = spark.createDataFrame(data, "id int, client string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = requests.burst_audit(df, "client", "ts", "id", limit=10, window_seconds=60, slices=13)
    by_client = {}
    for i, c, s in data:
        by_client.setdefault(c, []).append((s, i))
    want = set()
    for c, seen in by_client.items():
        seen.sort()
        want |= {(c, i, ok) for (s, i), ok in zip(seen, brute([s for s, _ in seen], 60, 10))}
    assert {(x.client, x.request_id, x.allowed) for x in got.collect()} == want


def test_burst_stream_over_several_batches(spark, tmp_path):
    data = [(i, "a" if i % 3 else "b", i * 7) for i in range(300)]
    df = spark.createDataFrame(data, "id int, client string, s int").withColumn("ts", F.timestamp_seconds("s"))
    path = str(tmp_path / "requests")
    for lo in range(0, 300, 100):
        df.where((F.col("id") >= lo) & (F.col("id") < lo + 100)).coalesce(1).write.mode("append").parquet(path)
    stream = feed.table_stream(spark, path, max_files=1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    got = bursts.burst_stream(stream, "client", "ts", "id", 10, 100, out, state)
    batch = requests.burst_audit(df, "client", "ts", "id", 10, 100)
    assert rows(got) == rows(batch)
    # a client that stops: its window goes from the state; the others go on from theirs
    later = [(300 + i, "a", 2100 + i * 7) for i in range(40)]
    spark.createDataFrame(later, "id int, client string, s int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    got = bursts.burst_stream(feed.table_stream(spark, path, max_files=1), "client", "ts", "id", 10, 100, out, state)
    everything = spark.read.parquet(path)
    assert rows(got) == rows(requests.burst_audit(everything, "client", "ts", "id", 10, 100))
    assert [r.client for r in bursts.open_now(spark, out, 2).orderBy("client").collect()] == ["a", "b"]
    assert [r.client for r in bursts.open_now(spark, out, 3).collect()] == ["a"]


def test_windows_carried_into_many_slices(spark):
    """Cut anywhere in time, two audits with the open windows between them equal one."""
    r = random.Random(8)
    data = sorted(((r.randrange(900), i, "hot" if r.random() < 0.6 else f"c{r.randrange(9)}") for i in range(1500)))
    df = spark.createDataFrame(data, "s int, id int, client string").withColumn("ts", F.timestamp_seconds("s"))
    whole = rows(requests.burst_audit(df, "client", "ts", "id", 5, 60))
    for cut in (200, 640):
        first = requests.burst_audit(df.where(F.col("s") < cut), "client", "ts", "id", 5, 60, slices=5).cache()
        between = requests.open_windows(first, None, 5, 60)
        second = requests.burst_audit(df.where(F.col("s") >= cut), "client", "ts", "id", 5, 60, slices=7, entering=between)
        assert rows(first.union(second)) == whole


def test_pages_of_a_ranked_table(spark, tmp_path):
    """Every page holds what ORDER BY, OFFSET, LIMIT gives; ties are settled by the order's last column."""
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 13).alias("t"), F.lit("x").alias("v")).repartition(5)
    order = [F.col("t").desc(), F.col("id")]
    want = [r.id for r in df.orderBy(*order).collect()]
    table = ranked.write_ranked(df, order, str(tmp_path / "list"), slices=9)
    assert table.total == 1000 and table.pages(30) == 34
    for index in (1, 2, 17, 33, 34):
        got = table.page(index, 30).collect()
        low = (index - 1) * 30
        assert [r.id for r in got] == want[low : low + 30] and [r.position for r in got] == list(range(low + 1, low + 1 + len(got)))
        assert {r.total for r in got} == {1000}
    assert [r.id for r in table.page(1, 5000).collect()] == want  # a page over all slices
    again = ranked.RankedTable(spark, str(tmp_path / "list"))
    assert again.page(40, 30, strict=False).count() == 0
    with pytest.raises(IndexError):
        again.page(35, 30)


def test_a_page_reads_its_slice_only(spark, tmp_path):
    table = ranked.write_ranked(spark.range(10_000), [F.col("id")], str(tmp_path / "list"), slices=20)
    page = table.page(5_000 // 10, 10)
    assert [r.id for r in page.collect()] == list(range(4990, 5000))
    assert len({r[0] for r in page.select(F.input_file_name()).collect()}) == 1
    empty = ranked.write_ranked(spark.range(0), [F.col("id")], str(tmp_path / "none"))
    assert empty.total == 0 and empty.page(1, 10).collect() == []
