"""Exact row numbers over data of any size.

``row_number()`` over an unpartitioned window, or over one huge group, runs in a
single task. Here rows are range-partitioned on the full sort key instead, so a
hot group is spread over many slices. Each sorted slice is numbered in the pass that
fixes it (one shuffle, one checkpoint) and shifted by what the slices before it hold.
The table of shifts has one row per slice, so its broadcast is bounded by the slice count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, free_name, shuffle_width

_SLICE = "__slice"
_POS = "__pos"


def _sorted_slices(df: DataFrame, order_by: Sequence[Column], slices: int | None) -> DataFrame:
    n = slices or shuffle_width(df.sparkSession)
    return df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)


def _place() -> Column:
    """Row of its partition, from 0: the low 33 bits of the running id."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _names(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def slice_by_range(df: DataFrame, order_by: Sequence[Column], slices: int | None = None, at: str = _SLICE, place: str = _POS) -> DataFrame:
    """Sort ``df`` into range slices and fix them with a checkpoint; adds the slice id and position."""
    ranged = _sorted_slices(df, order_by, slices).select(*_names(df), F.spark_partition_id().alias(at), _place().alias(place))
    # slice ids must not change between the counting and the numbering pass
    return cut_lineage(ranged)


def with_position(
    df: DataFrame, order_by: Sequence[Column], name: str = "position", slices: int | None = None
) -> DataFrame:
    """1-based position of every row in the total order ``order_by``."""
    at, place, shift, n = (free_name(df, w, name) for w in ("slice", "pos", "shift", "n"))
    ranged = slice_by_range(df, order_by, slices, at, place)
    before = Window.partitionBy(F.lit(0)).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(at).agg(F.count(F.lit(1)).alias(n)).select(at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift))
    numbered = ranged.join(F.broadcast(shifts), at)  # one row per slice
    return numbered.select(*_names(df), (F.col(place) + F.col(shift) + F.lit(1)).alias(name))


def _same_as_before(values: pa.Array) -> np.ndarray:
    """For all but the first value: is it equal to the one before? Nulls are equal, as are NaNs."""
    a, b = values.slice(1), values.slice(0, len(values) - 1)
    if pa.types.is_nested(values.type):
        return np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist())], dtype=bool)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(values.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return same.to_numpy(zero_copy_only=False)


_RUN = T.StructType().add("seq", "long").add("first", "boolean")


@F.arrow_udf(_RUN)
def _restarting(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Running count over a sorted slice that starts again when the group changes, and whether the group is the slice's first."""
    last, seq, first = None, 0, True
    for batch in batches:
        n = len(batch)
        if not n:
            yield pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.bool_())], names=["seq", "first"])
            continue
        fields = batch.flatten()
        same = np.ones(n, dtype=bool)
        for i, values in enumerate(fields):
            if last is None:
                same[1:] &= _same_as_before(values)
            else:
                same &= _same_as_before(pa.concat_arrays([last[i], values]))
        starts = np.flatnonzero(~same)
        # place of the last start at or before each row; rows before any start go on from the batch before
        since = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        counts = np.where(since < 0, np.arange(n) + 1 + seq, np.arange(n) - since + 1)
        in_first = np.zeros(n, dtype=bool)
        if first:
            in_first[: starts[0] if len(starts) else n] = True
            first = not len(starts)
        yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(in_first)], names=["seq", "first"])
        last, seq = [f.slice(n - 1, 1) for f in fields], int(counts[-1])


def with_group_position(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[Column],
    name: str = "position",
    slices: int | None = None,
) -> DataFrame:
    """1-based position inside each group; a group may be larger than a task can sort.

    Only the first group of a slice can have begun in an earlier one: it is shifted by what the last groups of
    the slices before hold of it. No group is shuffled or sorted a second time.
    """
    keys = [F.col(f"`{g}`") for g in group]
    at, place, run, shift = (free_name(df, w, name) for w in ("slice", "pos", "run", "shift"))
    ranged = _sorted_slices(df, [*keys, *order_by], slices)
    fixed = cut_lineage(
        ranged.select(*_names(df), _restarting(F.struct(*keys)).alias(run), F.spark_partition_id().alias(at), _place().alias(place))
    )
    held = F.struct(*[k.alias(f"g{i}") for i, k in enumerate(keys)])
    ends = fixed.groupBy(at).agg(
        F.min_by(held, place).alias("head"), F.max_by(held, place).alias("tail"), F.max_by(f"{run}.seq", place).alias("n")
    )
    # a slice's last group, counted up over the slices, beside the first groups that ask for it
    asked = ends.select(F.col("head").alias("g"), at, F.lit(0).alias("tail"), F.lit(0).cast("long").alias("n"))
    known = ends.select(F.col("tail").alias("g"), at, F.lit(1).alias("tail"), "n")
    before = Window.partitionBy("g").orderBy(at, "tail").rowsBetween(Window.unboundedPreceding, -1)
    shifts = asked.unionByName(known).select(at, "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift)).where("tail = 0")
    numbered = fixed.join(F.broadcast(shifts.select(at, shift)), at)  # one row per slice
    seq = F.col(f"{run}.seq") + F.when(F.col(f"{run}.first"), F.col(shift)).otherwise(F.lit(0))
    return numbered.select(*_names(df), seq.alias(name))


def page_numbers(df: DataFrame, order_by: Sequence[Column], size: int, slices: int | None = None) -> DataFrame:
    """Stable pages: every row gets its 1-based ``position`` and ``page`` in one total order."""
    return with_position(df, order_by, "position", slices).withColumn(
        "page", F.floor((F.col("position") - 1) / F.lit(size)).cast("long") + 1
    )


def fetch_page(numbered: DataFrame, index: int, last_page: int) -> DataFrame:
    """One page of a numbered frame; an index outside the pages is an error."""
    if not 1 <= index <= last_page:
        raise IndexError(f"page {index} is out of range [1, {last_page}]")
    return numbered.where(F.col("page") == index)


def page_by_offset(df: DataFrame, order_by: Sequence[Column], index: int, size: int) -> DataFrame:
    """Page ``index`` (1-based) by ORDER BY, OFFSET, LIMIT: a distributed top-k of ``index * size`` rows.

    Meant for the first pages of a list; use :func:`page_numbers` to walk all pages.
    """
    return df.orderBy(*order_by).offset((index - 1) * size).limit(size)


def group_sequence(
    new_rows: DataFrame, existing: DataFrame | None, group: str, order_by: Sequence[Column], number: str
) -> DataFrame:
    """Number new rows per group, going on after the highest number the group already has."""
    rn, g, top = (free_name(new_rows, w, number) for w in ("rn", "g", "top"))
    keep = [F.col(f"`{c}`") for c in new_rows.columns if c.lower() != number.lower()]
    numbered = with_group_position(new_rows, [group], order_by, rn)
    if existing is None:
        return numbered.select(*keep, F.col(rn).cast("long").alias(number))
    tops = existing.groupBy(F.col(group).alias(g)).agg(F.max(number).alias(top))
    both = numbered.join(tops, F.col(group).eqNullSafe(F.col(g)), "left")
    return both.select(*keep, (F.coalesce(F.col(top), F.lit(0)) + F.col(rn)).cast("long").alias(number))
