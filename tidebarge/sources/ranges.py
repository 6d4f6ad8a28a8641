"""Ranges of equal size for a partitioned read, whatever the distribution of the key.

Bounds come from a summary of the key columns: points in key order, each standing for as many rows. Summaries merge, so
every task summarises its slice of the source and a tree of merges leaves one. A hot value is cut by further columns
(``["customer", "order"]``): bounds are tuples, compared column by column, NULL before all values. Where the footers of
Parquet files already tell enough, they are the summary and no column is read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a summary for each range. A merge may misplace a bound by a point's rows, so by half a hundredth of a range.
POINTS = 200
#: Summaries that one task merges.
FAN_IN = 32
#: Rows a task sorts at a time.
CHUNK = 1 << 18
#: Most files whose footers are looked at one by one.
MOST_FOOTERS = 1000

_WEIGHT = "__rows"


def compress(points: pa.Table, most: int) -> pa.Table:
    """At most ``most`` points for the same rows: each is the last of its rows in key order."""
    keys = [c for c in points.column_names if c != _WEIGHT]
    order = pc.sort_indices(points, sort_keys=[(c, "ascending") for c in keys], null_placement="at_start")
    points = points.take(order)
    ends = np.cumsum(points.column(_WEIGHT).to_numpy())
    if not len(ends):
        return points
    at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, most + 1) / most - 1e-9))
    kept, i = points.take(pa.array(at)), points.column_names.index(_WEIGHT)
    # the field as it came (not null), so that the points can be put together with further batches
    return kept.set_column(i, points.schema.field(i), pa.array(np.diff(ends[at], prepend=0), pa.int64()))


def _summarise(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += len(batch)
            if n >= max(CHUNK, 4 * most):
                held = [compress(pa.concat_tables(held), most)]
                n = len(held[0])
        if held:
            yield from compress(pa.concat_tables(held), most).to_batches()

    return run


def summary(df: DataFrame, columns: Sequence[str], points: int) -> pa.Table:
    """At most ``points`` points for all rows of ``df``; only the key columns are read, no row is shuffled."""
    rows = df.select(*columns, F.lit(1).cast("long").alias(_WEIGHT))
    made = rows.mapInArrow(_summarise(points), rows.schema)
    # as many merges as it takes to bring any number of tasks down to one
    slices = rows.rdd.getNumPartitions()
    while slices > 1:
        slices = -(-slices // FAN_IN)
        made = made.repartition(slices).mapInArrow(_summarise(points), rows.schema)
    return compress(made.toArrow(), points)


def bounds(points: pa.Table, parts: int) -> list[tuple]:
    """Last key of every range but the last; fewer than ``parts - 1`` where equal keys leave no more."""
    keys = [c for c in points.column_names if c != _WEIGHT]
    ends = np.cumsum(points.column(_WEIGHT).to_numpy())
    if not len(ends):
        return []
    at = np.unique([int(np.argmin(np.abs(ends - ends[-1] * i / parts))) for i in range(1, parts)])
    rows = points.select(keys).take(pa.array(at[at < len(ends) - 1])).to_pylist() if parts > 1 else []
    cuts = [tuple(r[k] for k in keys) for r in rows]
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


def equi_depth_bounds(df: DataFrame, columns: Sequence[str], parts: int) -> list[tuple]:
    """Bounds that cut ``df`` into ``parts`` ranges of the key with as many rows each, to about a hundredth."""
    return bounds(summary(df, columns, POINTS * parts), parts)


def footer_points(spark: SparkSession, path: str, column: str) -> pa.Table | None:
    """Row groups of the Parquet files as points, in key order; None where they overlap or have no whole-number statistics.

    Reads footers on the driver, of :data:`MOST_FOOTERS` files at most.
    """
    files = spark.read.parquet(path).inputFiles()
    if len(files) > MOST_FOOTERS:
        return None
    hadoop, conf = spark._jvm.org.apache.parquet.hadoop, spark._jsc.hadoopConfiguration()
    groups, nulls = [], 0
    for f in files:
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(place, conf))
        try:
            for block in reader.getFooter().getBlocks():
                for chunk in block.getColumns():
                    if chunk.getPath().toDotString() == column:
                        stats = chunk.getStatistics()
                        lost = stats.getNumNulls()
                        nulls += max(lost, 0)
                        if lost < 0:
                            return None
                        if block.getRowCount() == lost:
                            continue
                        low, high = (stats.genericGetMin(), stats.genericGetMax()) if stats.hasNonNullValue() else (None, None)
                        if type(low) is not int:
                            return None
                        groups.append((low, high, block.getRowCount() - lost))
        finally:
            reader.close()
    groups.sort()
    if any(a[1] > b[0] for a, b in zip(groups, groups[1:])):
        return None
    rows = ([(None, nulls)] if nulls else []) + [(high, n) for _, high, n in groups]
    return pa.table({column: pa.array([r[0] for r in rows], pa.int64()), _WEIGHT: pa.array([r[1] for r in rows], pa.int64())})


def parquet_bounds(spark: SparkSession, path: str, columns: Sequence[str], parts: int, slack: float = 0.05) -> list[tuple]:
    """Bounds for the Parquet files of a path: from their footers if no row group holds more than ``slack`` of a range."""
    points = footer_points(spark, path, columns[0]) if len(columns) == 1 else None
    if points is not None and len(points):
        sizes = points.column(_WEIGHT).to_numpy()
        if sizes.max() <= slack * sizes.sum() / parts:
            return bounds(points, parts)
    return equi_depth_bounds(spark.read.parquet(path), columns, parts)


def sql_literal(value) -> str:
    """A value in standard SQL."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"cast('{value!r}' as double)"
    if isinstance(value, dt.datetime):
        return f"timestamp '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"date '{value:%Y-%m-%d}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


def _up_to(columns: Sequence[str], bound: tuple) -> str:
    """Keys not after ``bound``."""
    if not columns:
        return "1 = 1"
    (k, *rest), (v, *more) = columns, bound
    if v is None:
        return f"({k} IS NULL AND {_up_to(rest, more)})"
    v = sql_literal(v)
    if not rest:
        return f"({k} IS NULL OR {k} <= {v})"
    return f"({k} IS NULL OR {k} <= {v} AND ({k} < {v} OR {_up_to(rest, more)}))"


def _after(columns: Sequence[str], bound: tuple) -> str:
    """Keys after ``bound``. The first condition alone lets a source skip what lies before."""
    if not columns:
        return "1 = 0"
    (k, *rest), (v, *more) = columns, bound
    if v is None:
        return f"({k} IS NOT NULL OR {_after(rest, more)})"
    v = sql_literal(v)
    if not rest:
        return f"{k} > {v}"
    return f"({k} >= {v} AND ({k} > {v} OR {_after(rest, more)}))"


def range_predicates(columns: Sequence[str], cuts: Sequence[tuple]) -> list[str]:
    """WHERE clauses, one per range, for ``spark.read.jdbc(predicates=...)``; every row is in exactly one of them."""
    if not cuts:
        return ["1 = 1"]
    inner = [f"{_after(columns, a)} AND {_up_to(columns, b)}" for a, b in zip(cuts, cuts[1:])]
    return [_up_to(columns, cuts[0]), *inner, _after(columns, cuts[-1])]


def range_of(columns: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """Number of the range that a row is in."""
    clauses = range_predicates(columns, cuts)
    return F.coalesce(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(clauses[:-1])], F.lit(len(clauses) - 1))
