"""Versioned rows: duplicates, superseded versions, watermarks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.specs import PULL_STAMP, FilterCondition

CONDITIONS_SCHEMA = "array<struct<column:string,dataType:string,value:string>>"


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the row count. Partial counts make hot keys harmless."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


def oldest_of_repeated(df: DataFrame, keys: Sequence[str], stamp: str = PULL_STAMP) -> DataFrame:
    """``group by keys having count(*) > 1`` with the smallest stamp of each group."""
    return (
        df.groupBy(*keys)
        .agg(F.min(stamp).alias(stamp), F.count(F.lit(1)).alias("versions"))
        .where("versions > 1")
        .drop("versions")
    )


def in_grouped(df: DataFrame, grouped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose column tuple is in ``grouped`` (``(a, b) IN (subquery)``)."""
    return df.join(grouped.select(*columns), list(columns), "left_semi").select(*df.columns)


def drop_oldest_version(df: DataFrame, keys: Sequence[str], stamp: str = PULL_STAMP) -> DataFrame:
    """Remove the oldest version of every repeated key, as the movement jobs do after each load.

    Only the smallest stamp goes, so three versions leave two, and rows sharing
    that stamp go together. Keys are compared with ``=``: rows with a NULL key
    are never removed. The join runs on keys and stamp, so the versions of one
    hot key spread over tasks; what remains skewed is split by AQE (left side of
    an anti join).
    """
    return df.join(oldest_of_repeated(df, keys, stamp), [*keys, stamp], "left_anti").select(*df.columns)


def latest_version(
    df: DataFrame, keys: Sequence[str], stamp: str = PULL_STAMP, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the newest stamp, ties broken by ``tiebreak`` descending, then by the row's hash. NULL is one key.

    ``rank = 1`` lets Spark put a group limit before the shuffle, so each map
    task sends at most one row per key and a hot key costs no more than any other.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    order = [F.col(stamp).desc(), *[F.col(c).desc() for c in tiebreak], F.xxhash64(*hashable)]
    return (
        df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where("__rank = 1")
        .drop("__rank")
    )


def max_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Independent maxima of several columns in one pass (not the maximum of the tuple)."""
    return df.agg(*[F.max(c).alias(c) for c in columns])


def as_watermark_text(col: Column, dtype: str) -> Column:
    if dtype.startswith("timestamp"):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return col.cast("string")


def advance_watermark(target: DataFrame, state: Iterable[FilterCondition]) -> DataFrame:
    """One row ``filter_val``: the state with each value replaced by its column's maximum in ``target``.

    An empty target or an all-NULL column keeps the old value, so a watermark is never lost.
    """
    types = dict(target.dtypes)
    entries = [
        F.struct(
            F.lit(c.column).alias("column"),
            F.lit(c.data_type).alias("dataType"),
            F.coalesce(as_watermark_text(F.max(c.column), types[c.column]), F.lit(c.value)).alias("value"),
        )
        for c in state
    ]
    return target.agg(F.to_json(F.array(*entries)).alias("filter_val"))


def decode_watermarks(df: DataFrame, column: str = "filter_val") -> DataFrame:
    """A state table with JSON text to one row per condition.

    A state without conditions keeps one row, and its ``reason`` says why: no state, no conditions, or text that
    is no list of conditions. A table whose state cannot be read is not taken for one that has none.
    """
    parsed = df.withColumn("__p", F.from_json(column, CONDITIONS_SCHEMA))
    no_name = F.exists("__p", lambda c: c["column"].isNull())
    reason = (
        F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", F.lit("no state"))
        .when(F.col("__p").isNull() | no_name, F.lit("unreadable state"))
        .when(F.size("__p") == 0, F.lit("no conditions"))
    )
    parsed = parsed.withColumn("reason", reason)
    conditions = F.when(F.col("reason").isNull(), F.col("__p"))
    return parsed.withColumn("__c", F.explode_outer(conditions)).select(
        *[c for c in df.columns if c != column],
        F.col("__c.column").alias("filter_column"),
        F.col("__c.dataType").alias("data_type"),
        F.col("__c.value").alias("value"),
        "reason",
    )


def encode_watermark(columns: Sequence[tuple[Column, Column, Column]]) -> Column:
    """JSON text from ``(column, data type, value)`` triples of one row."""
    return F.to_json(
        F.array(*[F.struct(c.alias("column"), t.alias("dataType"), v.alias("value")) for c, t, v in columns])
    )


def since_pull(df: DataFrame, last_run: int, stamp: str = PULL_STAMP) -> DataFrame:
    """Rows loaded at or after the previous run: what a push has to send."""
    return df.where(F.col(stamp) >= F.lit(last_run))


def rows_per_pull(df: DataFrame, stamp: str = PULL_STAMP) -> DataFrame:
    return df.groupBy(stamp).agg(F.count(F.lit(1)).alias("record_count"))
