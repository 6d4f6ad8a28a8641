"""Deletes, written as the rows to keep. What a comparison with NULL leaves open is not deleted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_latest(logs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Only the newest log of each owner; a log without an owner stays. The maxima are pre-aggregated; a hot owner is not gathered in one task."""
    newest = logs.groupBy(*ids).agg(F.max("start_time").alias("start_time"))
    older = F.col("l.start_time") < F.col("n.start_time")
    for c in ids:
        older = older & (F.col(f"l.{c}") == F.col(f"n.{c}"))
    return logs.alias("l").join(newest.alias("n"), older, "left_anti").select(*logs.columns)


def delete_keys(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(doomed.select(*keys), list(keys), "left_anti").select(*df.columns)


def delete_one(df: DataFrame, key: dict[str, object]) -> DataFrame:
    """Delete by full key, compared null-safe: a row with a NULL key column is kept."""
    hit = F.lit(True)
    for c, v in key.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return df.where(~hit)


def delete_before_date(df: DataFrame, date: str, column: str = "log_date") -> DataFrame:
    return df.where((F.col(column) >= date) | F.col(column).isNull())


def delete_on_date(df: DataFrame, date: str, column: str = "log_date") -> DataFrame:
    return df.where((F.col(column) != date) | F.col(column).isNull())


def keep_n_dates(df: DataFrame, n: int, column: str = "log_date") -> DataFrame:
    """Rows of the ``n`` newest dates present, and rows without a date. The broadcast side has at most ``n`` rows."""
    newest = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(F.col(column).desc()).limit(n)
    marked = df.join(F.broadcast(newest.withColumn("__new", F.lit(True))), column, "left")
    return marked.where(F.col("__new") | F.col(column).isNull()).select(*df.columns)


def clear_user_log(df: DataFrame, user_id: int, log_id: int | None = None) -> DataFrame:
    """Delete all request logs of a user, or one of them."""
    key = {"user_id": user_id}
    if log_id is not None:
        key["log_id"] = log_id
    return delete_one(df, key)


def cascade_delete(doomed: DataFrame, keys: Sequence[str], **frames: DataFrame) -> dict[str, DataFrame]:
    """What is left of jobs, tables and logs once the doomed ids are gone from all of them."""
    return {name: delete_keys(df, doomed, keys) for name, df in frames.items()}
