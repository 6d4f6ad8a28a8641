"""Run logs as append-only events, and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_text, time_spent
from . import filters, numbering

RUNNING, COMPLETED, FAILED = "running", "completed", "failed"


def fold_run_events(events: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per run from its start and stop events.

    A stop event carries ``stop_time``, ``error_info`` ('' when all went well)
    and ``record_count``. No stop: running. An error text: failed. Aggregation
    only, so replayed events change nothing.
    """
    folded = events.groupBy(*ids, "start_time").agg(
        F.max("stop_time").alias("stop_time"),
        F.max("error_info").alias("error_info"),
        F.max("record_count").alias("record_count"),
    )
    return folded.withColumn(
        "status",
        F.when(F.col("stop_time").isNull(), F.lit(RUNNING))
        .when(F.coalesce("error_info", F.lit("")) != "", F.lit(FAILED))
        .otherwise(F.lit(COMPLETED)),
    )


def with_time_spent(logs: DataFrame) -> DataFrame:
    return logs.withColumn("time_spent", time_spent(F.col("start_time"), F.col("stop_time")))


def run_info(df: DataFrame) -> DataFrame:
    """``[time]status`` or ``[time]status:error`` of the last run; empty when it never ran."""
    stamp = F.concat(F.lit("["), epoch_text(F.col("last_run")), F.lit("]"), F.col("run_status"))
    text = (
        F.when(F.col("last_run") <= 0, F.lit(""))
        .when(F.col("last_error") != "", F.concat(stamp, F.lit(":"), F.col("last_error")))
        .when(F.col("run_status") != "", stamp)
    )
    return df.withColumn("run_info", F.coalesce(text, F.lit("")))


def log_page(logs: DataFrame, job_id: int, status: str | None, index: int, size: int) -> DataFrame:
    """One page of a job's log, newest first, with durations."""
    mine = filters.with_status(logs.where(F.col("job_id") == job_id), status)
    page = numbering.page_by_offset(mine, [F.col("start_time").desc(), F.col("table_id").desc()], index, size)
    return with_time_spent(page)


def stuck_runs(logs: DataFrame, now: int, limit_seconds: int) -> DataFrame:
    """Runs still open after the limit."""
    age = F.lit(now).cast("bigint") - F.col("start_time")
    return logs.where((F.col("status") == RUNNING) & (age > limit_seconds)).withColumn("age", age)


def job_status(table_logs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Outcome of a job from its tables: one failed table does not stop the others, but fails the job."""
    failed = F.count_if(F.col("status") == FAILED)
    running = F.count_if(F.col("status") == RUNNING)
    return table_logs.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("tables"),
        failed.alias("failed_tables"),
        F.when(failed > 0, F.lit(FAILED)).when(running > 0, F.lit(RUNNING)).otherwise(F.lit(COMPLETED)).alias("status"),
    )
