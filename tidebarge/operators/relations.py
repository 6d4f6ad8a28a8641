"""Joins between configuration, logs and live reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YES, NO = "是", "否"

# plugin states. Fixed values.
AWAITING_UPLOAD = "待上传"
AWAITING_DEPLOY = "待部署"
LOST = "已失联"


def key_columns(columns: DataFrame, key_usage: DataFrame, on: Sequence[str]) -> DataFrame:
    """Columns with a key flag: 是 when the key usage table lists them, else 否."""
    listed = key_usage.select(*on).distinct().withColumn("__k", F.lit(True))
    return columns.join(listed, list(on), "left").withColumn(
        "is_key", F.when(F.col("__k"), F.lit(YES)).otherwise(F.lit(NO))
    ).select(*columns.columns, "is_key")


def last_run(owners: DataFrame, logs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Jobs or tables with status and error of their last run; both empty when it has no log row."""
    run = logs.select(
        *[F.col(i) for i in ids],
        F.col("start_time").alias("last_run"),
        F.col("status").alias("run_status"),
        F.col("error_info").alias("last_error"),
    )
    joined = owners.join(run, [*ids, "last_run"], "left").fillna("", ["run_status", "last_error"])
    return joined.select(*owners.columns, "run_status", "last_error")


def first_gap(df: DataFrame, id_column: str, group: Sequence[str] = ()) -> DataFrame:
    """Smallest free id from 1 upwards, overall or per group.

    Ids are collected as bitmaps: a block of 64 ids is one row with a bit per id before anything is shuffled, so a large
    group sends a row per block and spreads over its blocks. A full block asks for the next one, and block 0 is always
    asked for; of the blocks that are asked for and not full the first has the gap. Ids below 1 are not looked at.
    """
    used = F.col(f"`{id_column}`").cast("bigint") - 1
    bit = F.expr("shiftleft(1L, cast(__at & 63 as int))")
    rows = df.select(*group, used.alias("__at")).withColumn("__block", F.shiftright("__at", 6))
    rows = rows.select(*group, F.when(F.col("__at") >= 0, F.col("__block")).otherwise(0).alias("__block"), F.when(F.col("__at") >= 0, bit).otherwise(0).alias("__bit"))
    blocks = rows.groupBy(*group, "__block").agg(F.bit_or("__bit").alias("__bits"))
    none, yes = F.lit(0).cast("bigint"), F.lit(True)
    own = F.struct(F.col("__block").alias("__b"), F.col("__bits").alias("__bits"), (F.col("__block") == 0).alias("__asked"))
    following = F.struct((F.col("__block") + 1).alias("__b"), none.alias("__bits"), yes.alias("__asked"))
    first = F.struct(none.alias("__b"), none.alias("__bits"), yes.alias("__asked"))
    asked = blocks.select(*group, F.inline(F.array_append(F.array(own, first), F.when(F.col("__bits") == -1, following).otherwise(first))))
    asked = asked.groupBy(*group, "__b").agg(F.bit_or("__bits").alias("__bits"), F.max("__asked").alias("__asked"))
    # the lowest bit that is not set: count what lies below it
    low = F.bit_count(F.col("__bits").bitwiseAND(F.bitwise_not(F.col("__bits") + 1)))
    free = asked.where(F.col("__asked") & (F.col("__bits") != -1)).select(*group, (F.col("__b") * 64 + low + 1).alias("__id"))
    # an empty table has no blocks: its first free id is 1
    return free.groupBy(*group).agg(F.coalesce(F.min("__id"), F.lit(1)).cast("bigint").alias("first_gap"))


def with_sentinel(df: DataFrame, id_column: str) -> DataFrame:
    """The ids and a 0 (``UNION ALL select 0``)."""
    zero = df.sparkSession.range(1).select(F.lit(0).cast(df.schema[id_column].dataType).alias(id_column))
    return df.select(id_column).unionByName(zero)


def status_overlay(plugins: DataFrame, reports: DataFrame) -> DataFrame:
    """Plugin list with the status live hosts report; without a report, what its record implies.

    ``reports`` has one row per plugin (``plugin_uuid``, ``reported_status``).
    """
    implied = (
        F.when(F.coalesce(F.col("plugin_file_name"), F.lit("")) == "", F.lit(AWAITING_UPLOAD))
        .when(F.coalesce(F.col("host_uuid"), F.lit("")) == "", F.lit(AWAITING_DEPLOY))
        .otherwise(F.lit(LOST))
    )
    return (
        plugins.join(reports.select("plugin_uuid", "reported_status"), "plugin_uuid", "left")
        .withColumn("status", F.coalesce("reported_status", implied))
        .select(*plugins.columns, "status")
    )


def tag_loaded(jobs: DataFrame, online: DataFrame, id_column: str) -> DataFrame:
    """``loaded`` for ids in the online set, else ``unloaded``."""
    live = online.select(id_column).distinct().withColumn("__on", F.lit(True))
    return jobs.join(live, id_column, "left").withColumn(
        "load_status", F.when(F.col("__on"), F.lit("loaded")).otherwise(F.lit("unloaded"))
    ).select(*jobs.columns, "load_status")
