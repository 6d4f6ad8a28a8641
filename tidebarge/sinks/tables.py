"""Writing tables: append, counted loads, one-step swaps, batches."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.versions import as_watermark_text
from ..plans.specs import PULL_STAMP, FilterCondition

PLACEHOLDER_CAP = 65535


def stamp(df: DataFrame, pull_time: int) -> DataFrame:
    """The load stamp: start of the run in epoch seconds, the same on every row."""
    return df.withColumn(PULL_STAMP, F.lit(pull_time).cast("bigint"))


def append_counted(df: DataFrame, path: str, max_rows_per_file: int = 0) -> int:
    """Append and return the rows written; counted during the write, not by a second pass."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)
    return seen.get["rows"]


def write_with_watermark(
    df: DataFrame, path: str, state: Iterable[FilterCondition]
) -> tuple[int, tuple[FilterCondition, ...]]:
    """Write a new table once; the row count and the advanced watermark are observed on the way."""
    state, types, seen = tuple(state), dict(df.dtypes), Observation()
    maxima = [as_watermark_text(F.max(c.column), types[c.column]).alias(f"m{i}") for i, c in enumerate(state)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *maxima).write.mode("error").parquet(path)
    got = seen.get
    new = tuple(c if got[f"m{i}"] is None else replace(c, value=got[f"m{i}"]) for i, c in enumerate(state))
    return got["rows"], new


def swap_in(spark: SparkSession, table: str, df: DataFrame, new_location: str) -> None:
    """Full refresh: write the new content aside, then point the table at it.

    The data is written once and the switch is a catalog change, so readers see
    the old table or the new one, never an empty one; if the write fails the old
    content is untouched. ``new_location`` must be unused; the former location is
    left for readers still on it and for the caller to clean up.
    """
    df.write.mode("error").parquet(new_location)
    if spark.catalog.tableExists(table):
        place = new_location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, path=new_location, source="parquet")


def write_split(cast: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write a cast table once, good and rejected rows in folders of their own; returns both, read back.

    Rejected rows keep their ``rejects``, see ``conform.rejected_values``.
    """
    cast.withColumn("is_good", F.size("rejects") == 0).write.partitionBy("is_good").mode("error").parquet(path)
    schema = T.StructType([*cast.schema.fields, T.StructField("is_good", T.BooleanType())])
    written = cast.sparkSession.read.schema(schema).parquet(path)
    good = written.where("is_good").drop("is_good", "rejects")
    return good, written.where("not is_good").drop("is_good")


def truncate(spark: SparkSession, table: str) -> None:
    """Empty a managed table, keeping its schema."""
    spark.sql(f"TRUNCATE TABLE {table}")


def emptied(df: DataFrame) -> DataFrame:
    """The frame form of a truncated table: same schema, no rows, nothing scanned."""
    return df.where(F.lit(False))


def rows_per_statement(batch: int, columns: int) -> int:
    """Rows of one prepared statement, which takes fewer than 65535 values: the batch, or as many as fit."""
    return max(1, min(batch, (PLACEHOLDER_CAP - 1) // max(columns, 1)))


def written_files(df: DataFrame, path: str, max_rows_per_file: int) -> DataFrame:
    """Write in files of at most ``max_rows_per_file`` rows and report the rows of each written file."""
    append_counted(df, path, max_rows_per_file)
    return df.sparkSession.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def batch_report(df: DataFrame, path: str, batch: int) -> DataFrame:
    """Write in files of at most ``batch`` rows, or as many as fit a statement, and report what the files hold, in one row.

    ``rows``; ``within_cap``: no file has more; ``has_files``: there are as many files as that takes; then rows of a
    statement, how many statements the written rows take and the rows of the last one.
    """
    most = rows_per_statement(batch, len(df.columns))
    files = written_files(df, path, most)
    told = files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("rows") <= most, F.lit(True)).alias("within_cap"),
        F.count(F.lit(1)).alias("files"), F.lit(most).alias("per_statement"),
    )
    told = told.withColumn("statements", F.ceil(F.col("rows") / most))
    last = F.greatest(F.col("rows") - 1, F.lit(0)) % most + F.least(F.col("rows"), F.lit(1))
    return told.select(
        "rows", "within_cap", (F.col("files") >= F.col("statements")).alias("has_files"), "per_statement", "statements", last.cast("bigint").alias("last_rows")
    )


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count"))
