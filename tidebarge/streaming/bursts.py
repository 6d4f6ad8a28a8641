"""Request limits on a live stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.requests import BURST_LIMIT, BURST_WINDOW_SECONDS, burst_audit, open_windows
from ..session import fresh_path
from .feed import batch_folder, drain_batches

_MARKED = T.StructType().add("client", "string").add("request_id", "long").add("ts_us", "long").add("allowed", "boolean").add("window_us", "long")
_OPEN = T.StructType().add("client", "string").add("open_start", "long").add("open_count", "integer")


def burst_stream(
    stream: DataFrame, client: str, ts: str, request_id: str, limit: int = BURST_LIMIT, window_seconds: int = BURST_WINDOW_SECONDS,
    out: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Mark requests as they come, up to the end of the input; returns the table of all marked requests.

    A micro-batch is cut into slices as in ``burst_audit``, so a client with most of its requests is dealt over many
    tasks and none holds all of them. Between batches the open windows are kept, one row per client whose window has not
    closed; others expire. Batches arrive in time order. Every batch has folders of its own for its marks and its open
    windows, overwritten if it is replayed. With ``out`` and ``checkpoint`` a later call goes on where this one stopped.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, "bursts")
    marks, windows = batch_folder(spark, "bursts", _MARKED, f"{out}/marks"), batch_folder(spark, "bursts", _OPEN, f"{out}/open")

    def apply(frame: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(_OPEN).parquet(f"{windows}/batch={batch_id - 1}")
        path = f"{marks}/batch={batch_id}"
        burst_audit(frame, client, ts, request_id, limit, window_seconds, entering=before).write.mode("overwrite").parquet(path)
        still = open_windows(spark.read.schema(_MARKED).parquet(path), before, limit, window_seconds)
        still.write.mode("overwrite").parquet(f"{windows}/batch={batch_id}")

    drain_batches(stream, "bursts", apply, checkpoint=checkpoint)
    return spark.read.schema(T.StructType([*_MARKED.fields, T.StructField("batch", T.LongType())])).parquet(marks).drop("batch")


def open_now(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Windows that were open after a batch."""
    return spark.read.schema(_OPEN).parquet(f"{out}/open/batch={batch_id}")
