"""Change messages between hosts, and host liveness, as file-backed streams.

Every function drains what is there (``availableNow``) or runs on; the sink of a
drained stream is a table, so its result is read back as an ordinary frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import with_group_position
from ..operators.versions import latest_version
from ..session import fresh_path, shuffle_width

EXPIRY_SECONDS = 60


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A table (folder or single file) as a stream.

    ``max_files`` bounds a micro-batch: a slow reader falls behind, nothing is lost.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    # a stream reads folders; as a pattern the path may also be one file
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain_to_table(stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream to the end of its input into a Parquet table (exactly once) and return the table."""
    spark = stream.sparkSession
    out = out or fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, label: str, apply, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run ``apply(frame, batch_id)`` on every micro-batch up to the end of the input."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, f"{label}-state"))
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )
    query.awaitTermination()


def batch_folder(spark: SparkSession, label: str, schema: T.StructType, out: str | None = None) -> str:
    """A folder for one sub-folder per micro-batch, readable before (or without) any batch.

    ``out`` names a lasting one, which a later run with the same checkpoint goes on filling.
    """
    out = out or fresh_path(spark, label)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    return out


def change_messages(loads: DataFrame, database: str, table: str, origin: str, ts: str) -> DataFrame:
    """``database:table`` after each load, with the host that did it."""
    return loads.select(
        F.concat(F.lit(f"{database}:"), F.col(table)).alias("message"),
        F.col(origin).cast("bigint").alias("origin"),
        F.col(ts).alias("ts"),
        F.col("change_id"),
    )


def fan_out(changes: DataFrame, hosts: DataFrame, lanes: int | None = None) -> DataFrame:
    """Each change to every known host but its sender, expired hosts included.

    The output is changes x hosts by definition. Changes are dealt over lanes and
    the host list is copied to each lane, so this is an equi-join with as many
    keys as lanes: a change is moved once, no sender or host is hot, and Spark
    broadcasts the host list only when it is small. There are as many lanes as shuffle
    partitions unless told otherwise. Works on a stream of changes.
    """
    lanes = lanes or shuffle_width(changes.sparkSession)
    dealt = changes.withColumn("__lane", F.pmod(F.xxhash64("change_id"), F.lit(lanes)).cast("int"))
    known = (
        hosts.select(F.col("host_id").alias("receiver"))
        .distinct()
        .withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    )
    return dealt.join(known, "__lane").where(F.col("receiver") != F.col("origin")).drop("__lane")


def pending(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """``(receiver, message, pending, newest)``: changes by others beyond a receiver's cursor, counted from offsets.

    A change is stored once, in a log with an ``offset``; a receiver is a row of ``cursors`` (``receiver``, ``cursor``) that
    moves on when it has been told. Nothing is copied per receiver: a cursor takes its place among the offsets of a
    message, and what lies behind it is a difference of two positions. A receiver's own changes are taken off in the same
    way. ``newest`` is the last such offset, NULL when nothing is pending.
    """
    log = changes.select("message", F.col("origin").cast("bigint").alias("origin"), "offset")
    known = cursors.select(F.col("receiver").cast("bigint").alias("receiver"), F.col("cursor").alias("offset"))

    def beyond(group: list[str], asked: DataFrame) -> DataFrame:
        """Per receiver and message: changes of the group and how many of them have an offset up to the cursor."""
        null = F.lit(None).cast("bigint")
        rows = log.select(*group, "offset", null.alias("receiver")).unionByName(asked.select(*group, "offset", "receiver"))
        # at its own offset a cursor comes last: that change has been told
        placed = with_group_position(rows, group, [F.col("offset"), F.col("receiver").asc_nulls_first()], "at").where("receiver is not null")
        before = F.row_number().over(Window.partitionBy(*group).orderBy("at"))  # receivers only, one row each
        return placed.select(*group, "receiver", (F.col("at") - before).alias("told"))

    by_origin = log.groupBy("message", "origin").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))
    by_message = by_origin.groupBy("message").agg(
        F.sum("n").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("last", "origin")), asc=False), 1, 2).alias("tops")  # a row per host
    )
    asked = known.join(F.broadcast(by_message.select("message")))  # messages name tables: one row each
    every = beyond(["message"], asked).join(by_message, "message")
    own = beyond(["message", "origin"], asked.join(by_origin.select("message", "origin"), "message").where("receiver = origin"))
    own = own.join(by_origin.select("message", "origin", F.col("n").alias("own")), ["message", "origin"]).select(
        "message", "receiver", "own", F.col("told").alias("own_told")
    )
    both = every.join(own, ["message", "receiver"], "left").join(known.withColumnRenamed("offset", "cursor"), "receiver")
    zero = F.lit(0).cast("bigint")
    others = F.col("n") - F.coalesce("own", zero)
    left = others - (F.col("told") - F.coalesce("own_told", zero))
    last = F.filter("tops", lambda x: x["origin"] != F.col("receiver"))[0]["last"]
    return both.where(others > 0).select(
        "receiver", "message", left.alias("pending"), F.when(left > 0, last).alias("newest")
    )


def last_heartbeats(beats: DataFrame, host: str, ts: str) -> DataFrame:
    return beats.groupBy(F.col(host).alias("host_id")).agg(F.max(ts).alias("last_seen"))


def with_expiry(last: DataFrame, now, limit_seconds: int = EXPIRY_SECONDS) -> DataFrame:
    """A host is expired once its last heartbeat is ``limit_seconds`` old."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return last.withColumn("is_expired", age >= limit_seconds * 1_000_000)


def expiry_stream(beats: DataFrame, host: str, ts: str, limit_seconds: int = EXPIRY_SECONDS, delay: str = "60 seconds") -> DataFrame:
    """``(host_id, up_from, last_seen, expired_at)``: one row whenever a host has been silent for ``limit_seconds``.

    A host's beats form a session that closes by event time, so the row comes without a further beat of that host, once
    the beats of others are ``delay`` beyond it. The state holds the open sessions only: hosts that are up.
    """
    seen = beats.select(F.col(host).alias("host_id"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    # sessions that touch are one; a beat that comes exactly at the limit is not in time
    up = seen.groupBy("host_id", F.session_window("ts", f"{limit_seconds * 1_000_000 - 1} microseconds").alias("up"))
    return up.agg(F.max("ts").alias("last_seen")).select(
        "host_id", F.col("up.start").alias("up_from"), "last_seen", (F.col("last_seen") + F.expr(f"interval {limit_seconds} seconds")).alias("expired_at")
    )


def liveness_stream(
    beats: DataFrame, host: str, ts: str, label: str = "liveness", out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Last heartbeat per host, kept by a stream.

    Update mode sends only hosts that beat since the last batch. Each batch has
    its own folder, overwritten if the batch is replayed, and the reader takes
    the newest row per host. State is one row per host. With ``out`` and ``checkpoint`` a later call reads only
    what is new.
    """
    spark = beats.sparkSession
    last = last_heartbeats(beats, host, ts)
    out = batch_folder(spark, label, last.schema, out)

    def apply(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain_batches(last, label, apply, "update", checkpoint)
    return latest_version(spark.read.parquet(out), ["host_id"], "last_seen", ["batch"]).drop("batch")
