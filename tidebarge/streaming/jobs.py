"""Scheduled pulls and pushes on change, as micro-batch jobs that can be replayed."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.specs import PULL_STAMP, PushSpec
from ..sinks.keyed import KeyedTable, Run
from ..sinks.tables import stamp
from .feed import drain_batches


def _with_fields(df: DataFrame, **types: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in types.items()]])


def scheduled_pull(
    stream: DataFrame, target: KeyedTable, tiebreak: Sequence[str] = (), label: str = "scheduled", checkpoint: str | None = None,
    clock: Callable[[], int] = lambda: int(time.time()),
) -> DataFrame:
    """Incremental pull on every trigger into a keyed table; a streaming query never overlaps itself.

    The stream's checkpoint is the watermark. Every micro-batch is one merge: it writes its own rows, never the table,
    and notes batch and stamp in the table's version. ``pull_time`` is the time of the run in epoch seconds, above that
    of the batch before. A batch that is replayed after its merge is not applied again, so its stamps stay; a call with
    nothing new writes nothing. With ``checkpoint`` a later call goes on from there.
    """

    def load(frame: DataFrame, batch_id: int) -> None:
        last = target.version().runs.get(label)
        now = max(clock(), int(last["note"]) + 1) if last else clock()
        target.merge(stamp(frame, now), tiebreak, run=Run(label, batch_id, str(now)))

    drain_batches(stream, label, load, checkpoint=checkpoint)
    if not target.version().schema:  # no batch has come yet
        return stream.sparkSession.createDataFrame([], _with_fields(stream, **{PULL_STAMP: T.LongType()}))
    return target.read()


def push_on_change(
    changes: DataFrame, specs: Sequence[PushSpec], rows_of: Callable[[PushSpec], DataFrame], target: KeyedTable, stamp: str = PULL_STAMP,
    label: str = "push", checkpoint: str | None = None,
) -> DataFrame:
    """Run the push of every spec whose source table is named in a micro-batch of changes.

    Every spec is a subscriber with a cursor: the highest ``stamp`` it has sent, kept in the target's version beside the
    rows. A push reads and sends only rows beyond it, in one merge by key; within a batch, later specs win. A replayed
    batch is not applied again. Of the changes only the known table names reach the driver, at most one per spec.
    """
    if not target.keys or {tuple(s.key_columns) for s in specs} != {tuple(target.keys)}:
        raise ValueError("specs must share the key columns of the target")
    by_source = {s.source_table: (i, s) for i, s in enumerate(specs) if s.enabled}

    def send(i: int, spec: PushSpec, batch_id: int) -> None:
        writer = f"{label}-{i}"
        last = target.version().runs.get(writer)
        rows = rows_of(spec)
        if last and last["note"]:
            rows = rows.where(F.col(stamp) > F.lit(last["note"]).cast(rows.schema[stamp].dataType))
        high = rows.agg(F.max(stamp).cast("string")).first()[0]  # one column; rows that come meanwhile wait for the next push
        if high is None:
            return
        rows = rows.where(F.col(stamp) <= F.lit(high).cast(rows.schema[stamp].dataType))
        columns = [f.name for f in target.read().schema.fields] if target.version().schema else [c for c in rows.columns if c != stamp]
        order = [c for c in spec.order_columns if c in rows.columns] or [stamp]
        batch = rows.select(*columns, F.struct(*order).alias("__order"))
        target.merge(batch, ["__order"], run=Run(writer, batch_id, high), helper="__order")

    def apply(frame: DataFrame, batch_id: int) -> None:
        name = F.substring_index("message", ":", -1)
        touched = frame.select(name.alias("t")).where(F.col("t").isin(list(by_source))).distinct().collect()
        for i, spec in sorted((by_source[r.t] for r in touched), key=lambda x: x[0]):
            send(i, spec, batch_id)

    drain_batches(changes, label, apply, checkpoint=checkpoint)
    return target.read()
