"""Pull and push: whole table movements as lazy plans over frames.

Neither function writes or counts by itself; the caller writes the returned
frames (see ``sinks.tables``). With keys both are idempotent: pulling or pushing the
same rows twice gives the same table as once. A pull with a watermark and without keys appends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import versions
from ..sinks.tables import load_count, stamp
from .specs import PULL_STAMP, PullSpec, PushSpec


@dataclass(frozen=True)
class PullResult:
    target: DataFrame
    watermark: DataFrame | None
    moved: DataFrame
    rejects: DataFrame | None = None


def last_per_key(batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row that would win if the batch were applied in ``order_by`` order.

    Ties are settled by the rows' hashes, so that every run and every partitioning picks the same row.
    """
    hashable = [f.name for f in batch.schema.fields if not isinstance(f.dataType, T.MapType)]
    order = [*[F.col(c).desc() for c in order_by], F.xxhash64(*hashable)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def null_key_rows(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a keyed replace cannot place: a key column is NULL. All of them are rejects, none goes to the target."""
    return batch.where(reduce(or_, [F.col(k).isNull() for k in keys]))


def _keyed(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))


def replace_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keyed replace: a batch row takes the place of the whole old row with its key.

    The target is only anti-joined with the batch's keys, so with a small batch
    it is not shuffled at all. Batch rows with a NULL key are left out (see ``null_key_rows``); what the target has
    stays, also several versions of a key that the batch does not touch.
    """
    batch = _keyed(batch, keys)
    newest = last_per_key(batch, keys, order_by)
    # distinct keys collapse before the shuffle, so a key the batch repeats often stays cheap
    kept = target.join(batch.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(newest).select(*target.columns)


def pull(
    spec: PullSpec, rows: DataFrame, target: DataFrame | None, pull_time: int, dedup: str = "latest"
) -> PullResult:
    """One table's pull.

    ``rows`` is the result of the spec's SELECT. Without a watermark the target is
    replaced. With one the rows are added, superseded versions go, and the watermark
    moves to the maxima of the new target. ``sinks.tables.write_with_watermark``
    writes the target and reads the maxima off in the same pass.

    ``dedup="latest"`` keeps one newest row per key. ``dedup="oldest"`` removes
    only the oldest version per repeated key (see ``drop_oldest_version``).
    """
    loaded = stamp(rows, pull_time)
    moved = load_count(rows)
    rejects = null_key_rows(loaded, spec.key_columns) if spec.key_columns else None
    # all rows of a run share its stamp: the newest is the one furthest by the watermark
    order = [*spec.tiebreak, *[c.column for c in spec.filter_val or () if c.column not in spec.tiebreak]]
    if not spec.filter_val:
        fresh = last_per_key(_keyed(loaded, spec.key_columns), spec.key_columns, order) if spec.key_columns else loaded
        return PullResult(fresh, None, moved, rejects)
    if spec.key_columns:
        loaded = _keyed(loaded, spec.key_columns)
    everything = loaded if target is None else target.unionByName(loaded)
    if not spec.key_columns:
        merged = everything
    elif dedup == "oldest":
        merged = versions.drop_oldest_version(everything, spec.key_columns)
    elif target is None:
        merged = versions.latest_version(loaded, spec.key_columns, PULL_STAMP, order)
    else:
        # earlier pulls left one row per key in the target: only the batch needs ranking
        merged = replace_rows(target, loaded, spec.key_columns, [PULL_STAMP, *order])
    return PullResult(merged, versions.advance_watermark(merged, spec.filter_val), moved, rejects)


def push(spec: PushSpec, rows: DataFrame, target: DataFrame) -> DataFrame:
    """The target after a push: replaced as a whole without keys, by key with them."""
    rows = rows.select(*(spec.insert_columns or rows.columns))
    if not spec.key_columns:
        return rows
    return replace_rows(target, rows, spec.key_columns, spec.order_columns)


def key_integrity(batch: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """One row: is the batch fit for a keyed replace? Counts rows, repeated keys and NULL keys."""
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(
        F.lit(table).alias("table_code"),
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count_if(F.col("__n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(has_null, F.col("__n"))), F.lit(0)).cast("bigint").alias("null_key_rows"),
    ).withColumn("is_fit", (F.col("repeated_keys") == 0) & (F.col("null_key_rows") == 0))

