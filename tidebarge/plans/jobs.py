"""Running pull and push jobs end to end: rows, casts, target, superseded rows, watermark, logs, change messages.

A :class:`Store` is a folder that all executors reach. Every table in it is a :class:`~tidebarge.sinks.keyed.KeyedTable`,
whose newest version holds the watermark and the newest run of each job, so rows, watermark and run are one step. Logs
and change messages lie in one folder per run, written after the tables and overwritten if the run is done again. A run
that is repeated (same job, same ``now``) therefore changes nothing, wherever the first attempt died.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conform, runlog, versions
from ..sinks import tables as sinks
from ..sinks.keyed import KeyedTable, Run
from .specs import PULL_STAMP, PullSpec, PushSpec

LOG = "job_id int, table_id int, table_code string, start_time bigint, stop_time bigint, error_info string, record_count bigint"
CHANGE = "message string, ts bigint"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not sinks.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, run string").parquet(path).drop("run")

    def _put(self, name: str, schema: str, run: str, rows: Sequence[tuple]) -> None:
        if rows:
            frame = self.spark.createDataFrame(list(rows), schema).coalesce(1)
            frame.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")

    def keyed(self, name: str, keys: Sequence[str] = ()) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/tables/{name}", keys)

    def table(self, name: str) -> DataFrame:
        """The table as the jobs left it."""
        return self.keyed(name).read()

    def rejects(self, name: str) -> DataFrame:
        """Rows that could not be placed, with the reason."""
        return self.keyed(name).rejects()

    def logs(self) -> DataFrame:
        return runlog.fold_run_events(self._read("log", LOG), ["job_id", "table_id", "table_code"])

    def changes(self) -> DataFrame:
        return self._read("changes", CHANGE)


def _run(
    store: Store, kind: str, job_id: int, specs: Sequence, move: Callable, now: int, skip_hours: Sequence[int], workers: int,
    clock: Callable[[], int],
) -> bool:
    """Move every enabled table, up to ``workers`` at a time; a table that fails is logged and the others go on.

    ``move(spec, run)`` returns the number of rows and the change message. In a skipped hour (UTC) nothing runs.
    Returns whether every table went well.
    """
    if now // 3600 % 24 in skip_hours:
        return True
    run = Run(f"{kind}-{job_id}", now)

    def one(item: tuple) -> tuple[tuple, tuple | None]:
        table_id, spec = item
        try:
            count, message = move(spec, run)
        except Exception as e:
            text = (str(e).splitlines() or [""])[0] or type(e).__name__
            return (job_id, table_id, spec.dest_table, now, clock(), text, 0), None
        return (job_id, table_id, spec.dest_table, now, clock(), "", count), (message, now) if message else None

    work = [(i, s) for i, s in enumerate(specs, 1) if s.enabled]
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:  # bounded by the caller; the loop is over configuration
        done = list(pool.map(one, work))
    store._put("changes", CHANGE, f"{run.writer}-{now}", [c for _, c in done if c])
    store._put("log", LOG, f"{run.writer}-{now}", [log for log, _ in done])
    return all(not log[5] for log, _ in done)


def _cast(rows: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Rows in the wanted types; ``__reason`` names the values of a row that do not fit."""
    cast = conform.cast_table(rows, dict(wanted), [c for c in rows.columns if c not in wanted])
    return cast.withColumn("__reason", F.when(F.size("rejects") > 0, F.to_json("rejects"))).drop("rejects")


def run_pull_job(
    store: Store, job_id: int, specs: Sequence[PullSpec], rows_of: Callable[[PullSpec], DataFrame], now: int, database: str = "warehouse",
    casts: Mapping[str, Mapping[str, str]] | None = None, skip_hours: Sequence[int] = (), workers: int = 4,
    clock: Callable[[], int] | None = None,
) -> bool:
    """One run of a pull job. ``rows_of`` runs a spec's SELECT with the watermark bound to it.

    Without a watermark a table is replaced as a whole; with one its rows are merged by key (added when there are no
    keys). ``casts`` gives the types (see ``conform.cast_table``) of a table's columns. Rows without a key or with a
    value that does not fit are stored as rejects with the reason; the others go on.
    """

    def move(spec: PullSpec, run: Run) -> tuple[int, str]:
        target = store.keyed(spec.dest_table, spec.key_columns)
        state = target.state() or spec.filter_val
        rows = rows_of(replace(spec, filter_val=state))
        wanted = (casts or {}).get(spec.dest_table)
        rows = _cast(rows, wanted) if wanted else rows
        order = [*spec.tiebreak, *[c.column for c in state if c.column not in spec.tiebreak]]
        count = target.merge(
            sinks.stamp(rows, now), order, state, run, reason="__reason" if wanted else None, whole=not spec.filter_val
        )
        return count, f"{database}:{spec.dest_table}"

    return _run(store, "pull", job_id, specs, move, now, skip_hours, workers, clock or (lambda: now))


def run_push_job(
    store: Store, job_id: int, specs: Sequence[PushSpec], rows_of: Callable[[PushSpec], DataFrame], now: int,
    skip_hours: Sequence[int] = (), workers: int = 4, clock: Callable[[], int] | None = None,
) -> bool:
    """One run of a push job: rows loaded since its previous run go to the target by key, or replace it without keys.

    ``rows_of`` gives a spec's rows with their ``pull_time``.
    """

    def move(spec: PushSpec, run: Run) -> tuple[int, None]:
        target = store.keyed(spec.dest_table, spec.key_columns)
        rows = rows_of(spec)
        columns = [*(spec.insert_columns or [c for c in rows.columns if c != PULL_STAMP])]
        if not spec.key_columns:
            return target.merge(rows.select(*columns), run=run, whole=True), None
        last = target.version().runs.get(run.writer)
        since = versions.since_pull(rows, last["number"]) if last else rows
        # the order of the versions of a key need not be among the columns that are sent
        order = [c for c in spec.order_columns if c in since.columns] or [PULL_STAMP]
        batch = since.select(*columns, F.struct(*order).alias("__order")) if set(order) - set(columns) else since.select(*columns)
        return target.merge(batch, order if "__order" not in batch.columns else ["__order"], run=run, helper="__order"), None

    return _run(store, "push", job_id, specs, move, now, skip_hours, workers, clock or (lambda: now))
