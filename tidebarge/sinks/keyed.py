"""Tables that are changed by key without being rewritten: merge on read.

A table is a folder. ``data/`` holds Parquet folders, one per commit, ``deletes/`` the places (file, row) of rows that
later commits replaced, ``rejects/`` rows without a key. Which of them count says the newest file in ``versions/``, a
small JSON document with the watermark and the runs that have been applied. A commit writes its folders first and its
version last, by a rename that fails if the version exists, so readers and a job that died see the old table or the
new one. Folders no version names are leftovers for :meth:`KeyedTable.vacuum`.

A merge of b rows writes b rows and at most b places; of the table it reads the key columns, and of those only row
groups in the key range of the batch. Readers take folders without deleted rows as they are and anti-join the others
with the places. :meth:`KeyedTable.compact` rewrites the folders that have many deleted rows or hardly any rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import typed_literal
from ..operators.versions import as_watermark_text
from ..plans.specs import FilterCondition, conditions_from_json, conditions_to_json

#: Data folders a table may have before a merge compacts the small ones among them.
MOST_FOLDERS = 32


class CommitConflict(RuntimeError):
    """Another writer made the version that this commit was to make; nothing of it counts."""


@dataclass(frozen=True)
class Version:
    """What counts: data folders with (rows, deleted rows), folders of places with the data folders they speak of, rejects."""

    number: int = 0
    schema: str = ""
    folders: dict[str, tuple[int, int]] = field(default_factory=dict)
    deletes: dict[str, list[str]] = field(default_factory=dict)
    rejects: dict[str, int] = field(default_factory=dict)
    state: str = ""
    #: the newest run of each writer, with what it did
    runs: dict[str, dict] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n - gone for n, gone in self.folders.values())


@dataclass(frozen=True)
class Run:
    """One run of one writer; a run with a number not above the writer's newest is not applied again."""

    writer: str
    number: int
    note: str = ""


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ()) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._fs_path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _load(self, name: str) -> Version:
        stream = self._fs.open(self._fs_path(f"{self.root}/versions/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        raw = json.loads(text)
        return Version(**{**raw, "folders": {k: tuple(v) for k, v in raw["folders"].items()}})

    def version(self) -> Version:
        """The newest version; number 0 and no folders if there is none."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        return self._load(names[-1]) if names else Version()

    def _publish(self, new: Version) -> Version:
        """Make ``new`` the newest version, or fail if another writer was first."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        final, temp = (self._fs_path(f"{self.root}/versions/{n}") for n in (f"{new.number:020d}.json", f".{uuid.uuid4().hex}"))
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(new.__dict__, ensure_ascii=False).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: never replace
        try:
            context.rename(temp, final, options)
        except Exception as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExistsException" in str(e):
                raise CommitConflict(f"version {new.number} of {self.root} exists") from None
            raise
        return new

    def history(self) -> list[Version]:
        """All versions that are still there, oldest first."""
        return [self._load(n) for n in self._names("versions") if n.endswith(".json")]

    # --- reading ---------------------------------------------------------------

    def _scan(self, kind: str, names: Iterable[str], schema: T.StructType | str) -> DataFrame:
        names = [f"{self.root}/{kind}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _placed(self, version: Version, names: Iterable[str]) -> DataFrame:
        """Rows of data folders with their places, deleted ones included."""
        df = self._scan("data", names, T.StructType.fromJson(json.loads(version.schema)))
        if not names:
            return df.withColumns({"__file": F.lit(""), "__row": F.lit(0).cast("long")})
        return df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def _live(self, version: Version, names: Iterable[str]) -> DataFrame:
        """Rows with their places; only folders with deleted rows are joined with them."""
        names = list(names)
        touched = [n for n in names if version.folders[n][1]]
        parts = [self._placed(version, [n for n in names if n not in touched])]
        if touched:
            places = self._scan("deletes", [d for d, of in version.deletes.items() if set(of) & set(touched)], "file string, row long")
            rows = self._placed(version, touched)
            parts.append(rows.join(places, (F.col("__file") == F.col("file")) & (F.col("__row") == F.col("row")), "left_anti"))
        return reduce(DataFrame.unionByName, parts[1:] if touched and len(touched) == len(names) else parts)

    def read(self, version: Version | None = None) -> DataFrame:
        """The table as of a version (the newest, if none is given)."""
        version = version or self.version()
        if not version.schema:
            raise ValueError(f"no table in {self.root}")
        return self._live(version, version.folders).drop("__file", "__row")

    def rejects(self) -> DataFrame:
        version = self.version()
        return self._scan("rejects", version.rejects, T.StructType.fromJson(json.loads(version.schema)).add("reason", "string"))

    def state(self) -> tuple[FilterCondition, ...]:
        """The watermark of the newest version."""
        return conditions_from_json(self.version().state)

    # --- writing ---------------------------------------------------------------

    def _write(self, kind: str, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.mode("error").parquet(f"{self.root}/{kind}/{name}")
        return name

    def _advanced(self, state: Sequence[FilterCondition], got: dict) -> str:
        """The larger of old and observed watermark, compared by type."""
        new = []
        for i, c in enumerate(state):
            high = got.get(f"m{i}")
            if high is not None:
                a, b = (typed_literal(replace(c, value=v)) for v in (high, c.value))
                # constants only: folded by the optimizer, no job
                later = self.spark.sql("select * from values (1) one(one)").select(F.coalesce(a > b, F.lit(True))).first()[0]
                c = replace(c, value=high) if later else c
            new.append(c)
        return conditions_to_json(new) if new else ""

    def _done(self, old: Version, run: Run | None) -> int | None:
        """Rows of a run that has been applied before."""
        known = old.runs.get(run.writer) if run else None
        return known["rows"] if known and known["number"] >= run.number else None

    def _next(self, old: Version, run: Run | None, rows: int, **changes) -> Version:
        runs = old.runs | ({run.writer: {"number": run.number, "rows": rows, "note": run.note}} if run else {})
        return replace(old, number=old.number + 1, runs=runs, **changes)

    def merge(
        self, batch: DataFrame, order_by: Sequence[str] = (), state: Sequence[FilterCondition] = (), run: Run | None = None,
        reason: str | None = None, helper: str | None = None, whole: bool = False, step: Callable[[str], None] = lambda name: None,
    ) -> int:
        """Keyed replace: a row of the batch takes the place of the old row with its key. Returns the rows of the batch.

        With ``whole`` the table then holds the batch and nothing else, in the batch's columns; readers see the old
        content until all is written.

        Of batch rows that share a key the first by ``order_by`` descending, then by hash, wins. Rows with a NULL key
        go to the rejects, as do rows whose ``reason`` column is not NULL. ``reason`` and ``helper`` name columns of the
        batch that are no part of the table; the latter may stand in ``order_by``.
        Without keys all rows are added. ``state`` is the watermark to start from if the table has none; it advances to
        the maxima of the rows placed. A batch without rows makes no version unless a run or rejects are to be noted.
        ``step`` is told what has been written (for tests of runs that die).
        """
        old = self.version()
        if (known := self._done(old, run)) is not None:
            return known
        state = conditions_from_json(old.state) or tuple(state)
        columns = [c for c in batch.columns if c not in (reason, helper)]
        schema = json.dumps(T.StructType([replace_nullable(batch.schema[c]) for c in columns]).jsonValue())
        if old.schema and old.schema != schema and not whole:
            raise ValueError("the batch has other columns than the table")
        lost = reduce(or_, [F.col(k).isNull() for k in self.keys], F.lit(False))
        bad = lost | (F.col(reason).isNotNull() if reason else F.lit(False))
        types, seen = dict(batch.dtypes), Observation()
        maxima = [as_watermark_text(F.max(F.when(~bad, F.col(c.column))), types[c.column]).alias(f"m{i}") for i, c in enumerate(state)]
        rows = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), *maxima).where(~bad)
        if self.keys:
            hashable = [c for c in columns if not isinstance(batch.schema[c].dataType, T.MapType)]
            first = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in order_by], F.xxhash64(*hashable))
            rows = rows.select(*columns, F.row_number().over(first).alias("__rank")).where("__rank = 1")
        placed, seen_placed = rows.select(*columns), Observation()
        edges = [f(k).alias(f"{f.__name__}_{k}") for k in self.keys for f in (F.min, F.max)]
        name = self._write("data", placed.observe(seen_placed, F.count(F.lit(1)).alias("n"), *edges))
        step("data")
        got, put = seen.get, seen_placed.get
        changes: dict = {"schema": schema, "state": self._advanced(state, got)}
        rejects = {} if whole else dict(old.rejects)
        if got["bad"]:
            why = F.coalesce(*([F.col(reason)] if reason else []), F.lit("no key"))
            rejects[self._write("rejects", batch.where(bad).select(*columns, why.alias("reason")))] = got["bad"]
            step("rejects")
        folders, deletes = ({}, {}) if whole else (dict(old.folders), dict(old.deletes))
        if put["n"]:
            if self.keys and folders:
                folders, deletes = self._replaced(old, name, put)
                step("deletes")
            folders[name] = (put["n"], 0)
        if not (put["n"] or got["bad"] or run or whole) and old.number:
            return 0
        new = self._publish(self._next(old, run, got["rows"], folders=folders, deletes=deletes, rejects=rejects, **changes))
        step("version")
        if len(new.folders) > MOST_FOLDERS:
            self.compact()
        return got["rows"]

    def _replaced(self, old: Version, name: str, edges: dict) -> tuple[dict, dict]:
        """Write the places of rows whose keys the new folder has; returns folders and deletes of the next version."""
        keys = self._scan("data", [name], T.StructType.fromJson(json.loads(old.schema))).select(*self.keys)
        low_high = [F.col(k).between(F.lit(edges[f"min_{k}"]), F.lit(edges[f"max_{k}"])) for k in self.keys]
        rows = self._live(old, old.folders).where(reduce(and_, low_high))  # reaches the scan
        # every data folder has one write, so the name of a file leads to its folder
        hit = rows.join(keys, self.keys, "left_semi").select("__file", "__row")
        owners = {f: n for n in old.folders for f in self._names(f"data/{n}")}
        counted = Observation()
        places = hit.select(F.col("__file").alias("file"), F.col("__row").alias("row"))
        gone = self._write("deletes", places.observe(counted, F.count(F.lit(1)).alias("n")))
        if not counted.get["n"]:
            return dict(old.folders), dict(old.deletes)
        per_file = self._scan("deletes", [gone], "file string, row long").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per file
        folders, of = dict(old.folders), set()
        for r in per_file:
            n = owners[r["file"]]
            folders[n] = (folders[n][0], folders[n][1] + r["n"])
            of.add(n)
        # folders without a row left are not read any more
        empty = {n for n, (rows, deleted) in folders.items() if rows == deleted}
        folders = {n: v for n, v in folders.items() if n not in empty}
        deletes = {d: [n for n in o if n in folders] for d, o in (old.deletes | {gone: sorted(of)}).items()}
        return folders, {d: o for d, o in deletes.items() if o}

    def compact(self, deleted: float = 0.25, small: float = 0.05) -> int:
        """Rewrite folders of which a share ``deleted`` or more is gone, or that hold under ``small`` of the largest's rows.

        Returns how many were rewritten. Rows stay as they are; runs, watermark and rejects too.
        """
        old = self.version()
        largest = max((n - gone for n, gone in old.folders.values()), default=0)
        tiny = [f for f, (n, gone) in old.folders.items() if n - gone < small * largest]
        picked = [f for f, (n, gone) in old.folders.items() if gone and gone >= deleted * n or f in tiny and len(tiny) > 1]
        if not picked:
            return 0
        seen = Observation()
        rows = self._live(old, picked).drop("__file", "__row")
        name = self._write("data", rows.observe(seen, F.count(F.lit(1)).alias("n")))
        folders = {f: v for f, v in old.folders.items() if f not in picked} | {name: (seen.get["n"], 0)}
        deletes = {d: kept for d, of in old.deletes.items() if (kept := [f for f in of if f in folders])}
        self._publish(replace(old, number=old.number + 1, folders=folders, deletes=deletes))
        return len(picked)

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Delete versions but the newest ``keep``, and folders older than that many seconds that none of those names."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        used = set()
        for v in map(self._load, names[-keep:]):
            used |= {*v.folders, *v.deletes, *v.rejects}
        for n in names[:-keep]:
            self._fs.delete(self._fs_path(f"{self.root}/versions/{n}"), False)
        gone, limit = 0, (time.time() - older_than) * 1000
        for kind in ("data", "deletes", "rejects"):
            path = self._fs_path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(path) if self._fs.exists(path) else ():
                if s.getPath().getName() not in used and s.getModificationTime() <= limit:
                    gone += self._fs.delete(s.getPath(), True)
        return gone


def replace_nullable(f: T.StructField) -> T.StructField:
    """The field as a Parquet table has it: nullable, without metadata."""
    return T.StructField(f.name, f.dataType, True)
