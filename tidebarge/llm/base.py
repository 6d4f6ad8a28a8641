"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, free_name, fresh_path, prepare, shared_root, shuffle_width
from ..sources.tables import table

__all__ = [
    "bounded_batches", "cut_lineage", "free_name", "fresh_path", "prepare", "put", "shared_root", "shielded",
    "shuffle_width", "table", "uniform", "without",
]

#: Bytes of one Arrow batch sent to a Python worker; a batch always holds at least one row.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that many long texts in a row fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, whatever their case; results take their place."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; an input column of the same name (in any case) is replaced."""
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    return df.select(*keep, *[v.alias(k) for k, v in columns.items()])


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keep an operator's work columns, all named ``__...``, apart from columns of its first frame that are named so.

    Those get plain names for the time of the call, also where they are named by an argument, and their own names after it.
    Without such columns the call is the operator's own.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        odd = [c for c in df.columns if c.startswith("__")]
        if not odd:
            return operator(df, *args, **kwargs)
        taken, plain = {c.lower() for c in df.columns}, {}
        for i, c in enumerate(odd):
            name = f"shielded_{i}"
            while name in taken:
                name += "_"
            plain[c] = name
        named = lambda v: plain.get(v, v) if isinstance(v, str) else v
        renamed = df.select(*[F.col(f"`{c}`").alias(plain.get(c, c)) for c in df.columns])
        out = operator(renamed, *map(named, args), **{k: named(v) for k, v in kwargs.items()})
        back = {v: k for k, v in plain.items()}
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])

    return run


def uniform(*parts) -> Column:
    """A number in [0, 1) fixed by the parts: the same in every run and for every partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))
