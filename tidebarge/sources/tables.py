"""Reading Parquet tables and running user SELECTs over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import _TIME_TYPES, typed_literal
from ..operators.governance import RESERVED_WORDS, sql_safety, table_names
from ..plans.specs import FilterCondition


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bind_values(spark: SparkSession, conditions: Iterable[FilterCondition]) -> list:
    """Typed values of a watermark for the ``?`` marks of a SELECT, in order.

    A time is bound as text in one fixed form: Spark turns a text literal into
    the type of the column it is compared with, so the filter reaches the scan.
    """
    conditions = list(conditions)
    if not conditions:
        return []
    typed = [
        F.date_format(typed_literal(c), "yyyy-MM-dd HH:mm:ss.SSSSSS") if c.data_type in _TIME_TYPES else typed_literal(c)
        for c in conditions
    ]
    # one row of configuration, not data
    row = spark.sql("select * from values (1) one(one)").select(*[t.alias(f"v{i}") for i, t in enumerate(typed)]).first()
    for c, v in zip(conditions, row):
        if v is None and c.data_type in _TIME_TYPES:
            raise ValueError(f"cannot read {c.value!r} as a time")
    return list(row)


def check_select(spark: SparkSession, sql: str, reserved: Iterable[str] = RESERVED_WORDS) -> None:
    """Refuse a statement that is unsafe, names no table, or names one by a reserved word."""
    statement = spark.sql("select * from values (1) one(one)").select(F.lit(sql).alias("sql"))  # the audits' own expressions, on one row
    hits, names = (
        sql_safety(statement, "sql").select("hits", table_names(F.col("sql")).alias("names")).first()
    )
    if hits:
        raise ValueError(f"unsafe statement: {', '.join(hits)}")
    if not names:
        raise ValueError("the statement names no table")
    refused = sorted({n.upper() for n in names} & {w.upper() for w in reserved})
    if refused:
        raise ValueError(f"table named by a reserved word: {', '.join(refused)}")


def run_select(
    spark: SparkSession,
    sql: str,
    conditions: Sequence[FilterCondition] = (),
    views: dict[str, DataFrame] | None = None,
    check: bool = True,
) -> DataFrame:
    """A user SELECT over the session's tables, or over ``views``, with the watermark bound to its marks."""
    if check:
        check_select(spark, sql)
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    args = bind_values(spark, conditions)
    return spark.sql(sql, args=args) if args else spark.sql(sql)
