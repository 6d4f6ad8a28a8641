"""Predicates and typed parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..plans.specs import FilterCondition

_FILTER_TYPES = {"string": "string", "integer": "bigint", "float": "double"}
_TIME_TYPES = ("date", "datetime", "timestamp")


def typed_literal(c: FilterCondition) -> Column:
    """The condition's value as a constant of its declared type; an unknown type is NULL."""
    text = F.lit(c.value)
    if c.data_type in _TIME_TYPES:
        return times.parse_time(text)[0]
    if c.data_type in _FILTER_TYPES:
        return text.cast(_FILTER_TYPES[c.data_type])
    return F.lit(None)


def equals_all(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c) == F.lit(v) for c, v in values.items()]))


def since(df: DataFrame, conditions: Iterable[FilterCondition], inclusive: bool = False) -> DataFrame:
    """Rows after (or from) the watermark on every condition column.

    The value is a folded constant compared with the bare column, so the filter
    reaches the scan. A value that is no value of its type, or an unknown type, is an error.
    """
    conditions = list(conditions)
    types = dict(df.dtypes)
    # one constant row, folded by the optimizer without a job: a value that cannot be read must not look like a watermark without rows
    values = df.sparkSession.sql("select * from values (1) one(one)").select(*[typed_literal(c).alias(f"v{i}") for i, c in enumerate(conditions)]).first()
    for c, v in zip(conditions, values):
        if v is None:
            raise ValueError(f"cannot read {c.value!r} as {c.data_type}")

    def bound(c: FilterCondition) -> Column:
        # compare in the column's own type: a cast on the column would block pushdown
        value = typed_literal(c).cast(types[c.column])
        return F.col(c.column) >= value if inclusive else F.col(c.column) > value

    return df.where(reduce(and_, [bound(c) for c in conditions]))


def typed_values(df: DataFrame, data_type: str, value: str) -> DataFrame:
    """Watermark rows with their text value in typed columns; the type's own column is filled."""
    v, t = F.col(value), F.col(data_type)
    return df.select(
        "*",
        F.when(t == "string", v).alias("string_value"),
        F.when(t == "integer", v.try_cast("bigint")).alias("integer_value"),
        F.when(t == "float", v.try_cast("double")).alias("float_value"),
        F.when(t.isin(*_TIME_TYPES), times.parse_time(v)[0]).alias("time_value"),
    )


def contains_any(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows where any of the columns holds its text (``LIKE '%x%'`` joined by OR)."""
    return df.where(reduce(or_, [F.col(c).contains(x) for c, x in wanted.items()]))


def with_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """Rows of one status; all rows when no status is asked for."""
    return df if not status else df.where(F.col(column) == status)


def in_id_list(df: DataFrame, column: str, ids) -> DataFrame:
    """Rows whose id is in a list (pushed to the scan) or in a frame of ids (semi join); the caller chooses by what it passes."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi").select(*df.columns)
    return df.where(F.col(column).isin(list(ids)))


def system_log(df: DataFrame, log_date: str, types: Sequence[str], locate: str) -> DataFrame:
    return df.where(
        (F.col("log_date") == log_date) & F.col("log_type").isin(list(types)) & (F.col("log_locate") == locate)
    )


def outside_skip_hours(df: DataFrame, column: str, hours: Sequence[int]) -> DataFrame:
    """Drop triggers that fall into a listed hour (UTC): such a run moves nothing. A trigger without a time stays."""
    return df if not hours else df.where(~F.hour(column).isin(list(hours)) | F.col(column).isNull())
