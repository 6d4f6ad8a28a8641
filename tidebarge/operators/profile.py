"""Table inventory and column profiles, each in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_inventory(tables: dict[str, DataFrame], comments: dict[str, str] | None = None) -> DataFrame:
    """One row per table: name, comment, rows. Counts read no column data (Parquet footers)."""
    comments = comments or {}
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_code"), F.lit(comments.get(name, "")).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def catalog_inventory(spark, database: str | None = None) -> DataFrame:
    """Tables known to the session catalog, with their comments."""
    rows = [(t.name, t.description or "") for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table_code string, table_name string")


def _digits(dtype: T.DataType) -> tuple[int, int]:
    """Precision and scale as a catalog declares them; time types count their fraction digits."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision, dtype.scale
    known = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19, T.FloatType: 12, T.DoubleType: 22}
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return 6, 0
    return known.get(type(dtype), 0), 0


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_profile(df: DataFrame, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """Column descriptors from the schema plus measured length, NULLs and rows.

    One aggregate over the table (combined map-side), then turned to rows. The
    expressions are SQL text: a wide table would take thousands of Column calls.
    """
    measures, rows = ["count(1) as __rows"], []
    for i, f in enumerate(df.schema.fields):
        name = "`" + f.name.replace("`", "``") + "`"
        sized = isinstance(f.dataType, (T.StringType, T.BinaryType))
        measures.append(f"cast({f'coalesce(max(length({name})), 0)' if sized else '0'} as bigint) as __len{i}")
        measures.append(f"count_if({name} is null) as __null{i}")
        precision, scale = _digits(f.dataType)
        rows.append(
            f"named_struct('table_code', {_text(table)}, 'column_code', {_text(f.name)}, 'ordinal', {i + 1}, "
            f"'data_type', {_text(f.dataType.simpleString())}, 'is_key', {str(f.name in keys).lower()}, "
            f"'max_length', __len{i}, 'precision', {precision}, 'scale', {scale}, 'has_null', __null{i} > 0, "
            f"'null_count', __null{i}, 'row_count', __rows, 'comment', {_text((f.metadata or {}).get('comment', ''))})"
        )
    return df.selectExpr(*measures).selectExpr(f"inline(array({', '.join(rows)}))")


def profile_tables(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [column_profile(df, n, keys.get(n, ())) for n, df in tables.items()])
