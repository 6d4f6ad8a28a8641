"""Projections that carry a table from one type system to the other.

Pull side: source types to warehouse types. Push side: warehouse types to
target types. One small function per rule; a descriptor picks the first rule
that fits its type name. All rules are built-in expressions in one ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wkb import wkb_text
from ..plans.specs import ColumnDescriptor

# type names by family. Fixed values.
BINARY_EXACT = ("blob", "tinyblob", "mediumblob", "longblob")
TEXT_EXACT = ("text", "tinytext", "mediumtext", "longtext")
GEOMETRY_PREFIXES = ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon")
PLAIN_PREFIXES = ("tinyint", "smallint", "mediumint", "int", "bigint", "float", "double", "char", "varchar")

WAREHOUSE_DECIMAL_DIGITS = 38
WAREHOUSE_TIME_DIGITS = 9
TARGET_DECIMAL_DIGITS = 65
TARGET_DECIMAL_SCALE = 30
TARGET_TIME_DIGITS = 6


def unchanged(col: Column) -> Column:
    return col


def as_text(col: Column) -> Column:
    return col.cast("string")


def datetime_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def time_text(col: Column) -> Column:
    """Time of day; the warehouse has no type for it."""
    return F.date_format(col, "HH:mm:ss.SSSSSS")


def year_text(col: Column) -> Column:
    return F.year(col).cast("string")


def bit_text(col: Column) -> Column:
    return F.bin(col)


def base64_text(col: Column) -> Column:
    """Base64 in one line (Spark puts line breaks into long values)."""
    return F.replace(F.base64(col), F.lit("\r\n"), F.lit(""))


def json_text(col: Column) -> Column:
    """The JSON document as text; a bare JSON string loses its quotes."""
    return F.get_json_object(col, "$")


def point_wkt(col: Column) -> Column:
    """WKT of a point struct. Bytes of any geometry and ready text are taken as well, see ``_converted``."""
    return F.concat(
        F.lit("POINT("), col["x"].cast("string"), F.lit(" "), col["y"].cast("string"), F.lit(")")
    )


def json_of(col: Column) -> Column:
    """Arrays, maps and structs as JSON text."""
    return F.to_json(col)


def fixed_string_text(col: Column) -> Column:
    """Text of a fixed-width string without its zero padding."""
    return F.rtrim(col.cast("string"), F.lit("\x00"))


def pull_rule(d: ColumnDescriptor):
    """First matching pull-side rule for a source column."""
    t = d.data_type
    if t.startswith("decimal"):
        return as_text if d.precision > WAREHOUSE_DECIMAL_DIGITS else unchanged
    if t.startswith(("datetime", "timestamp")):
        return datetime_text if d.precision > WAREHOUSE_TIME_DIGITS else unchanged
    if t.startswith("time"):
        return time_text
    if t.startswith("year"):
        return year_text
    if t.startswith("bit"):
        return bit_text
    if t.startswith(("enum", "set")):
        return as_text
    if t.startswith(("binary", "varbinary")) or t in BINARY_EXACT:
        return base64_text
    if t == "json":
        return json_text
    if t.startswith(GEOMETRY_PREFIXES):
        return point_wkt
    if t.startswith(PLAIN_PREFIXES) or t == "date" or t in TEXT_EXACT:
        return unchanged
    return as_text


def push_rule(d: ColumnDescriptor):
    """First matching push-side rule for a warehouse column."""
    t = d.data_type
    if t.startswith("Enum") and d.labels:
        return label_of(dict(d.labels))
    if t.startswith("DateTime"):
        return as_text if d.precision > TARGET_TIME_DIGITS else unchanged
    if t.startswith("Decimal"):
        wide = d.precision > TARGET_DECIMAL_DIGITS or d.scale > TARGET_DECIMAL_SCALE
        return as_text if wide else unchanged
    if t.startswith(("Array", "Map", "Tuple")):
        return json_of
    if t.startswith("FixedString"):
        return fixed_string_text
    if t.startswith(("Int", "UInt", "Float")) or t in ("String", "Date"):
        return unchanged
    return as_text


def _project(df: DataFrame, columns: Sequence[ColumnDescriptor], rule) -> DataFrame:
    if not columns:
        raise ValueError("no columns chosen")
    types = dict(df.dtypes)
    return df.select(*[_converted(d, types[d.column_code], rule).alias(d.output_name) for d in columns])


def _converted(d: ColumnDescriptor, dtype: str, rule) -> Column:
    """A column by its rule, from whatever type the source's driver delivers it in."""
    col = F.col(d.column_code)
    if rule is pull_rule and d.data_type.startswith("bit"):
        if dtype == "boolean":
            col = col.cast("int")
        elif dtype == "binary":
            col = F.conv(F.hex(col), 16, 10).cast("bigint")
    if rule is pull_rule and d.data_type.startswith(GEOMETRY_PREFIXES) and dtype == "string":
        return col  # the SELECT has made text of it
    if rule is pull_rule and d.data_type.startswith(GEOMETRY_PREFIXES) and dtype == "binary":
        return wkb_text(col)
    return rule(d)(col)


def normalize_pull(df: DataFrame, columns: Sequence[ColumnDescriptor]) -> DataFrame:
    """The chosen source columns, converted and renamed for the warehouse."""
    return _project(df, columns, pull_rule)


def normalize_push(df: DataFrame, columns: Sequence[ColumnDescriptor]) -> DataFrame:
    """The chosen warehouse columns, converted and renamed for the target."""
    return _project(df, columns, push_rule)


def label_of(labels: dict[int, str]):
    """Rule from an enum's number to its label. The labels are part of the column's type, so they are a literal map."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return lambda col: F.try_element_at(table, col.cast("int"))


def enum_label(df: DataFrame, column: str, labels: dict[int, str]) -> DataFrame:
    """Enum numbers of one column to labels."""
    return df.withColumn(column, label_of(labels)(F.col(column)))


def insert_columns(select_df: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """The result columns of a push SELECT, in its own order, checked against the target."""
    if not select_df.columns:
        raise ValueError("the SELECT has no columns")
    missing = [c for c in select_df.columns if c not in target_columns]
    if missing:
        raise ValueError(f"columns not in the target: {missing}")
    return select_df.select(*select_df.columns)
