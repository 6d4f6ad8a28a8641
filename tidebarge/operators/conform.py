"""Schemas across the three type systems: source, warehouse, Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, text, times, wkb
from ..plans.specs import PULL_STAMP, ColumnDescriptor

# source type -> (warehouse type, Spark type). Fixed values.
SOURCE_TYPES = {
    "tinyint unsigned": ("UInt8", "smallint"),
    "tinyint": ("Int8", "tinyint"),
    "smallint unsigned": ("UInt16", "int"),
    "smallint": ("Int16", "smallint"),
    "int unsigned": ("UInt32", "bigint"),
    "mediumint unsigned": ("UInt32", "bigint"),
    "int": ("Int32", "int"),
    "mediumint": ("Int32", "int"),
    "bigint unsigned": ("UInt64", "decimal(20,0)"),
    "bigint": ("Int64", "bigint"),
    "float": ("Float32", "float"),
    "double": ("Float64", "double"),
    "date": ("Date", "date"),
}

# warehouse type -> target type. Fixed values.
TARGET_TYPES = {
    "UInt8": "tinyint unsigned",
    "Int8": "tinyint",
    "UInt16": "smallint unsigned",
    "Int16": "smallint",
    "UInt32": "int unsigned",
    "Int32": "int",
    "UInt64": "bigint unsigned",
    "Int64": "bigint",
    "Float32": "float",
    "Float64": "double",
    "Date": "date",
}
VARCHAR_LIMIT = 65535


def decimal_width(precision: Column) -> Column:
    """Storage width of a decimal by its precision; above 38 digits Spark needs text."""
    return (
        F.when(precision.between(1, 9), F.lit(32))
        .when(precision <= 19, F.lit(64))
        .when(precision <= 38, F.lit(128))
        .when(precision <= 76, F.lit(256))
    )


def _decimal_bits(precision: int) -> int:
    return 32 if precision <= 9 else 64 if precision <= 19 else 128 if precision <= 38 else 256


def warehouse_type(d: ColumnDescriptor) -> tuple[str, str]:
    """(warehouse type, Spark type) of a source column."""
    if d.data_type.startswith("decimal"):
        spark = f"decimal({d.precision},{d.scale})" if d.precision <= 38 else "string"
        name = f"Decimal{_decimal_bits(d.precision)}({d.scale})"
    elif d.data_type.startswith(("datetime", "timestamp")):
        name, spark = f"DateTime64({d.precision})", "timestamp"
    else:
        name, spark = SOURCE_TYPES.get(d.data_type, ("String", "string"))
    return (f"Nullable({name})" if d.is_nullable else name), spark


def target_type(d: ColumnDescriptor) -> str:
    """Column type in the push target."""
    t = d.data_type
    if t.startswith("DateTime"):
        return "varchar(50)" if d.precision > 6 else f"datetime({d.precision})"
    if t.startswith("Decimal"):
        return "text" if d.precision > 65 or d.scale > 30 else f"decimal({d.precision},{d.scale})"
    if t == "String":
        # a String of unknown length would be a bare varchar, which no target accepts
        return f"varchar({d.max_length})" if 0 < d.max_length <= VARCHAR_LIMIT else "text"
    return TARGET_TYPES.get(t, "text")


def create_table_column_types(columns: Sequence[ColumnDescriptor]) -> str:
    """Value for the JDBC writer's ``createTableColumnTypes`` option."""
    return ", ".join(f"{d.output_name} {target_type(d)}" for d in columns)


def spark_schema(columns: Sequence[ColumnDescriptor]) -> T.StructType:
    """Spark schema of the warehouse table of these source columns, with the load stamp."""
    schema = T.StructType()
    for d in columns:
        name, spark = warehouse_type(d)
        meta = {"warehouse_type": name, "is_key": d.is_key, "max_length": d.max_length, "comment": d.comment}
        schema.add(d.output_name, T._parse_datatype_string(spark), d.is_nullable, meta)
    return schema.add(PULL_STAMP, T.LongType(), False)


def conform_to_warehouse(df: DataFrame, columns: Sequence[ColumnDescriptor], pull_time: int) -> DataFrame:
    """Cast to warehouse types and stamp; a value that does not fit becomes NULL (see ``cast_table`` for rejects)."""
    picked = [F.col(d.column_code).try_cast(warehouse_type(d)[1]).alias(d.output_name) for d in columns]
    return df.select(*picked, F.lit(pull_time).cast("bigint").alias(PULL_STAMP))


_TARGET_CASTS = {
    "tinyint unsigned": "smallint",
    "tinyint": "tinyint",
    "smallint unsigned": "int",
    "smallint": "smallint",
    "int unsigned": "bigint",
    "int": "int",
    "bigint unsigned": "decimal(20,0)",
    "bigint": "bigint",
    "float": "float",
    "double": "double",
    "date": "date",
}


def conform_to_target(df: DataFrame, columns: Sequence[ColumnDescriptor]) -> DataFrame:
    """Typed select for the push target; long texts and wide values are text."""

    def cast_to(d: ColumnDescriptor) -> str:
        t = target_type(d)
        if t.startswith("decimal"):
            return t if d.precision <= 38 else "string"
        if t.startswith("datetime"):
            return "timestamp"
        return _TARGET_CASTS.get(t, "string")

    return df.select(*[F.col(d.column_code).try_cast(cast_to(d)).alias(d.output_name) for d in columns])


def coarse_type(data_type: Column) -> Column:
    """Spark type name to the four result classes int, float, datetime, string."""
    return (
        F.when(data_type.isin("tinyint", "smallint", "int", "bigint"), F.lit("int"))
        .when(data_type.isin("float", "double") | data_type.startswith("decimal"), F.lit("float"))
        .when(data_type.isin("date", "timestamp", "timestamp_ntz"), F.lit("datetime"))
        .otherwise(F.lit("string"))
    )


_CHECKED = {"uuid": text.valid_uuid, "ipv4": text.valid_ipv4, "ipv6": text.valid_ip}
_EMPTY = {
    "wkt": "string",
    "array": "array<string>", "map": "map<string,string>", "point": "struct<x:double,y:double>", "uuid": "string",
    "ipv4": "string", "ipv6": "string",
}


def _cast_for(want: str, col: Column, kind: str) -> casts.Cast:
    if want.startswith("int"):
        return casts.cast_signed(col, int(want[3:]), kind)
    if want.startswith("uint"):
        return casts.cast_unsigned(col, int(want[4:]), kind)
    if want.startswith("float"):
        return casts.cast_float(col, int(want[5:]), kind)
    if want == "text":
        return casts.cast_text(col, kind)
    if want == "wkt" and kind in ("binary", "text"):
        return wkb.cast_wkt(col, kind)
    if want == "bool":
        return casts.cast_bool_strict(col, kind)
    if want in ("time", "date"):
        if kind in ("other", "bool"):
            return F.lit(None).cast("timestamp"), F.when(col.isNotNull(), F.lit(casts.UNSUPPORTED))
        value, reason = times.parse_time(col.cast("string") if kind == "binary" else col, kind)
        return (value.cast("date") if want == "date" else value), reason
    if want.startswith("decimal("):
        precision, scale = (int(x) for x in want[8:-1].split(","))
        return casts.cast_decimal(col, precision, scale, kind)
    if kind == "other" and want in ("array", "map"):
        return col, F.lit(None).cast("string")
    if kind == "text" and want == "array":
        return text.split_array(col), F.lit(None).cast("string")
    if kind == "text" and want == "point":
        return text.parse_point(col)
    if kind == "text" and want in _CHECKED:
        return casts.cast_checked(col, _CHECKED[want](col), f"not a valid {want}")
    if want in _EMPTY:
        return F.lit(None).cast(_EMPTY[want]), F.when(col.isNotNull(), F.lit(casts.UNSUPPORTED))
    raise ValueError(f"unknown type {want}")


def cast_table(
    df: DataFrame, wanted: dict[str, str], row_id: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """Cast every column of ``wanted`` in one projection.

    Types: int8..int64, uint8..uint64, float32, float64, decimal(p,s), text, bool, time, date, uuid, ipv4,
    ipv6, point, wkt, array, map.

    Adds ``rejects``: one ``(column, reason)`` per value that does not fit, empty
    for a good row. ``good_rows`` and ``rejected_values`` split the result; to
    write both without casting twice, write it once (``sinks.tables.write_split``).
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    values, reasons = [], []
    for name, want in wanted.items():
        dtype = fields[name]
        is_time = isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
        kind = "time" if want in ("time", "date") and is_time else casts.kind_of(dtype)
        value, reason = casts.required(_cast_for(want, F.col(name), kind), F.col(name), name not in required)
        values.append(value.alias(name))
        reasons.append(F.when(reason.isNotNull(), F.struct(F.lit(name).alias("column"), reason.alias("reason"))))
    kept = [c for c in row_id if c not in wanted]
    return df.select(*kept, *values, F.array_compact(F.array(*reasons)).alias("rejects"))


def good_rows(cast: DataFrame) -> DataFrame:
    return cast.where(F.size("rejects") == 0).drop("rejects")


def rejected_values(cast: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """``(row_id..., column, reason)`` per rejected value. Every row is good or in here."""
    return cast.select(*row_id, F.inline("rejects"))
