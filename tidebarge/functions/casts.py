"""Typed casts with rejects: every cast returns ``(value, reason)``.

``value`` is NULL exactly when ``reason`` is set or the input is NULL, so one
bad value costs its row a reject entry instead of failing the load. Everything
is a column expression and stays inside code generation.

``kind`` says what the input column holds: ``text``, ``integer`` or ``float``
(decimals are read as text).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSUPPORTED = "unsupported type"
OUT_OF_RANGE = "value out of range"
INVALID_FLOAT = "invalid float for integer conversion"
NOT_A_NUMBER = "not a number"

BLANKS = " \t\n\r\x0b\x0c"
FLOAT32_MAX = 3.4028234663852886e38

# widths with a Spark type that holds every value
SIGNED_TYPES = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
UNSIGNED_TYPES = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}

FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
FLOAT_SPECIAL = r"(?i)^([+-]?inf(inity)?|nan)\z"

Cast = tuple[Column, Column]


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, (T.StringType, T.DecimalType)):
        return "text"
    return "other"


def _settle(col: Column, value: Column, reason: Column) -> Cast:
    return F.when(col.isNotNull() & reason.isNull(), value), reason


def _unsupported(col: Column, dtype: str) -> Cast:
    return F.lit(None).cast(dtype), F.when(col.isNotNull(), F.lit(UNSUPPORTED))


def _to_integer(col: Column, kind: str, low: int, high: int, dtype: str, pattern: str) -> Cast:
    least, most = F.lit(Decimal(low)), F.lit(Decimal(high))
    if kind == "binary":
        col, kind = col.cast("string"), "text"
    if kind == "text":
        text = F.btrim(col.cast("string"), F.lit(BLANKS))
        number = text.try_cast("decimal(38,0)")
        # a run of digits too long for decimal(38,0) gives NULL: also out of range
        reason = F.when(~text.rlike(pattern), F.lit(NOT_A_NUMBER)).when(
            text.isNotNull() & (number.isNull() | (number < least) | (number > most)),
            F.lit(OUT_OF_RANGE),
        )
        return _settle(col, number.try_cast(dtype), reason)
    if kind == "integer":
        wide = col.cast("bigint")
        reason = F.when((wide < F.lit(low)) | (wide > F.lit(min(high, 2**63 - 1))), F.lit(OUT_OF_RANGE))
        return _settle(col, wide.try_cast(dtype), reason)
    if kind == "float":
        x = col.cast("double")
        floor_limit, top_limit = (-(2.0**63), 2.0**63) if low < 0 else (0.0, 2.0**64)
        broken = F.isnan(x) | (x < floor_limit) | (x >= top_limit) | (x != F.rint(x))
        whole = x.try_cast("decimal(20,0)")
        reason = F.when(broken, F.lit(INVALID_FLOAT)).when(
            (whole < least) | (whole > most), F.lit(OUT_OF_RANGE)
        )
        return _settle(col, whole.try_cast(dtype), reason)
    return _unsupported(col, dtype)


def cast_signed(col: Column, bits: int, kind: str = "text") -> Cast:
    """int8/16/32/64. Text is trimmed, floats must be whole, ranges are checked."""
    return _to_integer(col, kind, -(2 ** (bits - 1)), 2 ** (bits - 1) - 1, SIGNED_TYPES[bits], r"^[+-]?[0-9]+\z")


def cast_unsigned(col: Column, bits: int, kind: str = "text") -> Cast:
    """uint8/16/32/64 in the next wider Spark type; negatives are rejected and text takes no sign."""
    return _to_integer(col, kind, 0, 2**bits - 1, UNSIGNED_TYPES[bits], r"^[0-9]+\z")


def cast_float(col: Column, bits: int = 64, kind: str = "text") -> Cast:
    """float32/64. For float32 anything beyond its largest finite value is rejected."""
    dtype = "float" if bits == 32 else "double"
    if kind == "binary":
        col, kind = col.cast("string"), "text"
    if kind == "text":
        text = F.btrim(col.cast("string"), F.lit(BLANKS))
        special = text.rlike(FLOAT_SPECIAL)
        number = text.try_cast("double")
        overflow = (F.abs(number) == F.lit(float("inf"))) & ~special
        reason = F.when(~text.rlike(FLOAT_TEXT) & ~special, F.lit(NOT_A_NUMBER)).when(overflow, F.lit(OUT_OF_RANGE))
    elif kind in ("integer", "float"):
        number = col.cast("double")
        reason = F.lit(None).cast("string")
    else:
        return _unsupported(col, dtype)
    if bits == 32:
        reason = F.coalesce(
            reason, F.when(~F.isnan(number) & (F.abs(number) > FLOAT32_MAX), F.lit(OUT_OF_RANGE))
        )
    return _settle(col, number.cast(dtype), reason)


def plain_number_text(col: Column) -> Column:
    """Shortest text of a double without an exponent: 1.0E20 -> 100000000000000000000, 2.0 -> 2.

    Common magnitudes need no more than trimming; the digits are moved by hand
    only beyond what a decimal holds exactly.
    """
    size = F.abs(col)

    def trimmed(text: Column) -> Column:
        return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))

    return (
        F.when(F.isnan(col), F.lit("NaN"))
        .when(size == float("inf"), F.when(col > 0, F.lit("+Inf")).otherwise(F.lit("-Inf")))
        # Spark prints these without an exponent
        .when((size < 1e7) & ((size >= 1e-3) | (size == 0)), trimmed(col.cast("string")))
        # at most 17 significant digits, so ten decimals are enough from 10^7 on
        .when((size >= 1e7) & (size < 1e27), trimmed(col.cast("string").cast("decimal(38,10)").cast("string")))
        .otherwise(_shifted_digits(col.cast("string")))
    )


def _shifted_digits(text: Column) -> Column:
    """``d.dddE±n`` with n outside -3..26, written out."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)\z", 1).try_cast("int")
    fraction = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(F.substring_index(mantissa, ".", 1), fraction)
    large = F.concat(digits, F.repeat(F.lit("0"), exponent - F.length(fraction)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return F.concat(sign, F.when(exponent < 0, small).otherwise(large))


def cast_text(col: Column, kind: str) -> Cast:
    """Integers, floats (shortest form, no exponent), booleans and bytes to text."""
    if kind == "other":
        return _unsupported(col, "string")
    value = plain_number_text(col) if kind == "float" else col.cast("string")
    return value, F.lit(None).cast("string")


def cast_bool_strict(col: Column, kind: str) -> Cast:
    """Only a boolean is a boolean; text or a number is a reject."""
    if kind == "bool":
        return col, F.lit(None).cast("string")
    return _unsupported(col, "boolean")


def wrap_narrow_int(col: Column, bits: int) -> Column:
    """Keep the low ``bits`` bits as a signed number (200 -> -56 for 8 bits)."""
    span = 2**bits
    low = F.pmod(col.cast("bigint"), F.lit(span).cast("bigint"))
    return F.when(low >= span // 2, low - span).otherwise(low).cast(SIGNED_TYPES[bits])


def decimal_to_scaled_int(col: Column, scale: int) -> Cast:
    """Decimal text to an integer with ``scale`` digits of fraction: ``1.2`` -> 120 at scale 2.

    A fraction longer than the scale is rejected, never rounded or mis-scaled.
    """
    fraction = F.when(col.contains("."), F.substring_index(col, ".", -1)).otherwise(F.lit(""))
    joined = F.concat(F.substring_index(col, ".", 1), F.rpad(fraction, scale, "0"))
    number = joined.try_cast("bigint")
    reason = (
        F.when(col.rlike(r"\..*\."), F.lit("more than one decimal point"))
        .when(~col.rlike(r"^[+-]?[0-9]*\.?[0-9]*\z") | ~joined.rlike(r"[0-9]"), F.lit(NOT_A_NUMBER))
        .when(F.length(fraction) > scale, F.lit("fraction longer than scale"))
        .when(col.isNotNull() & number.isNull(), F.lit(OUT_OF_RANGE))
    )
    return _settle(col, number, reason)


def cast_decimal(col: Column, precision: int, scale: int, kind: str = "text") -> Cast:
    """decimal(p,s) up to 38 digits, from text or numbers. A longer fraction is rejected, not rounded."""
    text = plain_number_text(col) if kind == "float" else F.btrim(col.cast("string"), F.lit(BLANKS))
    fraction = F.when(text.contains("."), F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    number = text.try_cast(f"decimal({precision},{scale})")
    reason = (
        F.when(~text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"), F.lit(NOT_A_NUMBER))
        .when(F.length(fraction) > scale, F.lit("fraction longer than scale"))
        .when(text.isNotNull() & number.isNull(), F.lit(OUT_OF_RANGE))
    )
    return _settle(col, number, reason)


def cast_checked(col: Column, valid: Column, reason: str) -> Cast:
    """Text that must pass a check to be stored."""
    return F.when(valid, col), F.when(col.isNotNull() & ~valid, F.lit(reason))


def required(cast: Cast, col: Column, nullable: bool) -> Cast:
    """A NULL in a non-nullable column is a reject; in a nullable one it stays NULL."""
    value, reason = cast
    if nullable:
        return value, reason
    return value, F.coalesce(reason, F.when(col.isNull(), F.lit(UNSUPPORTED)))
