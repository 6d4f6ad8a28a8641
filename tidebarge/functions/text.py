"""Validity checks and small text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import Cast

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}\z"
IPV4_TAIL = rf":{OCTET}(\.{OCTET}){{3}}\z"
HEXTET = "[0-9A-Fa-f]{1,4}"
IPV6_FULL = rf"^{HEXTET}(:{HEXTET}){{7}}\z"
IPV6_SHORT = rf"^({HEXTET}(:{HEXTET})*)?::({HEXTET}(:{HEXTET})*)?\z"
# the four spellings a UUID may have. Fixed values.
UUID_DASHED = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
UUID = rf"^({UUID_DASHED}|(?i:urn:uuid:){UUID_DASHED}|\{{{UUID_DASHED}\}}|[0-9A-Fa-f]{{32}})\z"


def length_from_comment(comment: Column) -> Column:
    """Declared length carried as the last ``_`` piece of a comment; 0 when it is no number."""
    tail = F.element_at(F.split(comment, "_"), -1)
    return F.coalesce(F.when(tail.rlike(r"^[+-]?[0-9]+\z"), tail.try_cast("bigint")), F.lit(0).cast("bigint"))


def strip_nullable(type_name: Column) -> tuple[Column, Column]:
    """``Nullable(T)`` to ``(T, true)``, anything else to itself and false."""
    wrapped = type_name.startswith("Nullable")
    inner = F.regexp_extract(type_name, r"^Nullable\((.*)\)\z", 1)
    return F.when(wrapped, inner).otherwise(type_name), wrapped


def split_array(col: Column) -> Column:
    return F.split(col, ",", -1)


def parse_point(col: Column) -> Cast:
    """``(x,y)``, blanks ignored, to ``struct<x:double,y:double>``."""
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    squeezed = F.regexp_replace(col, r"\s", "")
    bare = F.regexp_replace(squeezed, r"^[()]+|[()]+\z", "")
    ok = bare.rlike(rf"^{number},{number}\z")
    value = F.when(
        ok,
        F.struct(
            F.substring_index(bare, ",", 1).try_cast("double").alias("x"),
            F.substring_index(bare, ",", -1).try_cast("double").alias("y"),
        ),
    )
    return value, F.when(col.isNotNull() & ~ok, F.lit("not a point"))


def valid_uuid(col: Column) -> Column:
    return col.rlike(UUID)


def valid_ipv4(col: Column) -> Column:
    return col.rlike(IPV4)


def valid_ipv6(col: Column) -> Column:
    """Eight groups, or fewer around one ``::``; an IPv4 tail counts as two groups, a ``%zone`` is allowed."""
    body = F.regexp_replace(F.regexp_replace(col, "%.+$", ""), IPV4_TAIL, ":0:0")
    groups = F.size(F.filter(F.split(body, ":"), lambda g: g != ""))
    return body.rlike(IPV6_FULL) | (body.rlike(IPV6_SHORT) & (groups <= 7))


def valid_ip(col: Column) -> Column:
    """What a column of IPv6 addresses takes: an IPv6 address, or an IPv4 one, which is mapped."""
    return valid_ipv6(col) | valid_ipv4(col)


def endpoint_reason(col: Column) -> Column:
    """Why ``d.d.d.d:port`` is not usable: ``format``, ``octet``, ``port``; NULL when it is fine."""
    shaped = col.rlike(r"^(\d{1,3}\.){3}\d{1,3}:\d{1,5}\z")
    octets = F.transform(F.split(F.substring_index(col, ":", 1), r"\."), lambda o: o.try_cast("int"))
    port = F.substring_index(col, ":", -1).try_cast("int")
    return (
        F.when(~shaped, F.lit("format"))
        .when(F.exists(octets, lambda o: o > 255), F.lit("octet"))
        .when(~port.between(1, 65535), F.lit("port"))
    )
