"""Geometry bytes as drivers deliver them, to text."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .casts import Cast

NOT_A_GEOMETRY = "not a geometry"

#: Numbers of the geometry types. Fixed values.
NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
#: What the parts of a collection must be.
PART = {4: 1, 5: 2, 6: 3}
DEEPEST = 32


def number_text(x: float) -> str:
    """A double in its shortest spelling, as the JVM prints it (1.0, 1.5E10)."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("no coordinate")
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)
    digits, exponent = f"{x!r}e0".split("e")[:2] if "e" in repr(x) else (repr(x), "0")
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, part = digits.partition(".")
    every = (whole + part).lstrip("0")
    power = int(exponent) + (len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0"))) - 1)
    every = every.rstrip("0") or "0"
    return f"{sign}{every[0]}.{every[1:] or '0'}E{power}"


class _Reader:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.order = data, at, "<"

    def take(self, kind: str) -> tuple:
        form = struct.Struct(self.order + kind)
        got = form.unpack_from(self.data, self.at)  # struct.error beyond the end
        self.at += form.size
        return got

    def count(self, least: int) -> int:
        (n,) = self.take("I")
        if n * least > len(self.data) - self.at:
            raise ValueError("too short")
        return n

    def points(self) -> str:
        n = self.count(16)
        xy = self.take(f"{2 * n}d")
        return "(" + ",".join(f"{number_text(x)} {number_text(y)}" for x, y in zip(xy[::2], xy[1::2])) + ")"

    def geometry(self, depth: int = 0, want: int | None = None, bare: bool = False) -> str:
        order = self.data[self.at]
        if order > 1 or depth > DEEPEST:
            raise ValueError("no geometry")
        self.at, self.order = self.at + 1, "<" if order else ">"
        (kind,) = self.take("I")
        if kind not in NAMES or want not in (None, kind):
            raise ValueError("no geometry")
        if kind == 1:
            body = "({} {})".format(*map(number_text, self.take("2d")))
        elif kind == 2:
            body = self.points()
        elif kind == 3:
            body = "(" + ",".join(self.points() for _ in range(self.count(4))) + ")"
        else:
            n = self.count(5)
            order = self.order
            parts = []
            for _ in range(n):
                parts.append(self.geometry(depth + 1, PART.get(kind), kind in PART))
                self.order = order
            body = "(" + ",".join(parts) + ")"
        body = " EMPTY" if body == "()" and not bare else body
        return body if bare else NAMES[kind] + body


def wkt(data: bytes) -> str | None:
    """Text of well-known bytes, alone or behind the four bytes of a reference system; None if they are neither."""
    for at in (0, 4):
        try:
            reader = _Reader(data, at)
            text = reader.geometry()
            if reader.at == len(data):
                return text
        except (ValueError, IndexError, struct.error):
            pass
    return None


@F.arrow_udf(T.StringType())
def wkb_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of geometry bytes; NULL where they are none."""
    for batch in batches:
        yield pa.array([None if v is None else wkt(v) for v in batch.to_pylist()], pa.string())


def cast_wkt(col: Column, kind: str) -> Cast:
    """Geometry bytes or ready text to text, with the reason for bytes that are no geometry."""
    value = wkb_text(col) if kind == "binary" else col
    return value, F.when(col.isNotNull() & value.isNull(), F.lit(NOT_A_GEOMETRY))
