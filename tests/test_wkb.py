"""Geometry bytes: every type, both byte orders, and bytes that are none."""

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidebarge.functions import wkb
from tidebarge.operators import conform


def made(order, kind, body):
    return struct.pack(order + "BI", order == "<", kind) + body


def line(order, *points):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)


def point(order, x, y):
    return made(order, 1, struct.pack(order + "2d", x, y))


def several(order, kind, *parts):
    return made(order, kind, struct.pack(order + "I", len(parts)) + b"".join(parts))


def shapes(o, other):
    ring, hole = line(o, (0, 0), (4, 0), (4, 4), (0, 0)), line(o, (1, 1), (2, 1), (1, 1))
    polygon = made(o, 3, struct.pack(o + "I", 2) + ring + hole)
    rings = "((0.0 0.0,4.0 0.0,4.0 4.0,0.0 0.0),(1.0 1.0,2.0 1.0,1.0 1.0))"
    return [
        (point(o, 1.5, -2e10), "POINT(1.5 -2.0E10)"),
        (made(o, 2, line(o, (0, 0), (1, 0.0001))), "LINESTRING(0.0 0.0,1.0 1.0E-4)"),
        (polygon, "POLYGON" + rings),
        (several(o, 4, point(o, 1, 2), point(other, 3, 4)), "MULTIPOINT((1.0 2.0),(3.0 4.0))"),
        (several(o, 5, made(o, 2, line(o, (1, 1), (2, 2)))), "MULTILINESTRING((1.0 1.0,2.0 2.0))"),
        (several(o, 6, polygon, polygon), f"MULTIPOLYGON({rings},{rings})"),
        (several(o, 7, point(other, 1, 2), several(o, 7)), "GEOMETRYCOLLECTION(POINT(1.0 2.0),GEOMETRYCOLLECTION EMPTY)"),
        (made(o, 2, line(o)), "LINESTRING EMPTY"),
    ]


@pytest.mark.parametrize("order, other", ["<>", "><"])
def test_every_type(order, other):
    for data, text in shapes(order, other):
        assert wkb.wkt(data) == text and wkb.wkt(struct.pack("<I", 4326) + data) == text == wkb.wkt(bytes(4) + data)
        for bad in (data[:-1], data + b"\0", data[:5]):
            assert wkb.wkt(bad) is None


def test_bytes_that_are_no_geometry():
    deep = b""
    for _ in range(50):
        deep = several("<", 7, deep) if deep else point("<", 1, 1)
    nan = point("<", float("nan"), 1)
    for bad in (b"", b"\1", bytes(40), made("<", 9, b""), several("<", 4, made("<", 2, line("<", (1, 1)))), made("<", 2, b"\xff\xff\xff\xff"), deep, nan):
        assert wkb.wkt(bad) is None


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_are_read_back(x):
    assert float(wkb.number_text(x)) == x


def test_numbers_as_the_jvm_prints_them(spark):
    values = [0.0, -0.0, 1.0, 0.001, 0.00099, 9999999.0, 1e7, 12345678.9, -1.25e-7, 1.7976931348623157e308, 1e16, 123456789012345680.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [wkb.number_text(v) for v in values] == [r[0] for r in df.selectExpr("cast(v as string)").collect()]


def test_bad_bytes_are_rejects(spark):
    df = spark.createDataFrame([(1, bytearray(point("<", 1, 2))), (2, bytearray(b"\1\2")), (3, None)], "id int, g binary")
    cast = conform.cast_table(df, {"g": "wkt"}, ["id"]).orderBy("id").collect()
    assert [(r.g, [x.reason for x in r.rejects]) for r in cast] == [("POINT(1.0 2.0)", []), (None, ["not a geometry"]), (None, [])]
