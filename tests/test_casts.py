import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidebarge.functions import casts, text, times
from tidebarge.operators import conform


def run(spark, values, dtype, cast):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {dtype}")
    value, reason = cast(F.col("s"))
    got = df.select("i", value.alias("v"), reason.alias("r")).orderBy("i").collect()
    return [r.v if r.r is None else r.r for r in got]


def test_signed_text(spark):
    got = run(spark, [" 12 ", "300", "1.5", "x", None, "+7", "-128", "9" * 41, "\t5\n"], "string",
              lambda c: casts.cast_signed(c, 8))
    assert got == [12, casts.OUT_OF_RANGE, casts.NOT_A_NUMBER, casts.NOT_A_NUMBER, None, 7, -128, casts.OUT_OF_RANGE, 5]


def test_signed_64_bounds(spark):
    got = run(spark, [str(2**63 - 1), str(2**63), str(-(2**63))], "string", lambda c: casts.cast_signed(c, 64))
    assert got == [2**63 - 1, casts.OUT_OF_RANGE, -(2**63)]


def test_signed_floats(spark):
    got = run(spark, [1.5, 2.0, 300.0, float("nan"), float("inf"), 1e20, -0.0], "double",
              lambda c: casts.cast_signed(c, 8, "float"))
    bad = casts.INVALID_FLOAT
    assert got == [bad, 2, casts.OUT_OF_RANGE, bad, bad, bad, 0]


def test_unsigned(spark):
    got = run(spark, ["255", "256", "-1", "+1"], "string", lambda c: casts.cast_unsigned(c, 8))
    assert got == [255, casts.OUT_OF_RANGE, casts.NOT_A_NUMBER, casts.NOT_A_NUMBER]
    assert run(spark, [-1, 65535, 65536], "int", lambda c: casts.cast_unsigned(c, 16, "integer")) == [
        casts.OUT_OF_RANGE, 65535, casts.OUT_OF_RANGE,
    ]
    assert int(run(spark, [str(2**64 - 1)], "string", lambda c: casts.cast_unsigned(c, 64))[0]) == 2**64 - 1
    assert run(spark, [-1.0], "double", lambda c: casts.cast_unsigned(c, 8, "float")) == [casts.INVALID_FLOAT]


def test_float_text(spark):
    values = ["1.5d", "1e3", "1e39", "1e999", "inf", " .5 ", "x", None]
    bad, far = casts.NOT_A_NUMBER, casts.OUT_OF_RANGE
    assert run(spark, values, "string", lambda c: casts.cast_float(c, 32)) == [bad, 1000.0, far, far, far, 0.5, bad, None]
    assert run(spark, values, "string", lambda c: casts.cast_float(c, 64)) == [
        bad, 1000.0, 1e39, far, float("inf"), 0.5, bad, None,
    ]


@pytest.mark.parametrize(
    "value, want",
    [(1.0, "1"), (0.1, "0.1"), (1e7, "10000000"), (123456789.125, "123456789.125"), (1e20, "1" + "0" * 20),
     (1e300, "1" + "0" * 300), (1.5e-7, "0.00000015"), (-2.5, "-2.5"), (0.0, "0"), (9007199254740993.0, "9007199254740992"),
     (-1.25e30, "-125" + "0" * 28), (100.0, "100"), (float("nan"), "NaN"), (float("-inf"), "-Inf"), (0.001, "0.001")],
)
def test_number_text_has_no_exponent(spark, value, want):
    assert run(spark, [value], "double", lambda c: casts.cast_text(c, "float")) == [want]


def test_other_text(spark):
    assert run(spark, [True], "boolean", lambda c: casts.cast_text(c, "bool")) == ["true"]
    assert run(spark, [bytearray(b"ab")], "binary", lambda c: casts.cast_text(c, "binary")) == ["ab"]


def test_bool_is_strict(spark):
    assert run(spark, [True, None], "boolean", lambda c: casts.cast_bool_strict(c, "bool")) == [True, None]
    assert run(spark, ["true", None], "string", lambda c: casts.cast_bool_strict(c, "text")) == [casts.UNSUPPORTED, None]


def test_wrap(spark):
    df = spark.createDataFrame([(200,), (-129,), (127,)], "s int")
    assert [r[0] for r in df.select(casts.wrap_narrow_int(F.col("s"), 8)).collect()] == [-56, 127, 127]


def test_scaled_int(spark):
    got = run(spark, ["1", "1.2", "1.23", "1.234", "1.2.3", "-.5", "x", None], "string",
              lambda c: casts.decimal_to_scaled_int(c, 2))
    assert got == [100, 120, 123, "fraction longer than scale", "more than one decimal point", -50, casts.NOT_A_NUMBER, None]


@pytest.mark.parametrize(
    "value, want",
    [("1700000000", "2023-11-14 22:13:20"), ("1700000000000", "2023-11-14 22:13:20"),
     ("2021-05-10T17:36:14Z", "2021-05-10 17:36:14"), ("2021-05-10T17:36:14.123456789+08:00", "2021-05-10 09:36:14.123456"),
     ("2021-05-10T17:36:14", "2021-05-10 17:36:14"), ("2021-05-10", "2021-05-10 00:00:00"),
     ("2021-05-10 17:36:14.123", "2021-05-10 17:36:14.123"), ("2021-05-10 17:36:14", "2021-05-10 17:36:14"),
     ("2006年01月02日 15时04分05秒", "2006-01-02 15:04:05"), ("2006年01月02日15时04分05秒", "2006-01-02 15:04:05"),
     ("02 Jan 06 15:04 MST", "2006-01-02 15:04:00"), ("Monday, 02-Jan-06 15:04:05 MST", "2006-01-02 15:04:05"),
     ("02 Dec 70 15:04 GMT+3", "1970-12-02 12:04:00"), ("29 Feb 72 9:04 UTC", "1972-02-29 09:04:00"),
     ("01 jan 68 00:00 EST", "2068-01-01 00:00:00"), ("30 Feb 72 15:04 UTC", None),
     ("Friday, 29-Dec-69 5:04:05.123456789 CEST", "1969-12-29 05:04:05.123456"), ("x", None), ("2021-13-40", None), ("02 Xan 06 15:04 MST", None),
     ("2021-05-10 17:36:14Z", None), ("9" * 20, times.TOO_FAR), ("9223372036854775807", times.TOO_FAR), ("", None)],
)
def test_parse_time(spark, value, want):
    got = run(spark, [value], "string", times.parse_time)[0]
    reasons = (times.UNREADABLE, times.TOO_FAR)
    assert got == (times.UNREADABLE if want is None else want if want in reasons else dt.datetime.fromisoformat(want))


def test_parse_time_numbers(spark):
    day = dt.datetime(1970, 1, 2)
    assert run(spark, [86400], "bigint", lambda c: times.parse_time(c, "integer")) == [day]
    assert run(spark, [86400.9], "double", lambda c: times.parse_time(c, "float")) == [day]


def test_time_spent(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((0, 59, 60, 3600, 3725, -60))], "i int, s bigint")
    got = df.select("i", times.time_spent(F.lit(0), F.col("s")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["0秒", "59秒", "1分", "1时", "1时2分5秒", "1分"]


def test_small_text_rules(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col).first()[0]

    assert [value(text.length_from_comment(F.lit(c))) for c in ("name_50", "a_b", "", "7")] == [50, 0, 0, 7]
    for given, want in (("Nullable(Int32)", ("Int32", True)), ("String", ("String", False)),
                        ("Nullable(Decimal(9, 2))", ("Decimal(9, 2)", True))):
        assert tuple(value(c) for c in text.strip_nullable(F.lit(given))) == want
    assert value(text.split_array(F.lit("a,b,c"))) == ["a", "b", "c"]
    assert tuple(value(text.parse_point(F.lit("( 1.5 , 2 )"))[0])) == (1.5, 2.0)
    assert value(text.parse_point(F.lit("1"))[1]) == "not a point"
    for given, want in (("10.0.0.1:80", None), ("256.0.0.1:80", "octet"), ("10.0.0.1:70000", "port"), ("host:80", "format"),
                        ("10.0.0.1:0", "port"), ("10.0.0.1:80\n", "format")):
        assert value(text.endpoint_reason(F.lit(given))) == want


def test_addresses_agree_with_a_second_parser(spark):
    import ipaddress

    samples = ["1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7",
               "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
               "1:2:3:4:5:6:7:1.2.3.4", ":::", "12345::", "g::", "fe80::1%eth0", "", ":1", "1:", "::1.2.3.256"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", text.valid_ipv4(F.col("s")).alias("a"), text.valid_ipv6(F.col("s")).alias("b")).collect()}

    def ok(kind, s):
        try:
            kind(s)
            return True
        except ValueError:
            return False

    assert got == {s: (ok(ipaddress.IPv4Address, s), ok(ipaddress.IPv6Address, s)) for s in samples}


def test_uuid_spellings(spark):
    u = "12345678-1234-1234-1234-123456789abc"
    df = spark.createDataFrame(
        [(u, True), (u.upper(), True), ("{" + u + "}", True), ("urn:uuid:" + u, True), (u.replace("-", ""), True),
         (u[:-1], False), (u + "0", False), ("{" + u, False), (u.replace("-", "_"), False)], "s string, want boolean")
    assert df.where(text.valid_uuid(F.col("s")) != F.col("want")).count() == 0


def test_decimals(spark):
    from decimal import Decimal

    far, long = casts.OUT_OF_RANGE, "fraction longer than scale"
    got = run(spark, ["1.25", " 12.500 ", "1.255", "1000", "x", "1e2", None], "string", lambda c: casts.cast_decimal(c, 5, 2))
    assert got == [Decimal("1.25"), Decimal("12.50"), long, far, casts.NOT_A_NUMBER, casts.NOT_A_NUMBER, None]
    assert run(spark, [2.5, 1e9, float("nan")], "double", lambda c: casts.cast_decimal(c, 5, 1, "float")) == [
        Decimal("2.5"), far, casts.NOT_A_NUMBER]


def test_cast_table_wider_types(spark):
    df = spark.createDataFrame(
        [(1, "1.1.1.1", "a,b", "(1,2)", "2024-01-02", {"k": "v"}), (2, "1.1", "c", "1", "soon", None)],
        "id int, ip string, tags string, p string, d string, m map<string,string>")
    cast = conform.cast_table(df, {"ip": "ipv4", "tags": "array", "p": "point", "d": "date", "m": "map"}, ["id"])
    row = conform.good_rows(cast).first()
    assert (row.ip, row.tags, tuple(row.p), row.d, row.m) == ("1.1.1.1", ["a", "b"], (1.0, 2.0), dt.date(2024, 1, 2), {"k": "v"})
    assert [r.column for r in conform.rejected_values(cast, ["id"]).collect()] == ["ip", "p", "d"]
    text_map = conform.cast_table(df, {"ip": "map"}, ["id"])
    assert conform.good_rows(text_map).count() == 0


def test_cast_table_splits_input(spark):
    df = spark.createDataFrame([(1, "5", 1.0), (2, "x", 1.5), (3, None, 2.0), (4, "400", None)], "id int, a string, b double")
    cast = conform.cast_table(df, {"a": "int8", "b": "uint8"}, ["id"], required=["a"])
    good, rejects = conform.good_rows(cast), conform.rejected_values(cast, ["id"])
    assert rows(good) == [(1, 5, 1)]
    assert rows(rejects) == sorted(
        [(2, "a", casts.NOT_A_NUMBER), (2, "b", casts.INVALID_FLOAT), (3, "a", casts.UNSUPPORTED), (4, "a", casts.OUT_OF_RANGE)],
        key=repr)
    assert good.count() + rejects.select("id").distinct().count() == df.count()
