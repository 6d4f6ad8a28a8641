"""Projections between type systems and typed casts over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import casts, text, times
from ..operators import conform, normalize, profile
from ..plans.specs import ColumnDescriptor as Col
from .frames import sql_ts, ts_text
from .moving import COLUMNS, KEYS, RUN
from .registry import TABLES, Tables, query

# --- pull side ----------------------------------------------------------------


@query("norm_column_select", "select c_custkey id, c_name as name, c_acctbal from customer")
def norm_column_select(t: Tables) -> DataFrame:
    return normalize.normalize_pull(
        t.customer, [Col("c_custkey", "bigint", "id"), Col("c_name", "varchar", "name"), Col("c_acctbal", "double")]
    )


@query(
    "norm_wide_decimal",
    """select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(12,2)) as varchar) wide,
    cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) narrow_cents from lineitem""",
)
def norm_wide_decimal(t: Tables) -> DataFrame:
    priced = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    out = normalize.normalize_pull(
        priced,
        [
            Col("l_orderkey", "bigint"), Col("l_linenumber", "int"),
            Col("p", "decimal", "wide", precision=40, scale=2), Col("p", "decimal", "narrow", precision=12, scale=2),
        ],
    )
    return out.withColumn("narrow_cents", (F.col("narrow") * 100).cast("bigint")).drop("narrow")


@query(
    "norm_datetime",
    f"select event_id, {sql_ts('ts')} as_text, epoch_us(ts) as_is_us from events",
)
def norm_datetime(t: Tables) -> DataFrame:
    out = normalize.normalize_pull(
        t.events,
        [Col("event_id", "bigint"), Col("ts", "datetime", "as_text", precision=10), Col("ts", "timestamp", "as_is", precision=6)],
    )
    return out.withColumn("as_is_us", F.unix_micros(F.col("as_is").cast("timestamp"))).drop("as_is")


@query("norm_time", "select event_id, strftime(ts, '%H:%M:%S.%f') at_time from events")
def norm_time(t: Tables) -> DataFrame:
    return normalize.normalize_pull(t.events, [Col("event_id", "bigint"), Col("ts", "time", "at_time")])


@query("norm_year", "select o_orderkey, cast(year(o_orderdate) as varchar) in_year from orders")
def norm_year(t: Tables) -> DataFrame:
    return normalize.normalize_pull(t.orders, [Col("o_orderkey", "bigint"), Col("o_orderdate", "year", "in_year")])


@query("norm_bit", "select event_id, bin(user_id) bits from events")
def norm_bit(t: Tables) -> DataFrame:
    return normalize.normalize_pull(t.events, [Col("event_id", "bigint"), Col("user_id", "bit", "bits")])


@query(
    "norm_enum_set",
    "select event_id, event_type kind, cast(user_id as varchar) flags from events",
)
def norm_enum_set(t: Tables) -> DataFrame:
    return normalize.normalize_pull(
        t.events, [Col("event_id", "bigint"), Col("event_type", "enum", "kind"), Col("user_id", "set", "flags")]
    )


@query("norm_binary_base64", "select doc_id, base64(encode(text)) body from documents")
def norm_binary_base64(t: Tables) -> DataFrame:
    binary = t.documents.withColumn("text", F.encode("text", "utf-8"))
    return normalize.normalize_pull(binary, [Col("doc_id", "bigint"), Col("text", "longblob", "body")])


@query("norm_json_text", "select event_id, replace(props, ' ', '') props from events")
def norm_json_text(t: Tables) -> DataFrame:
    return normalize.normalize_pull(t.events, [Col("event_id", "bigint"), Col("props", "json")])


_ONE, _TWO = "000000000000F03F", "0000000000000040"  # 1.0 and 2.0, low byte first
#: Bytes as a driver delivers them: a line, a polygon behind a reference system, points, a collection, the high byte first, and none.
_SHAPES = [
    ("010200000002000000" + _ONE + _TWO + _TWO + _ONE, "LINESTRING(1.0 2.0,2.0 1.0)"),
    ("E6100000" + "01030000000100000003000000" + _ONE + _ONE + _TWO + _TWO + _ONE + _ONE, "POLYGON((1.0 1.0,2.0 2.0,1.0 1.0))"),
    ("010400000001000000" + "0101000000" + _TWO + _ONE, "MULTIPOINT((2.0 1.0))"),
    ("010700000002000000" + "0101000000" + _ONE + _ONE + "010500000000000000", "GEOMETRYCOLLECTION(POINT(1.0 1.0),MULTILINESTRING EMPTY)"),
    ("0000000001" + "3FF8000000000000" + "C000000000000000", "POINT(1.5 -2.0)"),
    ("0102000000FF", ""),
]


@query(
    "norm_geometry_wkt",
    "select event_id, 'POINT(' || value || ' ' || cast(user_id as double) || ')' place, case event_id % 6 "
    + " ".join(f"when {i} then '{text}'" for i, (_, text) in enumerate(_SHAPES)) + " end shape from events",
)
def norm_geometry_wkt(t: Tables) -> DataFrame:
    """Points as structs, and all other shapes as bytes; bytes that are no shape give none."""
    held = F.element_at(F.array(*[F.unhex(F.lit(h)) for h, _ in _SHAPES]), (F.col("event_id") % 6 + 1).cast("int"))
    point = F.struct(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    placed = t.events.select("event_id", point.alias("p"), held.alias("shape"))
    columns = [Col("event_id", "bigint"), Col("p", "point", "place"), Col("shape", "geometry")]
    return normalize.normalize_pull(placed, columns).fillna("", ["shape"])


@query("norm_passthrough", "select p_partkey, p_name, p_size, p_retailprice from part")
def norm_passthrough(t: Tables) -> DataFrame:
    return normalize.normalize_pull(
        t.part,
        [Col("p_partkey", "bigint"), Col("p_name", "varchar"), Col("p_size", "int"), Col("p_retailprice", "double")],
    )


@query("norm_default_text", "select p_partkey, cast(p_size > 25 as varchar) is_large from part")
def norm_default_text(t: Tables) -> DataFrame:
    flagged = t.part.withColumn("large", F.col("p_size") > 25)
    return normalize.normalize_pull(flagged, [Col("p_partkey", "bigint"), Col("large", "boolean", "is_large")])


ORDER_COLUMNS = [
    Col("o_orderkey", "bigint unsigned", is_key=True, is_nullable=False),
    Col("o_custkey", "tinyint"),
    Col("o_totalprice", "decimal", precision=12, scale=2),
    Col("o_orderdate", "datetime", precision=6),
    Col("o_orderpriority", "varchar(15)"),
]


@query(
    "conform_to_warehouse",
    f"""select cast(o_orderkey as varchar) o_orderkey, coalesce(cast(try_cast(o_custkey as tinyint) as varchar), '') o_custkey,
    cast(cast(o_totalprice as decimal(12,2)) as varchar) o_totalprice, {sql_ts('o_orderdate')} o_orderdate,
    o_orderpriority, cast({RUN} as bigint) pull_time from orders""",
)
def conform_to_warehouse(t: Tables) -> DataFrame:
    out = conform.conform_to_warehouse(t.orders, ORDER_COLUMNS, RUN)
    return out.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.coalesce(F.col("o_custkey").cast("string"), F.lit("")).alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        ts_text("o_orderdate").alias("o_orderdate"),
        "o_orderpriority",
        "pull_time",
    )


@query(
    "decimal_width_bucket",
    """select case when p <= 9 then 32 when p <= 19 then 64 when p <= 38 then 128 else 256 end width,
    count(*) columns, cast(sum(case when p > 38 then 1 else 0 end) as bigint) as_text
    from (select 1 + l_partkey % 76 p from lineitem) q group by 1""",
)
def decimal_width_bucket(t: Tables) -> DataFrame:
    declared = t.lineitem.select((F.col("l_partkey") % 76 + 1).alias("p"))
    return (
        declared.select(conform.decimal_width(F.col("p")).alias("width"), (F.col("p") > 38).alias("wide"))
        .groupBy("width")
        .agg(F.count(F.lit(1)).alias("columns"), F.count_if("wide").alias("as_text"))
    )


# --- push side ----------------------------------------------------------------


@query(
    "denorm_datetime",
    "select event_id, cast(ts as varchar) as_text, epoch_us(ts) as_is_us from events",
)
def denorm_datetime(t: Tables) -> DataFrame:
    out = normalize.normalize_push(
        t.events,
        [Col("event_id", "Int64"), Col("ts", "DateTime64", "as_text", precision=7), Col("ts", "DateTime", "as_is", precision=6)],
    )
    return out.withColumn("as_is_us", F.unix_micros(F.col("as_is").cast("timestamp"))).drop("as_is")


@query(
    "denorm_decimal",
    """select event_id, cast(cast(cast(value as varchar) as decimal(38,31)) as varchar) deep,
    cast(cast(value as decimal(12,2)) * 100 as bigint) plain_cents from events""",
)
def denorm_decimal(t: Tables) -> DataFrame:
    exact = t.events.select(
        "event_id",
        F.col("value").cast("string").cast("decimal(38,31)").alias("d"),
        F.col("value").cast("decimal(12,2)").alias("s"),
    )
    out = normalize.normalize_push(
        exact,
        [
            Col("event_id", "Int64"), Col("d", "Decimal128", "deep", precision=38, scale=31),
            Col("s", "Decimal64", "plain", precision=12, scale=2),
        ],
    )
    return out.select("event_id", "deep", (F.col("plain") * 100).cast("bigint").alias("plain_cents"))


UUID_SQL = "substr(m,1,8)||'-'||substr(m,9,4)||'-'||substr(m,13,4)||'-'||substr(m,17,4)||'-'||substr(m,21,12)"


def _uuid_of(col: Column) -> Column:
    m = F.md5(col.cast("string").cast("binary"))
    return F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


@query(
    "denorm_uuid",
    f"select event_id, {UUID_SQL} uuid from (select event_id, md5(cast(event_id as varchar)) m from events) q",
)
def denorm_uuid(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("u", _uuid_of(F.col("event_id")))
    return normalize.normalize_push(keyed, [Col("event_id", "Int64"), Col("u", "UUID", "uuid")])


@query(
    "denorm_array_json",
    """select vec_id, replace(cast(to_json(list_transform(embedding,
    lambda e: cast(floor(cast(e as double) * 1000000) as bigint))) as varchar), ' ', '') parts from embeddings""",
)
def denorm_array_json(t: Tables) -> DataFrame:
    fixed = t.embeddings.withColumn(
        "a", F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000000).cast("bigint"))
    )
    return normalize.normalize_push(fixed, [Col("vec_id", "Int64"), Col("a", "Array(Int64)", "parts")])


@query(
    "denorm_map_json",
    """select event_id, '{"type":"' || event_type || '","user":"' || user_id || '"}' attributes from events""",
)
def denorm_map_json(t: Tables) -> DataFrame:
    mapped = t.events.withColumn(
        "m", F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))
    )
    return normalize.normalize_push(mapped, [Col("event_id", "Int64"), Col("m", "Map(String, String)", "attributes")])


@query(
    "denorm_ip",
    "select event_id, '10.' || user_id % 256 || '.' || event_id % 256 || '.1' address from events",
)
def denorm_ip(t: Tables) -> DataFrame:
    addressed = t.events.withColumn(
        "ip",
        F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("1")),
    )
    return normalize.normalize_push(addressed, [Col("event_id", "Int64"), Col("ip", "IPv4", "address")])


@query("denorm_fixed_string", "select c_custkey, c_mktsegment segment from customer")
def denorm_fixed_string(t: Tables) -> DataFrame:
    padded = t.customer.withColumn("f", F.rpad("c_mktsegment", 16, "\x00"))
    return normalize.normalize_push(padded, [Col("c_custkey", "Int64"), Col("f", "FixedString(16)", "segment")])


STATUS_LABELS = {70: "filled", 79: "open", 80: "pending"}


@query(
    "denorm_enum_label",
    """select o_orderkey, case o_orderstatus when 'F' then 'filled' when 'O' then 'open' when 'P' then 'pending' end status
    from orders""",
)
def denorm_enum_label(t: Tables) -> DataFrame:
    coded = t.orders.select("o_orderkey", F.ascii("o_orderstatus").alias("status"))
    return normalize.enum_label(coded, "status", STATUS_LABELS)


@query("denorm_passthrough", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def denorm_passthrough(t: Tables) -> DataFrame:
    return normalize.normalize_push(
        t.lineitem,
        [Col("l_orderkey", "Int64"), Col("l_linenumber", "Int32"), Col("l_quantity", "Float64"), Col("l_returnflag", "String")],
    )


@query(
    "denorm_default_text",
    """select p_partkey, cast(p_size > 25 as varchar) is_large, '{"size":' || p_size || ',"brand":"' || p_brand || '"}' pair
    from part""",
)
def denorm_default_text(t: Tables) -> DataFrame:
    odd = t.part.select(
        "p_partkey", (F.col("p_size") > 25).alias("b"), F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("s")
    )
    return normalize.normalize_push(
        odd, [Col("p_partkey", "Int64"), Col("b", "Bool", "is_large"), Col("s", "Tuple(Int32, String)", "pair")]
    )


@query(
    "conform_to_target",
    """select l_orderkey, cast(l_linenumber as smallint) l_linenumber, cast(l_tax as varchar) tax,
    cast(cast(cast(l_extendedprice as decimal(12, 2)) as decimal(38, 10)) as varchar) price,
    cast(l_shipdate as varchar) shipped, l_returnflag from lineitem""",
)
def conform_to_target(t: Tables) -> DataFrame:
    out = conform.conform_to_target(
        t.lineitem,
        [
            Col("l_orderkey", "Int64", is_key=True), Col("l_linenumber", "UInt8"),
            Col("l_tax", "Decimal128", "tax", precision=38, scale=31), Col("l_shipdate", "DateTime64", "shipped", precision=9),
            Col("l_returnflag", "String", max_length=1), Col("l_extendedprice", "Decimal128", "price", precision=38, scale=10),
        ],
    )
    return out.withColumn("price", F.col("price").cast("string"))


@query("insert_columns", "select c_nationkey, c_custkey, c_name from customer")
def insert_columns(t: Tables) -> DataFrame:
    chosen = t.customer.select("c_nationkey", "c_custkey", "c_name")
    return normalize.insert_columns(chosen, t.customer.columns)


# --- casts ---------------------------------------------------------------------

# One text column with every kind of spelling: padded, fractional, word, large, negative.
RAW_SQL = """raw as (select event_id, user_id, value, event_type, case event_id % 6 when 0 then ' ' || user_id || ' '
when 1 then cast(value as varchar) when 2 then 'x' || event_id when 3 then cast(event_id * 100 as varchar)
when 4 then '-' || user_id else nullif(cast(user_id as varchar), '7') end txt from events)"""


def raw_text(t: Tables) -> DataFrame:
    kind, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    return t.events.select(
        "event_id", "user_id", "value", "event_type",
        F.when(kind == 0, F.concat(F.lit(" "), user, F.lit(" ")))
        .when(kind == 1, F.col("value").cast("string"))
        .when(kind == 2, F.concat(F.lit("x"), F.col("event_id").cast("string")))
        .when(kind == 3, (F.col("event_id") * 100).cast("string"))
        .when(kind == 4, F.concat(F.lit("-"), user))
        .otherwise(F.nullif(user, F.lit("7")))
        .alias("txt"),
    )


def shown(cast: casts.Cast, name: str) -> list[Column]:
    """Value as text and reason, empty when absent."""
    value, reason = cast
    return [
        F.coalesce(value.cast("string"), F.lit("")).alias(f"{name}_value"),
        F.coalesce(reason, F.lit("")).alias(f"{name}_reason"),
    ]


def _int_sql(name: str, pattern: str, low: int, high: int) -> str:
    ok = f"regexp_matches(s, '{pattern}')"
    fits = f"try_cast(s as hugeint) between {low} and {high}"
    return f"""case when {ok} and {fits} then cast(try_cast(s as hugeint) as varchar) else '' end {name}_value,
    case when s is null then '' when not {ok} then 'not a number' when not ({fits}) then 'value out of range' else '' end {name}_reason"""


def _whole_sql(name: str, low: int, high: int, floor_limit: str) -> str:
    broken = f"(value < {floor_limit} or value <> floor(value))"
    fits = f"value between {low} and {high}"
    return f"""case when not {broken} and {fits} then cast(cast(value as bigint) as varchar) else '' end {name}_value,
    case when {broken} then 'invalid float for integer conversion' when not ({fits}) then 'value out of range' else '' end {name}_reason"""


@query(
    "cast_signed",
    f"""with {RAW_SQL}, s as (select *, trim(txt) s from raw) select event_id, {_int_sql('int8', '^[+-]?[0-9]+$', -128, 127)},
    {_int_sql('int16', '^[+-]?[0-9]+$', -32768, 32767)}, {_int_sql('int64', '^[+-]?[0-9]+$', -2**63, 2**63 - 1)},
    {_whole_sql('whole', -128, 127, '-9.3e18')} from (select event_id, s, value * 4 as value from s) q""",
)
def cast_signed(t: Tables) -> DataFrame:
    txt = F.col("txt")
    return raw_text(t).select(
        "event_id",
        *shown(casts.cast_signed(txt, 8), "int8"),
        *shown(casts.cast_signed(txt, 16), "int16"),
        *shown(casts.cast_signed(txt, 64), "int64"),
        *shown(casts.cast_signed(F.col("value") * 4, 8, "float"), "whole"),
    )


@query(
    "cast_unsigned",
    f"""with {RAW_SQL}, s as (select *, trim(txt) s from raw) select event_id, {_int_sql('uint8', '^[0-9]+$', 0, 255)},
    {_int_sql('uint32', '^[0-9]+$', 0, 2**32 - 1)}, {_whole_sql('whole', 0, 255, '0')}
    from (select event_id, s, value * 4 - 100 as value from s) q""",
)
def cast_unsigned(t: Tables) -> DataFrame:
    txt = F.col("txt")
    return raw_text(t).select(
        "event_id",
        *shown(casts.cast_unsigned(txt, 8), "uint8"),
        *shown(casts.cast_unsigned(txt, 32), "uint32"),
        *shown(casts.cast_unsigned(F.col("value") * 4 - 100, 8, "float"), "whole"),
    )


@query(
    "cast_float",
    f"""with {RAW_SQL}, s as (select event_id, trim(txt) || case when event_id % 5 = 0 and txt not like 'x%' then 'e38' else '' end s
      from raw), f as (select event_id, s, regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') ok,
      try_cast(s as double) d from s)
    select event_id, ok is true and d is not null is_double, case when s is null then '' when not ok then 'not a number'
      when abs(d) > 3.4028234663852886e38 then 'value out of range' else '' end float32_reason,
      coalesce(case when ok and abs(d) < 1e9 then cast(floor(d) as bigint) end, -1) floor_value,
      coalesce(case when ok then d end, -1) float64, coalesce(case when ok and abs(d) <= 3.4028234663852886e38 then cast(cast(d as float) as double) end, -1) float32
      from f""",
)
def cast_float(t: Tables) -> DataFrame:
    grown = F.concat(
        F.trim("txt"),
        F.when((F.col("event_id") % 5 == 0) & ~F.col("txt").startswith("x"), F.lit("e38")).otherwise(F.lit("")),
    )
    rows = raw_text(t).select("event_id", grown.alias("s"))
    d, _ = casts.cast_float(F.col("s"), 64)
    narrow, narrow_reason = casts.cast_float(F.col("s"), 32)
    return rows.select(
        "event_id", d.isNotNull().alias("is_double"), F.coalesce(narrow_reason, F.lit("")).alias("float32_reason"),
        F.coalesce(F.when(F.abs(d) < 1e9, F.floor(d).cast("bigint")), F.lit(-1)).alias("floor_value"),
        F.coalesce(d, F.lit(-1.0)).alias("float64"), F.coalesce(narrow.cast("double"), F.lit(-1.0)).alias("float32"),
    )


@query(
    "cast_text",
    r"""select o_orderkey, regexp_replace(cast(o_totalprice as varchar), '\.0$', '') price,
    cast(cast(o_totalprice * 1000000 as bigint) * 1000 as varchar) large, cast(o_custkey as varchar) custkey,
    cast(o_totalprice > 200000 as varchar) is_big from orders""",
)
def cast_text(t: Tables) -> DataFrame:
    def as_text(col: Column, kind: str) -> Column:
        return casts.cast_text(col, kind)[0]

    # exact integers held as doubles beyond 10^7, where the plain cast would print an exponent
    large = (F.col("o_totalprice") * 1000000).cast("decimal(38,4)")
    return t.orders.select(
        "o_orderkey",
        as_text(F.col("o_totalprice"), "float").alias("price"),
        as_text((F.rint(large.cast("double")).cast("bigint") * 1000).cast("double"), "float").alias("large"),
        as_text(F.col("o_custkey"), "integer").alias("custkey"),
        as_text(F.col("o_totalprice") > 200000, "bool").alias("is_big"),
    )


CAST_TABLE_SQL = f"""with {RAW_SQL}, c as (select event_id,
  case when txt is null then 'unsupported type' when not regexp_matches(trim(txt), '^[+-]?[0-9]+$') then 'not a number'
    when not (try_cast(trim(txt) as hugeint) between -32768 and 32767) then 'value out of range' end r1,
  case when value <> floor(value) then 'invalid float for integer conversion'
    when value > 127 then 'value out of range' end r2,
  case when event_type = 'error' then 'unsupported type' end r3 from raw)"""


@query(
    "cast_table",
    f"""{CAST_TABLE_SQL}, v as (select c.event_id, r1, r2, r3, case when r1 is null then cast(trim(txt) as integer) else -99999 end txt,
      case when r2 is null then cast("value" as integer) else -99999 end "value", case when r3 is null then event_type else '' end kind
      from c join raw using (event_id))
    select event_id, txt, "value", kind, 'txt' "column", r1 reason from v where r1 is not null
    union all select event_id, txt, "value", kind, 'value', r2 from v where r2 is not null
    union all select event_id, txt, "value", kind, 'kind', r3 from v where r3 is not null
    union all select event_id, txt, "value", kind, '', '' from v where r1 is null and r2 is null and r3 is null""",
)
def cast_table(t: Tables) -> DataFrame:
    """All cast values beside the rejects per column; a good row has both fields empty, a value that does not fit is -99999 or ''."""
    rows = raw_text(t).withColumn("kind", F.nullif("event_type", F.lit("error")))
    cast = conform.cast_table(
        rows, {"txt": "int16", "value": "int8", "kind": "text"}, ["event_id"], required=["txt", "kind"]
    )
    shown_values = [F.coalesce(F.col(c).cast("int"), F.lit(-99999)).alias(c) for c in ("txt", "value")]
    listed = cast.select("event_id", *shown_values, "kind", F.inline_outer("rejects"))
    return listed.fillna("", ["column", "reason", "kind"])


@query(
    "wrap_narrow_int",
    """select o_orderkey, cast(((o_custkey + 128) % 256 + 256) % 256 - 128 as tinyint) int8,
    cast(((o_orderkey * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 as integer) int32
    from orders""",
)
def wrap_narrow_int(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        casts.wrap_narrow_int(F.col("o_custkey"), 8).alias("int8"),
        casts.wrap_narrow_int(F.col("o_orderkey") * 1000003, 32).alias("int32"),
    )


SCALED_SQL = """s as (select event_id, case event_id % 5 when 0 then cast(user_id as varchar) when 1 then cast(value as varchar)
when 2 then value || '9' when 3 then value || '.1' else 'x' || user_id end t from events)"""


@query(
    "decimal_to_scaled_int",
    f"""with {SCALED_SQL}, p as (select event_id, t, string_split(t, '.') a from s),
    r as (select *, case when len(a) > 2 then 'more than one decimal point'
      when not regexp_matches(t, '^[+-]?[0-9]*[.]?[0-9]*$') then 'not a number'
      when len(a) = 2 and length(a[2]) > 2 then 'fraction longer than scale' else '' end reason from p)
    select event_id, case when reason = '' then cast(a[1] || rpad(coalesce(a[2], ''), 2, '0') as bigint) else 0 end scaled,
    reason from r""",
)
def decimal_to_scaled_int(t: Tables) -> DataFrame:
    kind, value, user = F.col("event_id") % 5, F.col("value").cast("string"), F.col("user_id").cast("string")
    spelled = (
        F.when(kind == 0, user)
        .when(kind == 1, value)
        .when(kind == 2, F.concat(value, F.lit("9")))
        .when(kind == 3, F.concat(value, F.lit(".1")))
        .otherwise(F.concat(F.lit("x"), user))
    )
    scaled, reason = casts.decimal_to_scaled_int(F.col("t"), 2)
    return t.events.select("event_id", spelled.alias("t")).select(
        "event_id", F.coalesce(scaled, F.lit(0)).alias("scaled"), F.coalesce(reason, F.lit("")).alias("reason")
    )


@query(
    "parse_time",
    """with p as (select event_id, ts, event_id % 8 k from events)
    select event_id, case k when 7 then '' else strftime(case k when 0 then date_trunc('second', ts) when 1 then date_trunc('millisecond', ts)
      when 2 then ts when 3 then ts - interval 8 hours when 4 then date_trunc('day', ts) when 5 then date_trunc('second', ts)
      else date_trunc('minute', ts) end, '%Y-%m-%d %H:%M:%S.%f') end parsed,
    case k when 7 then 'not a time' else '' end reason from p""",
)
def parse_time(t: Tables) -> DataFrame:
    """Each event's time spelled in one of eight ways, and read back."""
    kind, ts = F.col("event_id") % 8, F.col("ts").cast("timestamp")
    spelled = (
        F.when(kind == 0, F.unix_seconds(ts).cast("string"))
        .when(kind == 1, F.unix_millis(ts).cast("string"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00")))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 5, F.date_format(ts, "yyyy'年'MM'月'dd'日' HH'时'mm'分'ss'秒'"))
        .when(kind == 6, F.concat(F.date_format(ts, "dd MMM yy HH:mm"), F.lit(" UTC")))
        .otherwise(F.date_format(ts, "MM/dd/yyyy"))
    )
    parsed, reason = times.parse_time(F.col("s"))
    return t.events.select("event_id", spelled.alias("s")).select(
        "event_id", F.coalesce(ts_text(parsed), F.lit("")).alias("parsed"), F.coalesce(reason, F.lit("")).alias("reason")
    )


@query(
    "split_array",
    """select event_id, len(string_split(s, ',')) parts, array_to_string(string_split(s, ','), '|') joined
    from (select event_id, event_type || ',' || user_id || ',' || props s from events) q""",
)
def split_array(t: Tables) -> DataFrame:
    listed = F.concat_ws(",", "event_type", F.col("user_id").cast("string"), "props")
    parts = text.split_array(listed)
    return t.events.select("event_id", F.size(parts).cast("bigint").alias("parts"), F.array_join(parts, "|").alias("joined"))


@query(
    "parse_point",
    """select event_id, case when event_type = 'error' then -1.0 else value end x,
    case when event_type = 'error' then -1.0 else cast(user_id as double) end y,
    case when event_type = 'error' then 'not a point' else '' end reason from events""",
)
def parse_point(t: Tables) -> DataFrame:
    value, user = F.col("value").cast("string"), F.col("user_id").cast("string")
    spelled = F.when(F.col("event_type") == "error", value).otherwise(
        F.concat(F.lit("( "), value, F.lit(" , "), user, F.lit(")"))
    )
    point, reason = text.parse_point(F.col("s"))
    return t.events.select("event_id", spelled.alias("s")).select(
        "event_id",
        F.coalesce(point["x"], F.lit(-1.0)).alias("x"),
        F.coalesce(point["y"], F.lit(-1.0)).alias("y"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


@query(
    "valid_uuid_ip",
    f"""with m as (select event_id, user_id, md5(cast(event_id as varchar)) m from events)
    select event_id, event_id % 3 <> 2 is_uuid, user_id * 3 < 256 and event_id % 5 <> 0 is_ipv4,
    event_id % 4 in (0, 1) is_ipv6 from m""",
)
def valid_uuid_ip(t: Tables) -> DataFrame:
    """Good and broken spellings of each; broken by an octet, a leading zero, a missing or ninth group."""
    e, u = F.col("event_id"), F.col("user_id")
    dashed = _uuid_of(e)
    uuid = F.when(e % 3 == 0, dashed).when(e % 3 == 1, F.translate(dashed, "-", "")).otherwise(F.concat(dashed, F.lit("0")))
    ipv4 = F.concat(
        F.lit("10.0."), (u * 3).cast("string"), F.when(e % 5 == 0, F.lit(".01")).otherwise(F.lit(".1"))
    )
    h = F.hex(e % 65536)
    ipv6 = (
        F.when(e % 4 == 0, F.concat(F.lit("2001:db8::"), h))
        .when(e % 4 == 1, F.concat(F.lit("1:2:3:4:5:6:7:"), h))
        .when(e % 4 == 2, F.concat(F.lit("1:2:3:4:5:6:"), h))
        .otherwise(F.concat(F.lit("1:2:3::5:6:7:8:"), h))
    )
    return t.events.select(
        "event_id",
        text.valid_uuid(uuid).alias("is_uuid"),
        text.valid_ipv4(ipv4).alias("is_ipv4"),
        text.valid_ipv6(ipv6).alias("is_ipv6"),
    )


@query(
    "cast_bool_strict",
    """select p_partkey, p_size > 25 flag, 'unsupported type' text_reason from part""",
)
def cast_bool_strict(t: Tables) -> DataFrame:
    flag, _ = casts.cast_bool_strict(F.col("p_size") > 25, "bool")
    _, reason = casts.cast_bool_strict(F.lit("true"), "text")
    return t.part.select("p_partkey", flag.alias("flag"), reason.alias("text_reason"))


@query(
    "nullable_guard",
    """select o_orderkey, case when o_orderstatus = 'P' then 'unsupported type' else '' end required_reason,
    '' optional_reason from orders""",
)
def nullable_guard(t: Tables) -> DataFrame:
    holed = F.nullif("o_orderstatus", F.lit("P"))
    needed = casts.required(casts.cast_text(holed, "text"), holed, nullable=False)
    free = casts.required(casts.cast_text(holed, "text"), holed, nullable=True)
    return t.orders.select(
        "o_orderkey",
        F.coalesce(needed[1], F.lit("")).alias("required_reason"),
        F.coalesce(free[1], F.lit("")).alias("optional_reason"),
    )


def _coarse_sql() -> str:
    classes = {"int": "int", "bigint": "int", "double": "float", "timestamp_ntz": "datetime"}
    return " union all ".join(
        f"select '{table}' table_code, '{f.split(' ', 1)[0]}' column_code, '{classes.get(f.split(' ', 1)[1], 'string')}' class, "
        f"count(*) row_count from {table}"
        for table, columns in COLUMNS.items()
        for f in columns.split(", ")
    )


@query("coarse_type", _coarse_sql())
def coarse_type(t: Tables) -> DataFrame:
    """Classes from the schemas, row counts from the file footers; no column is read."""
    schemas = {n: getattr(t, n) for n in TABLES}
    of = F.create_map(*[x for n, df in schemas.items() for x in (
        F.lit(n), F.array(*[F.struct(F.lit(c).alias("column_code"), F.lit(d).alias("data_type")) for c, d in df.dtypes]))])
    listed = profile.table_inventory(schemas).select("table_code", "row_count", F.inline(of[F.col("table_code")]))
    return listed.select("table_code", "column_code", conform.coarse_type(F.col("data_type")).alias("class"), "row_count")
