"""Audits of statements, names, endpoints and secrets over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import governance
from .frames import STATEMENTS, statements
from .registry import Tables, query

# spelled out here, not taken from the operator under test
_WORDS = (
    "drop", "delete", "truncate", "alter", "create", "insert", "update", "replace",
    "grant", "revoke", "shutdown", "backup", "restore", "lock", "unlock", "rename",
)
_HITS = " || ".join(
    [f"case when contains(low, ' {w} ') then '{w},' else '' end" for w in _WORDS]
    + [f"case when contains(low, '{m}') then '{m},' else '' end" for m in ("/*", "*/", "--")]
)
_STRICT = "regexp_matches(text, '(?i)\\b(" + "|".join(_WORDS) + ")\\b|/\\*|\\*/|--')"


@query(
    "sql_safety_audit",
    f"""with {STATEMENTS}, l as (select statement_id, text, lower(text) low from st)
    select statement_id, {_HITS} hits, ({_HITS}) = '' is_safe, not {_STRICT} is_safe_strict from l""",
)
def sql_safety_audit(t: Tables) -> DataFrame:
    checked = governance.sql_safety(statements(t), "text")
    hits = F.concat_ws("", F.transform("hits", lambda h: F.concat(h, F.lit(","))))
    return checked.select("statement_id", hits.alias("hits"), "is_safe", "is_safe_strict")


_NAME = governance.NAME.replace("'", "''")
_LINEAGE = f"""{STATEMENTS}, clean as (select statement_id, regexp_replace(text, '--[^\\n]*\\z|/\\*[\\s\\S]*?\\*/', '', 'g') s from st),
lists as (select statement_id, unnest(regexp_extract_all(s, '(?i)from\\s+({_NAME}(?:\\s*,\\s*{_NAME})*)', 1)) l from clean),
found as (select statement_id, unnest(string_split(l, ',')) n from lists
  union all select statement_id, unnest(regexp_extract_all(s, '(?i)join\\s+({_NAME})', 1)) from clean),
lineage as (select distinct statement_id, regexp_extract(n, '^\\s*(\\S+)', 1) table_name from found)"""


def lineage(t: Tables) -> DataFrame:
    return governance.table_lineage(statements(t), "text", ["statement_id"])


@query("sql_table_lineage", f"with {_LINEAGE} select table_name, count(*) statements from lineage group by 1")
def sql_table_lineage(t: Tables) -> DataFrame:
    return governance.lineage_counts(lineage(t))


@query(
    "reserved_name_audit",
    f"""with {_LINEAGE} select statement_id, table_name,
    upper(table_name) in ({', '.join(f"'{w}'" for w in governance.RESERVED_WORDS)}) is_refused from lineage""",
)
def reserved_name_audit(t: Tables) -> DataFrame:
    return governance.reserved_names(lineage(t), "table_name")


@query(
    "endpoint_audit",
    """with a as (select event_id, user_id * 3 octet, event_id * 29 port, event_type from events)
    select event_id, case when event_type = 'view' then 'format' when octet > 999 or port > 99999 then 'format'
      when octet > 255 then 'octet' when port not between 1 and 65535 then 'port' else '' end reason from a""",
)
def endpoint_audit(t: Tables) -> DataFrame:
    address = F.concat(
        F.when(F.col("event_type") == "view", F.lit("host.")).otherwise(F.lit("10.")),
        F.lit("0.0."), (F.col("user_id") * 3).cast("string"), F.lit(":"), (F.col("event_id") * 29).cast("string"),
    )
    checked = governance.endpoints(t.events.select("event_id", address.alias("address")), "address")
    return checked.select("event_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "protect_column",
    "select c_custkey, c_name revealed, true is_hidden, true is_unreadable from customer",
)
def protect_column(t: Tables) -> DataFrame:
    """Names encrypted and read back; the stored text shows nothing, and a wrong key reads nothing."""
    key, wrong = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")  # samples; real keys come from a secret store
    rows = t.customer.select("c_custkey", "c_name", F.col("c_name").alias("stored"))
    stored = governance.protect(rows, "stored", key).withColumns({"revealed": F.col("stored"), "misread": F.col("stored")})
    read = governance.reveal(governance.reveal(stored, "revealed", key), "misread", wrong)
    return read.select(
        "c_custkey", "revealed", (~F.col("stored").contains(F.col("c_name"))).alias("is_hidden"),
        F.col("misread").isNull().alias("is_unreadable"),
    )
