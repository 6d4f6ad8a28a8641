"""Audits over tables of SQL statements, names, endpoints and secrets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import endpoint_reason

# words refused in user SQL, and comment marks. Fixed values.
UNSAFE_WORDS = (
    "drop", "delete", "truncate", "alter", "create", "insert", "update", "replace",
    "grant", "revoke", "shutdown", "backup", "restore", "lock", "unlock", "rename",
)
UNSAFE_MARKS = ("/*", "*/", "--")

# Reserved words of the source databases. Fixed values.
RESERVED_WORDS = (
    "ACCESSIBLE", "ADD", "ALL", "ALTER", "ANALYZE", "AND", "AS", "ASC", "ASENSITIVE", "BEFORE", "BETWEEN", "BIGINT",
    "BINARY", "BLOB", "BOTH", "BY", "CALL", "CASCADE", "CASE", "CHANGE", "CHAR", "CHARACTER", "CHECK", "COLLATE",
    "COLUMN", "CONDITION", "CONSTRAINT", "CONTINUE", "CONVERT", "CREATE", "CROSS", "CUBE", "CURRENT_DATE",
    "CURRENT_TIME", "CURRENT_TIMESTAMP", "CURRENT_USER", "CURSOR", "DATABASE", "DATABASES", "DAY_HOUR",
    "DAY_MICROSECOND", "DAY_MINUTE", "DAY_SECOND", "DEC", "DECIMAL", "DECLARE", "DEFAULT", "DELAYED", "DELETE",
    "DESC", "DESCRIBE", "DETERMINISTIC", "DISTINCT", "DISTINCTROW", "DIV", "DOUBLE", "DROP", "DUAL", "EACH", "ELSE",
    "ELSEIF", "ENCLOSED", "ESCAPED", "EXCEPT", "EXISTS", "EXIT", "EXPLAIN", "FALSE", "FETCH", "FLOAT", "FLOAT4",
    "FLOAT8", "FOR", "FORCE", "FOREIGN", "FROM", "FULLTEXT", "GENERATED", "GET", "GRANT", "GROUP", "HAVING",
    "HIGH_PRIORITY", "HOUR_MICROSECOND", "HOUR_MINUTE", "HOUR_SECOND", "IF", "IGNORE", "IN", "INDEX", "INFILE",
    "INNER", "INOUT", "INSENSITIVE", "INSERT", "INT", "INT1", "INT2", "INT3", "INT4", "INT8", "INTEGER", "INTERVAL",
    "INTO", "IO_AFTER_GTIDS", "IO_BEFORE_GTIDS", "IS", "ITERATE", "JOIN", "KEY", "KEYS", "KILL", "LEADING", "LEAVE",
    "LEFT", "LIKE", "LIMIT", "LINEAR", "LINES", "LOAD", "LOCALTIME", "LOCALTIMESTAMP", "LOCK", "LONG", "LONGBLOB",
    "LONGTEXT", "LOOP", "LOW_PRIORITY", "MASTER_BIND", "MASTER_SSL_VERIFY_SERVER_CERT", "MATCH", "MAXVALUE",
    "MEDIUMBLOB", "MEDIUMINT", "MEDIUMTEXT", "MIDDLEINT", "MINUTE_MICROSECOND", "MINUTE_SECOND", "MOD", "MODIFIES",
    "NATURAL", "NOT", "NO_WRITE_TO_BINLOG", "NULL", "NUMERIC", "ON", "OPTIMIZE", "OPTIMIZER_COSTS", "OPTION",
    "OPTIONALLY", "OR", "ORDER", "OUT", "OUTER", "OUTFILE", "PARTITION", "PRECISION", "PRIMARY", "PROCEDURE",
    "PURGE", "RANGE", "READ", "READS", "READ_WRITE", "REAL", "REFERENCES", "REGEXP", "RELEASE", "RENAME", "REPEAT",
    "REPLACE", "REQUIRE", "RESIGNAL", "RESTRICT", "RETURN", "REVOKE", "RIGHT", "RLIKE", "ROW", "ROWS", "SCHEMA",
    "SCHEMAS", "SECOND_MICROSECOND", "SELECT", "SENSITIVE", "SEPARATOR", "SET", "SHOW", "SIGNAL", "SMALLINT",
    "SPATIAL", "SPECIFIC", "SQL", "SQLEXCEPTION", "SQLSTATE", "SQLWARNING", "SQL_BIG_RESULT", "SQL_CALC_FOUND_ROWS",
    "SQL_SMALL_RESULT", "SSL", "STARTING", "STORED", "STRAIGHT_JOIN", "TABLE", "TERMINATED", "THEN", "TINYBLOB",
    "TINYINT", "TINYTEXT", "TO", "TRAILING", "TRIGGER", "TRUE", "UNDO", "UNION", "UNIQUE", "UNLOCK", "UNSIGNED",
    "UPDATE", "USAGE", "USE", "USING", "UTC_DATE", "UTC_TIME", "UTC_TIMESTAMP", "VALUES", "VARBINARY", "VARCHAR",
    "VARCHARACTER", "VARYING", "VIRTUAL", "WHEN", "WHERE", "WHILE", "WITH", "WRITE", "XOR", "YEAR_MONTH",
    "ZEROFILL",
)

# What counts as a table name: optionally quoted, optionally with a schema. Fixed values.
NAME = r"""[`"\[]?[a-zA-Z0-9_]+[`"\]]?(?:\s*\.\s*[`"\[]?[a-zA-Z0-9_]+[`"\]]?)?"""
FROM_LIST = rf"(?i)from\s+({NAME}(?:\s*,\s*{NAME})*)"
JOIN_NAME = rf"(?i)join\s+({NAME})"
COMMENTS = r"--[^\n]*\z|/\*[\s\S]*?\*/"
COMMENTS_STRICT = r"--[^\n]*|/\*[\s\S]*?\*/"


def unsafe_hits(low: Column) -> Column:
    """Refused words and marks in a lower-case statement, as an array.

    A word counts only with a blank on both sides, so a leading word or a line
    break goes unseen; :func:`unsafe_strict` sees those.
    """
    words = [F.when(low.contains(f" {w} "), F.lit(w)) for w in UNSAFE_WORDS]
    marks = [F.when(low.contains(m), F.lit(m)) for m in UNSAFE_MARKS]
    return F.array_compact(F.array(*words, *marks))


def unsafe_strict(low: Column) -> Column:
    """True when a refused word stands anywhere as a word, or a comment mark is present."""
    marked = reduce(or_, [low.contains(m) for m in UNSAFE_MARKS])
    return marked | low.rlike(rf"(?:^|[^a-z0-9_])(?:{'|'.join(UNSAFE_WORDS)})(?![a-z0-9_])")


def _screened(df: DataFrame, statement: str) -> DataFrame:
    """Lower-case text and whether any word or mark is in it at all.

    Both are columns of their own, so they are computed once and the finer checks
    run only on the few statements that need them.
    """
    low = F.col("__low")
    return df.withColumn("__low", F.lower(F.col(statement))).withColumn(
        "__any", reduce(or_, [low.contains(w) for w in (*UNSAFE_MARKS, *UNSAFE_WORDS)])
    )


def sql_safety(df: DataFrame, statement: str) -> DataFrame:
    """Adds ``hits``, ``is_safe`` and ``is_safe_strict`` to a table of statements."""
    low, found = F.col("__low"), F.col("__any")
    none = F.array().cast("array<string>")
    return (
        _screened(df, statement)
        .select(
            *df.columns,
            F.when(found, unsafe_hits(low)).otherwise(none).alias("hits"),
            (~(found & unsafe_strict(low))).alias("is_safe_strict"),
        )
        .withColumn("is_safe", F.size("hits") == 0)
    )


def sql_safety_counts(df: DataFrame, statement: str) -> DataFrame:
    """Statements per refused word."""
    return (
        _screened(df, statement)
        .where("__any")
        .select(F.explode(unsafe_hits(F.col("__low"))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("statements"))
    )


def table_names(col: Column, strict_comments: bool = False) -> Column:
    """Table names after FROM (comma lists too) and JOIN, distinct, quotes kept, aliases dropped.

    The search runs over the whole statement, so names in nested selects are
    found without descending into parentheses.
    """
    return _names_in(_without_comments(col, strict_comments))


def _without_comments(col: Column, strict: bool) -> Column:
    marked = col.contains("--") | col.contains("/*")
    return F.when(marked, F.regexp_replace(col, COMMENTS_STRICT if strict else COMMENTS, "")).otherwise(col)


def _names_in(clean: Column) -> Column:
    lists = F.regexp_extract_all(clean, F.lit(FROM_LIST), F.lit(1))
    listed = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    joined = F.regexp_extract_all(clean, F.lit(JOIN_NAME), F.lit(1))
    # the first word: a blank before a dot ends the name
    bare = F.transform(F.concat(listed, joined), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
    return F.array_distinct(bare)


def table_lineage(df: DataFrame, statement: str, keep: Sequence[str] = (), strict_comments: bool = False) -> DataFrame:
    """One row per statement and table it reads."""
    clean = df.select(*keep, _without_comments(F.col(statement), strict_comments).alias("__clean"))
    return clean.select(*keep, F.explode(_names_in(F.col("__clean"))).alias("table_name"))


def lineage_counts(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("table_name").agg(F.count(F.lit(1)).alias("statements"))


def reserved_names(df: DataFrame, name: str, words: DataFrame | Iterable[str] = RESERVED_WORDS) -> DataFrame:
    """Adds ``is_refused``: a bare table name equal to a reserved word. A quoted name never equals one.

    ``words`` is a list, or a one-column frame for a source's full list.
    """
    upper = F.upper(F.col(name))
    if not isinstance(words, DataFrame):
        return df.withColumn("is_refused", upper.isin([w.upper() for w in words]))
    listed = words.select(F.upper(F.col(words.columns[0])).alias("__w")).distinct().withColumn("__hit", F.lit(True))
    return (
        df.join(listed, upper == F.col("__w"), "left")
        .withColumn("is_refused", F.coalesce(F.col("__hit"), F.lit(False)))
        .drop("__w", "__hit")
    )


def endpoints(df: DataFrame, address: str) -> DataFrame:
    return df.withColumn("reason", endpoint_reason(F.col(address)))


def protect(df: DataFrame, column: str, key: Column) -> DataFrame:
    """Encrypt a text column (AES-GCM, random IV, base64). ``key`` comes from the caller's secret store."""
    return df.withColumn(column, F.replace(F.base64(F.aes_encrypt(F.col(column), key)), F.lit("\r\n"), F.lit("")))


def reveal(df: DataFrame, column: str, key: Column) -> DataFrame:
    """Decrypt; a value that cannot be decrypted with this key is NULL."""
    return df.withColumn(column, F.try_aes_decrypt(F.unbase64(F.col(column)), key).cast("string"))
