"""Operational databases through Spark's JDBC source, and pushes through DB-API connections."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from ..plans.specs import ColumnDescriptor
from ..operators.conform import create_table_column_types
from ..sinks.tables import rows_per_statement


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A user SELECT, run by the source itself; later filters are pushed into it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_partitioned(
    spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int, **options: str
) -> DataFrame:
    """The same SELECT (``table`` may be ``(select ...) t``) over parallel connections."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper),
            numPartitions=str(partitions), **options,
        )
        .load()
    )


def slice_predicates(column: str, lower: int, upper: int, partitions: int) -> list[str]:
    """WHERE clauses that cut a table into ranges for ``spark.read.jdbc(predicates=...)``.

    The first and last range are open and NULLs go to the first, so every row is
    in exactly one of them, inside the bounds or not.
    """
    if partitions < 2 or upper <= lower:
        return ["1 = 1"]
    step = max(1, (upper - lower) // partitions)
    cuts = [lower + step * i for i in range(1, partitions) if lower + step * i < upper]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts[:-1], cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def read_ranges(spark: SparkSession, url: str, table: str, predicates: Sequence[str], **options: str) -> DataFrame:
    """The same SELECT with one connection per range (see ``ranges.range_predicates``): tasks of equal size for any key.

    The ranges can be made from :func:`read_partitioned` over the key columns only, whose equal-width slices are
    summarised where they are read.
    """
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=options)


def reserved_words(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The source's own reserved words, for ``reserved_names``."""
    return read_query(spark, url, "select word from information_schema.keywords where reserved = 1", **options)


def write_truncate_insert(
    df: DataFrame, url: str, table: str, batch: int, columns: Sequence[ColumnDescriptor] = (), **options: str
) -> None:
    """Push to a table without a primary key: empty it, then insert everything."""
    writer = df.write.format("jdbc").options(
        url=url, dbtable=table, truncate="true", batchsize=str(batch), **options
    )
    if columns:
        writer = writer.option("createTableColumnTypes", create_table_column_types(columns))
    writer.mode("overwrite").save()


def replace_statement(table: str, columns: Sequence[str], rows: int, mark: str = "?") -> str:
    one = "(" + ",".join([mark] * len(columns)) + ")"
    return f"replace into {table}({','.join(columns)}) values {','.join([one] * rows)}"


def replace_partition(connect: Callable[[], object], table: str, columns: Sequence[str], batch: int, mark: str = "?"):
    """Function for ``foreachPartition``: keyed replace in batches, one transaction per batch.

    A retried task replaces the same rows again, which changes nothing.
    """

    def send(rows: Iterable) -> None:
        connection = connect()
        try:
            rows = iter(rows)
            while chunk := list(islice(rows, batch)):
                cursor = connection.cursor()
                try:
                    cursor.execute(
                        replace_statement(table, columns, len(chunk), mark), [v for r in chunk for v in r]
                    )
                    connection.commit()
                except Exception:
                    connection.rollback()
                    raise
                finally:
                    cursor.close()
        finally:
            connection.close()

    return send


def write_replace(
    df: DataFrame, connect: Callable[[], object], table: str, batch: int, mark: str = "?", writers: int = 8
) -> None:
    """Push to a table with a primary key. ``df`` holds one row per key; ``writers`` bounds open connections."""
    batch = rows_per_statement(batch, len(df.columns))
    # a shuffle, so that only the writing is bound to this few tasks, not the work before it
    df.repartition(writers).foreachPartition(replace_partition(connect, table, df.columns, batch, mark))
