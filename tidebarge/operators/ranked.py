"""Lists that are read page by page, at any depth.

``ORDER BY, OFFSET, LIMIT`` sorts ``offset + limit`` rows for every page. A ranked table is sorted once, into one file per
range slice, with the number of rows per slice beside it. A page is then sought: the counts tell the slices it lies in
(one, mostly), and rows are taken by their place in the file. Nothing is sorted but the page.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_width

_SLICE = "slice__"


class RankedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        counts = spark.read.parquet(f"{self.path}/index").orderBy(_SLICE).collect()  # a row per slice, and one with the schema
        self.schema = T.StructType.fromJson(json.loads(counts[0]["schema"]))
        self.slices = [r[_SLICE] for r in counts[1:]]
        self.starts = [0, *accumulate(r["rows"] for r in counts[1:])]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def pages(self, size: int) -> int:
        return -(-self.total // size)

    def page(self, index: int, size: int, strict: bool = True) -> DataFrame:
        """Page ``index`` (from 1) in order, with the 1-based ``position`` and the ``total``.

        An index outside the pages is an error, or an empty page if not ``strict``.
        """
        if strict and not 1 <= index <= max(1, self.pages(size)):
            raise IndexError(f"page {index} is out of range [1, {self.pages(size)}]")
        low, high = (index - 1) * size, min(index * size, self.total)
        if not 0 <= low < high:
            nothing = self.spark.createDataFrame([], self.schema).drop(_SLICE)
            return nothing.withColumns({"position": F.lit(0).cast("long"), "total": F.lit(self.total).cast("long")})
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        names = [F.col(f"`{c}`") for c in rows.columns if c != _SLICE]
        place = F.col("_metadata.row_index")
        held = range(bisect_right(self.starts, low) - 1, bisect_right(self.starts, high - 1))
        here = F.lit(False)
        at = F.lit(None).cast("long")
        for i in held:  # the slices that a page lies in
            mine = F.col(_SLICE) == self.slices[i]
            here = here | mine & place.between(low - self.starts[i], high - self.starts[i] - 1)
            at = F.when(mine, place + self.starts[i] + 1).otherwise(at)
        found = rows.where(F.col(_SLICE).isin([self.slices[i] for i in held])).where(here)
        return found.select(*names, at.alias("position"), F.lit(self.total).cast("long").alias("total")).orderBy("position")


def write_ranked(df: DataFrame, order_by: Sequence[Column], path: str, slices: int | None = None) -> RankedTable:
    """Sort ``df`` by a total order into a ranked table at an unused path."""
    ranged = df.repartitionByRange(slices or shuffle_width(df.sparkSession), *order_by).withColumn(_SLICE, F.spark_partition_id())
    # one file per slice: a task holds one slice, in the order that the writer asks for
    writer = ranged.sortWithinPartitions(_SLICE, *order_by).write.mode("error").partitionBy(_SLICE).option("maxRecordsPerFile", 0)
    writer.parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    counts = written.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("rows"))  # from the footers
    schema = F.lit(json.dumps(ranged.schema.jsonValue())).alias("schema")
    head = df.sparkSession.range(1).select(F.lit(-1).alias(_SLICE), F.lit(0).cast("long").alias("rows"), schema)
    counts.select(_SLICE, "rows", F.lit("").alias("schema")).unionByName(head).coalesce(1).write.mode("error").parquet(f"{path}/index")
    return RankedTable(df.sparkSession, path)
