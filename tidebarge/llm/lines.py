"""Line dedup by site-relative frequency.

A line is boilerplate of a site when the share of the site's pages that contain it exceeds ``ratio``.
Lines are counted as 64-bit hashes, one row per page and distinct line, summed before the shuffle; so a
site with a third of all pages sends a row per line and task. What is boilerplate is small by nature: a
site with p pages of l distinct lines on average has fewer than l / ratio such lines. Its lists are
broadcast if they are few enough, else joined by site with the pages spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut_lineage, put, shielded

#: Boilerplate lines (all sites) up to which their lists are broadcast: at most some 16 MB.
BROADCAST_LINES = 1_000_000
#: Parts a site's pages are spread over when the lists are joined by a shuffle.
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null when it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column, separator: str) -> Column:
    return F.split(text, separator, -1)


def boilerplate(pages: DataFrame, host: Column, text: str = "text", separator: str = "\n", ratio: float = 0.08, least: int = 5) -> DataFrame:
    """``(host, line, pages, total)``: hashes of lines on more than ``ratio`` of a host's pages, and on ``least`` pages or more."""
    rows = pages.select(host.alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    filled = F.filter(_lines(F.col("text"), separator), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(filled, line_key))
    counts = rows.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.where(F.col("pages") >= least)
    # a row per host: its total goes along by a join on the host, split if one host holds most lines
    return (
        counts.join(totals.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
        .where(F.col("pages") > F.col("total") * F.lit(float(ratio))).select("host", "line", "pages", "total")
    )


@shielded
def drop_boilerplate(
    pages: DataFrame, host: Column, text: str = "text", separator: str = "\n", ratio: float = 0.08, least: int = 5,
    lines: str | None = None, dropped: str | None = None,
) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text``; the order of the others is kept.

    Lines are compared without blanks at their ends; blank lines are neither counted nor dropped. Pages of a
    null host form a site of their own. A null text stays null; a page whose lines all go keeps an empty text.
    Repeated rows count each. ``lines`` and ``dropped`` name columns for the numbers of lines and of dropped
    lines (0 for a null text).
    """
    found = cut_lineage(boilerplate(pages, host, text, separator, ratio, least).select("host", "line"))
    lists = found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__drop"))
    rows = pages.withColumn("__site", host)
    if found.count() <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(lists), F.col("__site").eqNullSafe(F.col("__host")), "left")
    else:
        salted = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        same = F.col("__site").eqNullSafe(F.col("__host")) & (F.col("__part") == F.col("__salt"))
        joined = rows.join(salted, same, "left")
    all_lines = _lines(F.col(text), separator)
    kept = F.filter(all_lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), line_key(x)))
    clean = put(joined, __kept=F.when(F.col("__drop").isNotNull(), kept))
    some = F.col("__kept").isNotNull()
    out = {text: F.when(some, F.array_join("__kept", separator)).otherwise(F.col(text))}
    n = F.coalesce(F.when(F.col(text).isNotNull(), F.size(all_lines)), F.lit(0)).cast("long")
    if lines:
        out[lines] = n
    if dropped:
        out[dropped] = F.when(some, n - F.size("__kept")).otherwise(F.lit(0)).cast("long")
    order = [c for c in pages.columns if c.lower() not in {k.lower() for k in out}] + [c for c in out if c not in pages.columns]
    done = put(clean, **out)
    return done.select([F.col(f"`{c}`") for c in pages.columns] + [F.col(c) for c in order if c not in pages.columns])
