"""Sharding by k-d tree partitioning.

Documents of equal text form one item, so copies share a shard. An item is a point: its metadata (source,
language, length, smallest id) as numbers, each with a hash fraction added so that points of one value can be
told apart. Every leaf that is still over its target is split at the weighted median along its widest
dimension (spread in units of the whole table's), for all leaves in one pass a step. A median is found by
histograms of the leaf's weight that are narrowed around it: counts of a few hundred bins a leaf, never the
points, come to the driver, so a leaf with most of the table is split like any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_group_position
from .base import cut_lineage, put

#: Bins of a histogram, and times it is narrowed at most (each divides the open stretch by BINS).
BINS, STEPS = 256, 8


@dataclass
class Leaf:
    weight: float
    parts: int  # shards this leaf will be split into


def _unit(*columns) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _median(points: DataFrame, leaves: dict[int, tuple[str, float, float, float]]) -> dict[int, float]:
    """For every leaf (dimension, low, high, wanted weight below the cut) the cut whose lower side comes nearest.

    ``points`` has ``leaf``, ``weight`` and the dimensions. Low is inclusive, high exclusive.
    """
    open_ = {leaf: (dim, lo, hi, wanted, 0.0) for leaf, (dim, lo, hi, wanted) in leaves.items()}
    cuts: dict[int, float] = {}
    for _ in range(STEPS):
        if not open_:
            break
        spark = points.sparkSession
        plan = spark.createDataFrame([(leaf, d, lo, hi) for leaf, (d, lo, hi, _, _) in open_.items()], "leaf int, dim string, lo double, hi double")
        value = F.element_at("at", F.col("dim"))
        bin_ = F.least(F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"), F.lit(BINS - 1))
        bins = (
            points.join(F.broadcast(plan), "leaf").where((value >= F.col("lo")) & (value < F.col("hi")))  # one row per open leaf
            .groupBy("leaf", bin_.alias("bin")).agg(F.sum("weight").alias("w"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        )
        again = {}
        for leaf, (dim, lo, hi, wanted, below) in open_.items():
            mine = sorted((b for b in bins if b["leaf"] == leaf), key=lambda b: b["bin"])
            best, at, total = None, None, below
            for b in mine:
                if best is None or abs(total - wanted) < best[0]:
                    best = (abs(total - wanted), b["low"])
                if total < wanted <= total + b["w"]:
                    at = (b, total)
                total += b["w"]
            if mine and abs(total - wanted) < best[0]:
                best = (abs(total - wanted), hi)
            if at and at[0]["low"] < at[0]["high"] and best[0] > 0:
                again[leaf] = (dim, at[0]["low"], _above(at[0]["high"]), wanted, at[1])
            cuts[leaf] = best[1] if best else hi
        open_ = again
    return cuts


def _above(x: float) -> float:
    return math.nextafter(x, math.inf)


def kd_leaves(items: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) to items with ``weight`` and the numeric columns ``dims``.

    A leaf that owes k shards is cut where its weight falls into k // 2 and the other k parts, so the shards come
    near equal for any number of them. An item heavier than a shard's target has its shard to itself, as far as
    the cuts allow. No item: an empty result.
    """
    names = F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d).cast("double"))])
    points = cut_lineage(items.withColumn("at", names).withColumn("leaf", F.lit(0)))
    whole = points.agg(*[F.max(d) - F.min(d) for d in dims], F.sum("weight")).first()
    spread = {d: float(whole[i] or 0) or 1.0 for i, d in enumerate(dims)}
    leaves = {0: Leaf(float(whole[len(dims)] or 0), shards)}
    done: dict[int, int] = {}  # leaf number: first shard
    first = {0: 0}
    n = 1
    while any(v.parts > 1 for v in leaves.values()):
        busy = [k for k, v in leaves.items() if v.parts > 1]
        stats = {
            r["leaf"]: r for r in points.where(F.col("leaf").isin(busy)).groupBy("leaf")
            .agg(F.sum("weight").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()
        }
        plans = {}
        for k in busy:
            if k not in stats:  # an empty leaf: its shards stay empty
                leaves[k].parts = 1
                continue
            r = stats[k]
            widest = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / spread[d])
            low_parts = leaves[k].parts // 2
            plans[k] = (widest, float(r[f"lo_{widest}"]), _above(float(r[f"hi_{widest}"])), float(r["w"]) * low_parts / leaves[k].parts)
        cuts = _median(points, plans)
        moves = []
        for k, cut in cuts.items():
            low_parts = leaves[k].parts // 2
            leaves[n] = Leaf(0.0, leaves[k].parts - low_parts)
            first[n] = first[k] + low_parts
            leaves[k] = Leaf(0.0, low_parts)
            moves.append((k, plans[k][0], cut, n))
            n += 1
        if moves:
            spark = points.sparkSession
            table = spark.createDataFrame(moves, "leaf int, dim string, cut double, upper int")
            moved = points.join(F.broadcast(table), "leaf", "left")  # a row per leaf that was cut
            leaf = F.when(F.element_at("at", F.coalesce("dim", F.lit(dims[0]))) >= F.col("cut"), F.col("upper")).otherwise(F.col("leaf"))
            points = cut_lineage(moved.withColumn("leaf", leaf).drop("dim", "cut", "upper"))
    done.update(first)
    numbers = F.create_map(*[F.lit(x) for kv in done.items() for x in kv])
    return points.withColumn("shard", F.element_at(numbers, F.col("leaf")).cast("int")).drop("at", "leaf")


def shard_documents(
    docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, a row per row of ``docs``.

    ``size`` is the bytes of the text plus 1, ``slot`` numbers a shard's rows from 0 in the order of id, size and
    checksum. Null texts form one group and are told from empty ones only by having no checksum difference: both
    have size 1. Null metadata counts as the empty word; rows without an id come last in their shard. Repeated rows
    are copies like any other.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = cut_lineage(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(F.col(lang), F.lit("")).alias("lang"),
    ))
    # a text is known by two hashes and its length
    items = rows.groupBy("h", "text_crc32", "size").agg(
        F.sum("size").cast("double").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("low")
    )
    fraction = _unit("h", "text_crc32")
    points = items.select(
        "h", "text_crc32", "size", "weight",
        (_unit("source") * 1000 + fraction / 1000).alias("by_source"), (_unit("lang") * 1000 + fraction / 1000).alias("by_lang"),
        (F.log2(F.col("size").cast("double")) + fraction / 1000).alias("by_length"),
        (F.coalesce("low", F.lit(0)).cast("double") + fraction / 2).alias("by_id"),
    )
    placed = cut_lineage(kd_leaves(points, ["by_source", "by_lang", "by_length", "by_id"], shards).select("h", "text_crc32", "size", "shard"))
    joined = rows.join(placed, ["h", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "shard")
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    numbered = with_group_position(joined, ["shard"], order, "slot")
    return put(numbered, slot=F.col("slot").cast("long") - 1)
