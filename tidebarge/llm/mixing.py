"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted the same number of times, target / size of the source. The whole part
is taken as it is; the fraction left is a copy probability. Documents of a source are dealt into groups of
about ``GROUP`` by a hash. In a group, the largest document is paired with the pool of all smaller ones, which
share one probability: words move between the two, in a direction drawn at random with odds that keep
every expectation, until the document or the whole pool is at 0 or 1; then the next document is paired with
what is left of the pool. The words of a pair never change, so a group keeps its sum and leaves one open
document at most, mostly its smallest. The open ones of all groups are dealt into groups again and folded
pair by pair, level by level, until a source has a single one, which is drawn alone. So a source's taken
words miss its target by less than one document, and a source with a third of all documents is folded by as
many tasks as any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_position
from .base import cut_lineage, put, shielded, uniform

#: Documents of a group, on average; groups are dealt by a hash, so none is much larger.
GROUP = 48
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words by weight. A
    target stops at ``most`` times its source's size; what is over is shared by weight among the others until
    none is above. The numbering sorts sources in slices, and each round collects four numbers.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_position(totals, [F.col("source").asc_nulls_last()], "__at")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__at") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = cut_lineage(placed.select("source", F.col("source_size").cast("long"), turn.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    left = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight; it only rises, so a source that is capped stays so
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("cap")
        n, caps, open_weight = rows.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (left - caps) / open_weight if open_weight else float("inf")
        if new <= level or not open_weight:
            break
        level = new
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap")
    return rows.select("source", "source_size", target.alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Fold an array of open documents (size, p, id), largest first.

    Gives ``open`` (null or the one still open) and ``done`` (id and 0 or 1 for the others).
    """
    open_type, done_type = "struct<size:double,p:double,id:bigint>", "array<struct<id:bigint,one:int>>"
    start = F.struct(F.lit(None).cast(open_type).alias("open"), F.array().cast(done_type).alias("done"))

    def closed(item: Column, one: Column) -> Column:
        return F.array(F.struct(item["id"].alias("id"), one.cast("int").alias("one")))

    def step(state: Column, b: Column) -> Column:
        a, done = state["open"], state["done"]
        to_a = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # words a can get from b
        to_b = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        up = uniform(F.lit(seed), a["id"], b["id"]) * (to_a + to_b) < to_b  # a gains with odds to_b : to_a
        words = F.when(up, to_a).otherwise(-to_b)
        fills = F.when(up, a["size"] * (1 - a["p"]) <= b["size"] * b["p"]).otherwise(a["size"] * a["p"] <= b["size"] * (1 - b["p"]))
        empties = F.when(up, b["size"] * b["p"] <= a["size"] * (1 - a["p"])).otherwise(b["size"] * (1 - b["p"]) <= a["size"] * a["p"])
        # fills: a ends at 1 (up) or 0; empties: b ends at 0 (up) or 1
        a_now = F.struct(a["size"].alias("size"), (a["p"] + words / a["size"]).alias("p"), a["id"].alias("id"))
        b_now = F.struct(b["size"].alias("size"), (b["p"] - words / b["size"]).alias("p"), b["id"].alias("id"))
        none = F.lit(None).cast(open_type)
        nxt = F.when(fills & empties, none).when(fills, b_now).otherwise(a_now)
        shut = F.concat(
            F.when(fills, closed(a, up)).otherwise(F.array().cast(done_type)), F.when(empties, closed(b, ~up)).otherwise(F.array().cast(done_type))
        )
        return F.when(
            a.isNull(), F.struct(F.struct(b["size"].alias("size"), b["p"].alias("p"), b["id"].alias("id")).alias("open"), done.alias("done"))
        ).otherwise(F.struct(nxt.alias("open"), F.concat(done, shut).alias("done")))

    ordered = F.reverse(F.array_sort(items))  # by size, then p and id
    return F.aggregate(ordered, start, step)


def _fold_even(items: Column, p: Column, seed: int) -> Column:
    """Fold an array of open documents (size, p, id) that share the probability ``p``, as :func:`_fold` does.

    Each document in turn is paired with the pool of the smaller ones. When the pool closes first, the document
    stays open and the rest of the pool takes the value at which it closed.
    """
    open_type, done_type = "struct<size:double,p:double,id:bigint>", "array<struct<id:bigint,one:int>>"
    none = F.lit(None).cast(open_type)
    total = F.aggregate(items, F.lit(0.0), lambda x, i: x + i["size"])
    start = F.struct(none.alias("open"), F.array().cast(done_type).alias("done"), p.alias("p"), total.alias("rest"))

    def step(state: Column, a: Column) -> Column:
        p, done = state["p"], state["done"]
        rest = F.greatest(state["rest"] - a["size"], F.lit(0.0))
        to_a = F.least(a["size"] * (1 - p), rest * p)  # words the document can get from the pool
        to_pool = F.least(a["size"] * p, rest * (1 - p))
        up = uniform(F.lit(seed), a["id"]) * (to_a + to_pool) < to_pool
        closes = F.when(up, a["size"] * (1 - p) <= rest * p).otherwise(a["size"] * p <= rest * (1 - p))
        words = F.when(up, to_a).otherwise(-to_pool)

        def state_of(open_: Column, one: Column | None, pool: Column) -> Column:
            more = F.concat(done, F.array(F.struct(a["id"].alias("id"), one.cast("int").alias("one")))) if one is not None else done
            return F.struct(open_.alias("open"), more.alias("done"), pool.alias("p"), rest.alias("rest"))

        left = F.struct(a["size"].alias("size"), F.least(F.greatest(p + words / a["size"], F.lit(0.0)), F.lit(1.0)).alias("p"), a["id"].alias("id"))
        pool = F.least(F.greatest(p - words / rest, F.lit(0.0)), F.lit(1.0))
        return (
            F.when((p <= 0) | (p >= 1), state_of(state["open"], p >= 1, p))  # the pool is closed
            .when(rest <= 0, state_of(F.struct(a["size"].alias("size"), p.alias("p"), a["id"].alias("id")), None, p))  # the last one
            .when(closes, state_of(state["open"], up, pool))
            .otherwise(state_of(left, None, F.when(up, F.lit(0.0)).otherwise(F.lit(1.0))))
        )

    return F.aggregate(F.reverse(F.array_sort(items)), start, step)


def round_copies(open_items: DataFrame, seed: int = 0) -> DataFrame:
    """``(source, id, one)`` for rows ``(source, id, size, p)`` with 0 < p < 1, one p for each source, size > 0 and distinct ids."""
    done, level = [], 0
    rows = open_items.select("source", "id", F.col("size").cast("double").alias("size"), "p")
    while True:
        per_source = cut_lineage(rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(GROUP))).cast("long").alias("groups")))
        most = per_source.agg(F.max("groups")).first()[0]
        if most is None:
            break
        dealt = rows.join(per_source.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        dealt = dealt.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id"), F.col("groups")))
        folded = cut_lineage(
            dealt.groupBy("source", "__group").agg(F.collect_list(F.struct("size", "p", "id")).alias("items"))
            .select("source", (_fold(F.col("items"), seed + level) if level else _fold_even(F.col("items"), F.col("items")[0]["p"], seed)).alias("f")).select("source", "f.open", "f.done")
        )
        done.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.one"))
        rows = folded.where("open is not null").select("source", "open.id", "open.size", "open.p")
        level += 1
        if most == 1:  # one document of each source is left, if any
            done.append(rows.select("source", "id", (uniform(F.lit(seed), F.lit("last"), "id") < F.col("p")).cast("int").alias("one")))
            break
    if not done:
        return open_items.select("source", "id", F.lit(0).alias("one")).limit(0)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _key(doc_id: str, text: str, source: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(source), F.xxhash64(text))


def copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
) -> DataFrame:
    """``(doc_id, source, key, size, source_size, target, copies)``, a row per row of ``docs``.

    ``size`` counts words (null text: 0) and ``copies`` is how often the mix takes the row. Rows equal in id,
    source and text share one decision, as one document of all their words. Documents without a word weigh
    nothing; they are taken as often as the whole part says. A source of no words has target 0. The same
    input gives the same mix, whatever its partitioning.
    """
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _key(doc_id, text, source).alias("key"), word_count(F.col(text)).alias("size")
    ))
    targets = cut_lineage(source_targets(rows, weights, share, most))
    # few rows: one per source; the planner broadcasts them if they are small, else splits a hot source
    wide = rows.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wide = wide.withColumn("__whole", F.floor(want).cast("long")).withColumn("__p", want - F.floor(want))
    units = wide.where("size > 0 and __p > 0").groupBy("key").agg(
        F.first("source").alias("source"), F.sum("size").alias("size"), F.first("__p").alias("p")
    )
    rounded = round_copies(units.select("source", F.col("key").alias("id"), "size", "p"), seed)
    joined = wide.join(rounded.select(F.col("id").alias("__id"), "one"), F.col("key") == F.col("__id"), "left")
    return joined.select(
        "doc_id", "source", "key", "size", "source_size", "target", (F.col("__whole") + F.coalesce("one", F.lit(0))).cast("long").alias("copies")
    )


@shielded
def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    taken = copies(docs, doc_id, text, source, weights, share, most, seed).where("copies > 0")
    per_key = taken.groupBy("key").agg(F.max("copies").cast("int").alias("__n"))
    rows = docs.withColumn("__key", _key(doc_id, text, source)).join(per_key.withColumnRenamed("key", "__k"), F.col("__key") == F.col("__k"))
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__key", "__k", "__n", "__i")
