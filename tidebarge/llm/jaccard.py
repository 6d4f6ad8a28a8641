"""Near copies by exact Jaccard similarity of word shingles: a prefix-filtered join.

A document is the set of the hashes of its shingles, in one fixed order. Of two sets with Jaccard ``least`` or more
the first ``n - ceil(least * n) + 1`` hashes (n: size of the set) share one, whatever the order is; so sets meet in an
equality join on these, and a pair is verified on the whole sets. No pair is missed and none is taken that is not
one. The order decides the cost only: hashes that several documents of a sample hold come last, so common passages
are rarely met.

Equal sets are one node. Sets that share a hash are not expanded into pairs: all are compared with the smallest one
first, the links are contracted, and then only sets that are not in the hash's largest group meet the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, cut_lineage, shuffle_width
from .graph import components
from .simhash import shingle_hashes
from .survivors import BROADCAST_ROWS, first_of_groups, small

#: Documents that common hashes are looked for in, how many of them must hold one, and most common hashes (8 MB).
SAMPLE, COMMON_DOCS, MOST_COMMON = 5_000, 3, 1_000_000
#: Hashes (of eight bytes) of a block of sets that are compared in one task.
BLOCK_HASHES = 1 << 19
#: Sets that hold a hash up to which all of them are paired; beyond it, only at places where a pair can still be a link.
FEW = 64
#: Turns of comparing with a member chosen at random, taken while pairs outside groups are so many times the postings.
MOST_TURNS, OPEN_PAIRS = 8, 8


def shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """Distinct hashes, as signed numbers in rising order."""
    return np.unique(shingle_hashes(text or b"", shingle, seed).view(np.int64))


def _sets(shingle: int, seed: int, least: float = 0.0, common: Broadcast | None = None):
    """UDF: number and size of a set, and its hashes, common ones last; only as many as sets of ``least`` must share one of."""

    @F.arrow_udf("struct<node:bigint,n:int,hashes:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        late = common.value if common else np.empty(0, dtype=np.int64)
        for batch in batches:
            nodes, sizes, sets = [], [], []
            for t in batch.cast(pa.binary()):
                h = shingle_set(t.as_py(), shingle, seed)
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63)
                sizes.append(len(h))
                if len(late):
                    known = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate((h[~known], h[known]))
                sets.append(h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1])
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists], names=["node", "n", "hashes"])

    return run


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few."""
    return small(rows, BROADCAST_ROWS)


def _common(df: DataFrame, text: str, shingle: int, seed: int) -> Broadcast:
    """Hashes that ``COMMON_DOCS`` or more different texts of the sample hold."""
    some = max(1, math.ceil(df.count() / SAMPLE))
    texts = df.where(F.pmod(F.xxhash64(text), F.lit(some)) == 0).select(F.col(text).alias("t")).distinct()
    hashes = texts.select(F.explode(_sets(shingle, seed)(F.col("t"))["hashes"]).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = hashes.where(F.col("n") >= COMMON_DOCS).orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return df.sparkSession.sparkContext.broadcast(np.sort(found.column("h").to_numpy()))


def _enough(common: Column, a: Column, b: Column, least: float) -> Column:
    """Do sets of sizes ``a`` and ``b`` with ``common`` hashes in common have Jaccard ``least`` or more?"""
    return common >= (a + b) * F.lit(least / (1 + least)) - F.lit(1e-9)


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and node without hashes of one node; the first and last hash of a slice always stay."""
    held, known = None, None  # rows of the last hash, so far of one node; a hash known to stay
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
        h, node = t.column("h").to_numpy(), t.column("node").to_numpy()
        if known is None:
            known = h[0]
        starts = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
        ends = np.r_[starts[1:], len(h)]
        stays = (node[starts] != node[ends - 1]) | (h[starts] == known)
        keep = np.repeat(stays, ends - starts)
        # rows that repeat hash and node say nothing new
        keep[1:] &= (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        known, held = h[-1] if stays[-1] else known, None
        if not stays[-1]:
            held = t.slice(int(starts[-1]), 1).to_batches()[0]
        yield from t.filter(pa.array(keep)).to_batches()
    if held is not None:
        yield held


def _linked_pairs(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of the pairs ``(p, q)`` whose sets in ``whole`` (``node``, ``hashes``) have Jaccard ``least`` or more.

    Nodes are dealt into blocks of some :data:`BLOCK_HASHES` hashes. A task compares the pairs of two blocks; a set is
    sent to it once, however many pairs it stands in there.
    """
    total = whole.agg(F.sum(F.size("hashes"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_HASHES))
    block = lambda c: F.pmod(F.col(c), F.lit(n)).cast("int")
    dealt = pairs.select("p", "q", block("p").alias("bp"), block("q").alias("bq"))
    needed = dealt.select("bp", "bq", F.explode(F.array("p", "q")).alias("node")).distinct()
    sets = needed.join(whole, "node").select("bp", "bq", "node", "hashes")

    def compare(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        lists = sets.column("hashes").combine_chunks()
        ends = lists.offsets.to_numpy()
        at, values = dict(zip(sets.column("node").to_pylist(), zip(ends[:-1], ends[1:]))), lists.values.to_numpy()
        found = []
        for p, q in zip(pairs.column("p").to_pylist(), pairs.column("q").to_pylist()):
            x, y = values[slice(*at[p])], values[slice(*at[q])]
            # both rise: what of the smaller one stands in the larger one
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            place = np.searchsorted(large, small)
            common = int((large[np.minimum(place, len(large) - 1)] == small).sum()) if len(large) else 0
            if common >= (len(x) + len(y)) * (least / (1 + least)) - 1e-9:
                found.append((p, q))
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate("ab")})

    dealt = dealt.toDF("p", "q", "bp_", "bq_")
    return sets.groupBy("bp", "bq").cogroup(dealt.groupBy("bp_", "bq_")).applyInArrow(compare, "a long, b long")


def linked_texts(df: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """``(tx, component)`` for every text, ``tx`` being its ``xxhash64``; a link is a Jaccard similarity of ``least`` or more.

    The hashes to meet by are shuffled once, in ranges (a hash of any number of sets spreads over tasks); what a single
    set holds ends there. Pairs are narrow rows until a bound on what they can share, exact and taken from the hashes
    to meet by, has thrown out nearly all that are no links; only then are whole sets sent.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    made = _sets(shingle, seed, least, _common(df, text, shingle, seed))
    sets = df.select(F.xxhash64(text).alias("tx"), made(F.col(text)).alias("s"))
    sets = cut_lineage(sets.select("tx", "s.node", "s.n", "s.hashes"))  # the hashes to meet by, a fifth of all
    spread = sets.select(F.posexplode("hashes").alias("at", "h"), "node", "n").select("h", "node", "n", "at")
    spread = spread.repartitionByRange(shuffle_width(spark), "h", "node").sortWithinPartitions("h", "node")
    met = cut_lineage(spread.mapInArrow(_shared_only, "h long, node long, n int, at int").distinct())
    heads = met.groupBy("h").agg(F.min("node").alias("p"), F.max("node").alias("last")).where("p <> last").select("h", "p")
    postings = cut_lineage(met.join(heads, "h"))
    end = lambda p: [F.col("node").alias(p), F.col("n").alias(f"n_{p}"), F.col("at").alias(f"at_{p}")]
    of_pair = ["p", "q", "n_p", "n_q"]
    seen = [f(F.col(at)).alias(f"{name}_{at[-1]}") for name, f in (("first", F.min), ("last", F.max)) for at in ("at_p", "at_q")]

    # at the first hash that a pair shares, both sets must have enough left
    left = F.least(F.col("n_p") - F.col("at_p"), F.col("n_q") - F.col("at_q"))
    can = _enough(left, F.col("n_p"), F.col("n_q"), least)

    def met_by(n: Column) -> Column:
        return n - F.ceil(F.lit(least) * n - F.lit(1e-9)) + 1

    def may(common: Column) -> Column:
        """Can a pair that shares ``common`` of the hashes to meet by be a link?

        Up to the smaller end of both lists they share nothing else: one set has its rest behind its list left, the other
        what follows the last shared place.
        """
        a, b = F.col("n_p"), F.col("n_q")
        behind_a, behind_b = a - F.col("last_p") - 1, b - F.col("last_q") - 1
        rest = F.greatest(F.least(a - met_by(a), behind_b), F.least(behind_a, b - met_by(b)))
        whole = F.least(a - F.col("first_p"), b - F.col("first_q"))
        return _enough(F.least(common + rest, whole), a, b, least)

    def of_pairs(pairs: DataFrame) -> DataFrame:
        """Rows of ``sets`` that stand in a pair."""
        ends = pairs.select(F.col("p").alias("node")).unionByName(pairs.select(F.col("q").alias("node"))).distinct()
        return sets.join(_small(ends), "node", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``(p, q)`` that are links, as ``(a, b)``; their whole sets are made again from a text of each."""
        pairs = cut_lineage(pairs.select("p", "q"))
        texts = _small(cut_lineage(of_pairs(pairs).groupBy("node").agg(F.min("tx").alias("tx")).select("tx")))
        whole = df.select(F.col(text).alias("t")).withColumn("tx", F.xxhash64("t")).join(texts, "tx", "left_semi")
        whole = whole.select(_sets(shingle, seed)(F.col("t")).alias("s")).select("s.node", "s.hashes")
        whole = cut_lineage(whole.dropDuplicates(["node"]))
        return cut_lineage(_linked_pairs(pairs, whole, least))

    tops = postings.where("node = p").select("h", F.col("n").alias("n_p"), F.col("at").alias("at_p"))
    pairs = postings.join(tops, "h").select("p", "n_p", "at_p", *end("q")).where("p <> q").groupBy(*of_pair).agg(*seen)
    # the head of a hash need not be that of all hashes that a pair shares, so they are counted on the lists
    pairs = cut_lineage(pairs.where(may(F.least("n_p", "n_q"))))
    lists = of_pairs(pairs).select("node", "hashes").dropDuplicates(["node"])
    near = pairs.join(lists.toDF("q", "y"), "q").join(lists.toDF("p", "x"), "p")
    links = verified(near.where(may(F.size(F.array_intersect("x", "y")))))

    def settled(links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Postings with their groups, the largest group of every hash, and how many pairs lie outside these."""
        names = links.toDF("__node", "__c")
        rows = postings.select("h", "node", "n", "at").join(names, F.col("node") == F.col("__node"), "left").withColumn("c", F.coalesce("__c", "node"))
        rows = cut_lineage(rows.select("h", "node", "n", "at", "c"))
        main = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(
            F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("m").alias("m"), F.max("m").alias("most")
        )
        main = cut_lineage(main.where("groups > 1"))
        return rows, main, main.agg(F.sum((F.col("m") - F.col("most")) * F.col("m"))).first()[0] or 0

    # large groups whose head is an outsider: all of a hash are compared with a member chosen at random, several times
    groups, size = cut_lineage(components(links)), postings.count()
    rows, main, open_pairs = settled(groups)
    before = math.inf
    for turn in range(MOST_TURNS):
        if open_pairs <= OPEN_PAIRS * size or open_pairs > before * 0.7:  # few, or no longer of groups
            break
        before = open_pairs
        many = rows.join(main.where(F.col("m") > FEW).select("h"), "h")
        chosen = F.min_by(F.struct("node", "n", "c"), F.xxhash64("node", "h", F.lit(turn))).alias("x")
        tops = many.groupBy("h").agg(chosen).select("h", F.col("x.c").alias("c_p"), F.col("x.node").alias("p"), F.col("x.n").alias("n_p"))
        met = many.join(tops, "h").where("c <> c_p").select("p", "n_p", *end("q"))
        met = met.where(_enough(F.least("n_p", "n_q"), F.col("n_p"), F.col("n_q"), least)).select("p", "q").distinct()
        found = verified(met)
        if found.isEmpty():
            break
        groups = cut_lineage(components(groups.toDF("a", "b").unionByName(found)))
        rows, main, open_pairs = settled(groups)

    # what is left: sets outside the largest group of their hash are met by all of it
    marks = main.select("h", "main", (F.col("m") > FEW).alias("many"))
    rows = cut_lineage(rows.join(marks, "h").withColumn("other", F.col("c") != F.col("main")))
    # hashes of many sets that a set has: a pair may share as many without being seen there
    unseen = rows.where("many").groupBy(F.col("node").alias("u")).agg(F.count(F.lit(1)).alias("unseen"))
    rows = rows.join(unseen, F.col("node") == F.col("u"), "left").withColumn("unseen", F.coalesce("unseen", F.lit(0)))
    also = lambda p: [*end(p), F.col("unseen").alias(f"unseen_{p}"), F.col("c").alias(f"c_{p}")]
    others = rows.where("other").select("h", "many", *also("p")).join(rows.select("h", "other", *also("q")), "h")
    # of two sets in different groups one is outside the largest at every hash they share: each is counted once
    swap = F.col("p") > F.col("q")
    both = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for a, b in (("p", "q"), ("n_p", "n_q"), ("at_p", "at_q")) for x, y in ((a, b), (b, a))]
    met_at = others.where("c_p <> c_q and (not other or p < q)").where(~F.col("many") | can)
    met_at = met_at.select(*both, "many", F.least("unseen_p", "unseen_q").alias("unseen"))
    counted = met_at.groupBy(*of_pair, "unseen").agg(F.count_if(~F.col("many")).alias("common"), *seen)
    second = verified(counted.where(may(F.col("common") + F.col("unseen"))))
    groups = components(groups.toDF("a", "b").unionByName(second)).toDF("__node", "__c")
    known = sets.select("tx", "node").distinct().join(groups, F.col("node") == F.col("__node"), "left")
    return known.select("tx", F.coalesce("__c", "node").alias("component"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the smallest id stays, then by the text's hash.

    Rows are told apart by their contents, not ids; rows without an id stay only where the component has none with one.
    Texts without a word are copies of each other, as are texts with the same shingles. Of rows equal in all columns
    one stays. Work names give way to the input's columns. Survivors are chosen on hashes; whole rows are only
    filtered by them.
    """
    groups = linked_texts(df, text, shingle, least, seed)
    return first_of_groups(df, groups, doc_id, text, BROADCAST_ROWS)
