"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has a bit for each of the hash bits that more than half of the document's shingle hashes set: 64
of them, or several words of 64. It is cut into segments, and indexed under every segment with every single bit
of it taken out; fingerprints meet in an equality join on these keys, when some segment of theirs differs by
one bit at most, and are verified on all bits. With ``bits // 2 + 1`` segments no pair within ``bits`` is missed:
that is :func:`exact_cut`. A cut into fewer, longer segments than that (:func:`wide_cut`) reaches further, at the
price of pairs whose differences fall on all segments twice.

Equal fingerprints are one node from the start, so groups of copies never enter the index more than
once, and the index holds the distinct values of a segment, so neither do many fingerprints that share one. Values
shared by many near copies are not expanded into pairs: all are compared with the smallest fingerprint first,
the links found are contracted, and then only fingerprints that are not yet in the value's largest group are
compared with the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded_batches, cut_lineage, put, shielded, shuffle_width, without
from .graph import components
from .survivors import first_of_groups

BITS = 64
#: Fingerprints a task starts from, and tasks that even few fingerprints get.
SLICE_NODES, LEAST_SLICES = 20_000, 12


@dataclass(frozen=True)
class Cut:
    """How fingerprints are compared: words of 64 bits, most differing bits, segments as (first bit, width)."""

    words: int
    bits: int
    segments: tuple[tuple[int, int], ...]


def exact_cut(bits: int = 4) -> Cut:
    """64 bits, at most ``bits`` of them different (2 to 9), no pair missed."""
    n = bits // 2 + 1
    at = [BITS * i // n for i in range(n + 1)]
    return Cut(1, bits, tuple((lo, hi - lo) for lo, hi in zip(at, at[1:])))


def wide_cut(similarity: float = 0.8) -> Cut:
    """128 bits of which a share of ``similarity`` or more are equal, met in one of six segments of 20 bits.

    Of pairs that differ in 15 % of the bits (as shingle sets of Jaccard 0.8 do on average) two in three meet,
    of pairs that differ in 10 % more than nine in ten; chains over further copies add to that.
    """
    segments = ((0, 20), (20, 20), (40, 20), (64, 20), (84, 20), (104, 20))
    return Cut(2, int(2 * BITS * (1 - similarity) + 1e-9), segments)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash bits from a 64-bit hash (the finalizer of splitmix64); word 0 is the hash itself."""
    if not word:
        return h
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The hash of every shingle, as unsigned numbers; fewer words than a shingle: of their whole sequence; no word: none."""
    parts = text.lower().split()  # bytes: A-Z only, and exactly the blanks 0x20, 0x09-0x0D
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[: len(parts) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.array(hashes, dtype=np.uint64)


def fingerprint_bytes(text: bytes, shingle: int, seed: int, words: int = 1) -> tuple[int, ...]:
    """The words of the fingerprint as signed numbers; no word at all: zeros."""
    h = shingle_hashes(text, shingle, seed)
    if not len(h):
        return (0,) * words
    out = []
    for word in range(words):
        counts = np.zeros(BITS, dtype=np.int64)
        for i in range(0, len(h), 4096):
            some = _mixed(h[i : i + 4096], word).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0]))
    return tuple(out)


def _names(words: int, prefix: str = "fp") -> list[str]:
    return [prefix if i == 0 else f"{prefix}_{i}" for i in range(words)]


@shielded
def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """Add the fingerprint of ``text`` as longs ``out``, ``out_1`` and so on.

    Null or blank text: 0; fewer words than a shingle: their whole sequence.
    """
    bounded_batches(df.sparkSession)
    kind = ",".join(f"w{i}:bigint" for i in range(words))

    @F.arrow_udf(f"struct<{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [fingerprint_bytes(t.as_py() or b"", shingle, seed, words) for t in batch.cast(pa.binary())]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], type=pa.int64()) for i in range(words)], names=[f"w{i}" for i in range(words)])

    made = put(df, __made_fp=run(F.col(text)))
    return put(made, **{n: F.col(f"__made_fp.w{i}") for i, n in enumerate(_names(words, out))}).drop("__made_fp")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def differing(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def _segment(fp: list[Column], lo: int, width: int) -> Column:
    return F.shiftrightunsigned(fp[lo // BITS], lo % BITS).bitwiseAND(F.lit((1 << width) - 1))


_SEGMENT = 50  # bit of a segment's value from which its number stands


def segment_values(fp: list[Column], cut: Cut) -> Column:
    """The value of every segment, marked with the segment's number."""
    return F.array(*[_segment(fp, lo, width).bitwiseOR(F.lit(k << _SEGMENT)) for k, (lo, width) in enumerate(cut.segments)])


def variant_keys(value: Column, cut: Cut) -> Column:
    """The index keys of a segment's value: number of the bit taken out (from bit 56 of the key), then what is left."""
    def keys(width: int) -> Column:
        return F.array(*[value.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit(i << 56)) for i in range(width)])

    out = keys(cut.segments[0][1])
    for k, (_, width) in enumerate(cut.segments[1:], 1):
        if width != cut.segments[0][1]:
            out = F.when(F.shiftright(value, _SEGMENT) == k, keys(width)).otherwise(out)
    return out


def link_groups(fps: DataFrame, cut: Cut) -> DataFrame:
    """``(fp.., group)`` for every distinct fingerprint; fingerprints linked directly or in a chain share a group.

    ``fps`` has the columns ``fp`` (and ``fp_1``); a fingerprint of two words is known by a 64-bit hash of them. Two
    are compared if a segment of theirs has the same value, or values that share a key: just two values can, the
    one with the bit and the one without it (twins).
    """
    names = _names(cut.words)
    col = lambda prefix: [F.col(n) for n in _names(cut.words, prefix)]
    named = lambda prefix: [F.col(n).alias(m) for n, m in zip(names, _names(cut.words, prefix))]
    near = differing(col("x"), col("y")) <= cut.bits
    width = shuffle_width(fps.sparkSession)
    # small rows that grow into a key for each bit: kept in as many parts as the keys need
    nodes = fps.select(*names).where("fp is not null").distinct().repartition(width, *names)
    nodes = cut_lineage(nodes.withColumn("id", F.xxhash64(*names) if cut.words > 1 else F.col("fp")))
    # few fingerprints need few tasks, and there are many stages
    slices = max(LEAST_SLICES, -(-nodes.count() // SLICE_NODES))
    nodes = nodes.coalesce(slices)

    def spelled(rows: DataFrame, of: str, prefix: str) -> DataFrame:
        """``rows`` with the words of the fingerprint whose id is in column ``of``."""
        if cut.words == 1:
            return rows.withColumn(prefix, F.col(of))
        words = nodes.select(F.col("id").alias("__id"), *named(prefix))
        return rows.join(words, F.col(of) == F.col("__id")).drop("__id")

    def renamed(rows: DataFrame, groups: DataFrame) -> DataFrame:
        new = groups.select(F.col("node").alias("__c"), F.col("component").alias("__new"))
        return rows.join(new, F.col("c") == F.col("__c"), "left").withColumn("c", F.coalesce("__new", "c")).drop("__c", "__new")

    # per value: its smallest and largest fingerprint, how many it has, and the bits that all or any of them have
    rows = nodes.select("id", *names, F.explode(segment_values(col("fp"), cut)).alias("v"))
    every, some = _names(cut.words, "every"), _names(cut.words, "some")
    bits = [x for n, e, o in zip(names, every, some) for x in (F.bit_and(n).alias(e), F.bit_or(n).alias(o))]
    values = rows.groupBy("v").agg(F.min("id").alias("p"), F.max("id").alias("q"), F.count(F.lit(1)).alias("n"), *bits)
    values = cut_lineage(values.repartition(width, "v"))
    keys = values.coalesce(slices).select("p", "n", *every, *some, F.explode(variant_keys(F.col("v"), cut)).alias("key"))
    # any two fingerprints of twins differ where one side has a bit throughout and the other nowhere
    bits = [x for e, o in zip(every, some) for x in (F.bit_or(e).alias(e), F.bit_and(o).alias(o))]
    apart = sum((F.bit_count(F.col(e).bitwiseAND(F.bitwise_not(F.col(o)))) for e, o in zip(every, some)), F.lit(0))
    found = cut_lineage(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("twins"), F.sum("n").alias("n"), F.min("p").alias("p"), F.max("p").alias("q"), *bits)
        .where("twins = 2").where(apart <= cut.bits).select("key", "n", "p", "q").coalesce(slices)
    )
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 56) as int))")
    without_bit = F.col("key").bitwiseAND(F.lit((1 << 56) - 1))
    # twins of one fingerprint each are done with that
    twins = found.where("n > 2").select(without_bit.alias("v"), without_bit.bitwiseOR(bit).alias("w"))

    # first links: every fingerprint with the smallest of its value, and the smallest ones of twins
    within = sum((F.bit_count(F.col(o).bitwiseAND(F.bitwise_not(F.col(e)))) for e, o in zip(every, some)), F.lit(0))
    couples = values.where("n = 2").where(within <= cut.bits).select("p", "q")
    star = rows.select("id", "v").join(values.where("n > 2").select("v", "p"), "v").where("id <> p").select("p", F.col("id").alias("q"))
    heads = found.where("p <> q").select("p", "q")
    pairs = spelled(spelled(couples.unionByName(star).unionByName(heads).distinct(), "p", "x"), "q", "y")
    first = components(pairs.where(near).select(F.col("p").alias("a"), F.col("q").alias("b")))
    grouped = cut_lineage(renamed(nodes.withColumn("c", F.col("id")), first).coalesce(slices))

    # what is left: fingerprints outside the largest group of their value are met by all that are alike
    rows = grouped.select("c", *names, F.explode(segment_values(col("fp"), cut)).alias("v"))
    main = cut_lineage(
        rows.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("v").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum("n").alias("n"))
        .coalesce(slices)
    )
    # values and twins of a single group have nothing to tell
    open_twins = twins.join(main, "v").join(main.toDF("w", "main_w", "low_w", "high_w", "n_w"), "w").where("least(low, low_w) < greatest(high, high_w)")
    open_twins = cut_lineage(open_twins.select("v", "w", (F.col("main") == F.col("main_w")).alias("alike")).coalesce(slices))
    of_value = main.select("v", "main", F.expr("low < high and n > 2").alias("mixed"))  # two have been compared
    ends = open_twins.select("v").unionByName(open_twins.select(F.col("w").alias("v"))).distinct().withColumn("twin", F.lit(True))
    members = rows.join(of_value.join(ends, "v", "left").where("mixed or twin"), "v")
    left = members.select("v", "mixed", F.col("c").alias("a"), F.col("main").alias("ma"), *named("x"))
    right = members.select(F.col("v").alias("w"), F.col("c").alias("b"), F.col("main").alias("mb"), *named("y"))
    linked = (F.col("a") != F.col("b")) & near
    same = left.where("mixed and a <> ma").join(right, (F.col("v") == F.col("w")) & linked).select("a", "b")
    sent = left.join(open_twins, "v").drop("v")  # each fingerprint to the twins of its value
    all_others = sent.where("not alike or a <> ma").join(right, "w").where(linked).select("a", "b")
    outsiders = sent.where("alike and a = ma").join(right.where("b <> mb"), "w").where(linked).select("a", "b")
    second = components(same.unionByName(all_others).unionByName(outsiders).distinct())
    return renamed(grouped, second).select(*names, F.col("c").alias("group"))


def link_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, cut: Cut | None = None, seed: int = 42) -> DataFrame:
    """``(doc_id, fp.., component_id)``, a row per row of ``df``.

    ``component_id`` is the smallest ``doc_id`` among the documents reachable over links (null when the
    whole component has no id). Rows with a null id take part like others; repeated rows are linked by
    their equal fingerprints. An empty table gives an empty result.
    """
    cut = cut or exact_cut()
    names = _names(cut.words)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = cut_lineage(fingerprints(rows, "text", "fp", shingle, seed, cut.words).select("doc_id", *names))
    groups = link_groups(marked, cut)
    low = cut_lineage(marked.groupBy(*names).agg(F.min("doc_id").alias("low")).join(groups, names))
    ids = low.groupBy("group").agg(F.min("low").alias("component_id"))
    return marked.join(low.select(*names, "group").join(ids, "group").select(*names, "component_id"), names, "left")


@shielded
def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, cut: Cut | None = None, seed: int = 42) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the document with the smallest id stays.

    Rows that repeat an id stay once (the one with the smallest text). Rows of components without any id stay once
    for each such component.
    """
    cut = cut or exact_cut()
    linked = cut_lineage(link_documents(df, doc_id, text, shingle, cut, seed))
    kept = linked.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = df.join(kept, F.col(doc_id) == F.col("__id"), "left_semi")
    # ids are co-located by the join; a rank of one is limited before and after the shuffle
    one = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last())
    named = rows.withColumn("__rank", F.row_number().over(one)).where("__rank = 1").drop("__rank")
    lost = linked.where("component_id is null")
    if lost.isEmpty():
        return named
    # components in which no document has an id
    marks = [f"__{n}" for n in _names(cut.words)]
    idless = fingerprints(df.where(F.col(doc_id).isNull()), text, "__fp", shingle, seed, cut.words)
    groups = link_groups(lost, cut).toDF(*marks, "__group")
    first = Window.partitionBy("__group").orderBy(F.col(text).asc_nulls_last())
    rest = idless.join(groups, marks).withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return named.unionByName(without(rest, *marks, "__group", "__rank"))


def keep_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, cut: Cut | None = None, seed: int = 42) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the smallest id stays, then by the text's hash.

    Unlike :func:`keep_one`, rows that share an id are told apart by their contents, see :func:`survivors.first_of_groups`.
    """
    cut = cut or exact_cut()
    names = _names(cut.words)
    texts = fingerprints(df.select(F.col(f"`{text}`").alias("text")), "text", "fp", shingle, seed, cut.words)
    texts = cut_lineage(texts.select(F.xxhash64("text").alias("tx"), *names))
    groups = texts.distinct().join(link_groups(texts, cut), names).select("tx", "group")
    return first_of_groups(df, groups, doc_id, text)
