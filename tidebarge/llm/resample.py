"""Importance resampling towards a target text collection.

Words and runs of words are hashed into a fixed number of buckets. A bucket's gain is how much more frequent it is in
the target than in the corpus (a log ratio in thousandths), a document's weight the mean gain of its features. Gumbel
noise from the id turns "draw with probability in proportion to exp(weight)" into "take the highest scores".

1. *Array-scored weights.* One pass counts buckets: a task sends one array of counts, whatever it read. The gains are
   one array of the size of the buckets, a second pass looks a document's features up in it.
2. *Threshold bisection.* The scores are fixed by a checkpoint. Jobs that count how many rows lie above some
   thresholds narrow the cutoff down to one score, then, among the rows of that score, to one id. Nothing is sorted
   or collected for it; a job sends ``2 ** HALVINGS`` counts at most to the driver.
3. *Ranks.* Only the drawn rows are range-partitioned and numbered.

Defined results: a null text is empty, an empty one has no feature and weight 0. Rows without an id share the noise of
the empty id and come after all others of their score; rows that share id and score are ordered by their feature
count, weight and place in the input. Repeated rows are rows of their own. Extra columns of any name are not looked at
(:func:`scored`) or kept (:func:`resample`). Texts of any length are read in chunks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_position
from .base import bounded_batches, cut_lineage, free_name

BUCKETS = 10_000
#: A job of the bisection halves the range so often at once.
HALVINGS = 4
#: Bytes of a text that are cut into words at a time; a longer word is taken whole.
CHUNK = 1 << 20

#: Byte by byte: A to Z in lower case; 0 to 9, a to z and all bytes of characters beyond ASCII as they are; blanks for the rest.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = at + CHUNK
        end = len(text) if end >= len(text) or (cut := text.find(b" ", end)) < 0 else cut
        yield text[at:end].split()
        at = end


def features(text: bytes | None, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text's runs of 1 to ``longest`` words, how often each occurs, and the number of words.

    A bucket may stand in the result more than once.
    """
    counts: Counter[bytes] = Counter()
    n, tail = 0, []
    for words in _words(text or b""):
        n += len(words)
        counts.update(words)
        if longest > 1:
            words = tail + words
            for k in range(2, longest + 1):
                # a run that ends in the words already seen has been counted
                first = max(0, len(tail) - k + 1)
                counts.update(b" ".join(words[i : i + k]) for i in range(first, len(words) - k + 1))
            tail = words[-(longest - 1) :]
    places = np.fromiter((zlib.crc32(w) % buckets for w in counts), dtype=np.int64, count=len(counts))
    return places, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), n


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts: ``buckets`` numbers, added up in the tasks first."""
    bounded_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                places, n, _ = features(t.as_py(), longest, buckets)
                np.add.at(total, places, n)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket
    out = np.zeros(buckets, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed bucket frequencies, target over corpus, in floored thousandths."""
    s_all, t_all, m = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist())],
        dtype=np.int64,
    )


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in floored thousandths, fixed by the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(
    df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
    buckets: int = BUCKETS, seed: int = 2024,
) -> DataFrame:
    """``df`` with ``n_features``, ``n_words``, ``weight`` and ``score`` (all long); input columns of these names are replaced."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets)))

    @F.arrow_udf("struct<n_features:bigint,n_words:bigint,weight:bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = table.value
        for batch in batches:
            sizes, words, weights = [], [], []
            for t in batch.cast(pa.binary()):
                places, n, w = features(t.as_py(), longest, buckets)
                size = int(n.sum())
                sizes.append(size)
                words.append(w)
                weights.append(int(gain[places] @ n) // size if size else 0)
            yield pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (sizes, words, weights)], names=["n_features", "n_words", "weight"]
            )

    made = {"n_features", "n_words", "weight", "score"}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    w, key = free_name(df, "w"), free_name(df, "key")
    out = df.select(*keep, weigh(F.col(f"`{text}`").cast("string")).alias(w), F.col(f"`{doc_id}`").alias(key))
    return out.select(
        *keep, f"{w}.n_features", f"{w}.n_words", f"{w}.weight", (F.col(f"{w}.weight") + noise(F.col(key), seed)).alias("score")
    )


def _cutoff(rows: DataFrame, value: str, need: int, halvings: int = HALVINGS) -> tuple[int | None, int]:
    """The largest ``v`` with ``need`` or more values not below it, and how many lie above it; None when there are too few.

    Values are whole numbers. Every job counts the rows not below evenly spaced thresholds.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < need:
        return None, n
    above = 0  # rows over ``high``
    while low < high:
        steps = sorted({low + (high - low + 1) * i // (1 << halvings) for i in range(1, 1 << halvings)} - {low})
        steps = steps or [high]
        counts = rows.agg(*[F.count_if(F.col(value) >= F.lit(s)).alias(f"c{i}") for i, s in enumerate(steps)]).first()
        enough = [s for s, c in zip(steps, counts) if c >= need]
        short = [(s, c) for s, c in zip(steps, counts) if c < need]
        low = max(enough, default=low)
        if short:
            high, above = short[0][0] - 1, short[0][1]
    return low, above


def draw(df: DataFrame, share: tuple[int, int], doc_id: str = "doc_id", least_words: int = 20, rank: str = "rank") -> DataFrame:
    """Add ``rank``: 1, 2, 3... for the highest scores, null for rows not drawn.

    Of the N rows with ``least_words`` words or more floor(N * share) are drawn; ``share`` is (numerator, denominator).
    ``df`` comes from :func:`scored`. Ties go to the smaller id.
    """
    place, key = free_name(df, "at"), free_name(df, "key")
    fixed = df.withColumn(key, F.col(f"`{doc_id}`").cast("long")).withColumn(place, F.monotonically_increasing_id())
    fixed = cut_lineage(fixed)
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    narrow = fixed.where(able).select("score", key)
    need = narrow.count() * share[0] // share[1]
    names = [F.col(f"`{c}`") for c in df.columns if c.lower() != rank.lower()]
    undrawn = F.lit(None).cast("long").alias(rank)
    if not need:
        return fixed.select(*names, undrawn)
    score, above = _cutoff(narrow, "score", need)
    # ties: ids count downwards, so the smaller id is the higher value; rows without an id are the last resort
    tied = narrow.where(F.col("score") == score).select((F.lit(-1) - F.col(key)).alias("v"))
    last, _ = _cutoff(tied, "v", need - above)
    tie = F.lit(True) if last is None else F.coalesce(F.lit(-1) - F.col(key) >= F.lit(last), F.lit(False))
    taken = able & ((F.col("score") > score) | (F.col("score") == score) & tie)
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col(place)]
    # rows that share score and id with the last one drawn are numbered beyond ``need``
    at = free_name(df, "position")
    ranked = with_position(fixed.where(taken), order, at).select(*names, F.when(F.col(at) <= need, F.col(at)).cast("long").alias(rank))
    return ranked.unionByName(fixed.where(~taken).select(*names, undrawn))


def resample(df: DataFrame, target: DataFrame, share: tuple[int, int], doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``df`` only, all their columns and ``rank``."""
    drawn = draw(scored(df, target, doc_id, **options), share, doc_id)
    return drawn.where("rank is not null").select(*[F.col(f"`{c}`") for c in df.columns], *([] if "rank" in df.columns else ["rank"]))
