"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space, so sketches of documents
of any length can be merged and compared: containment and likeness are estimated on the hashes both would
have kept. A document with few hashes below the threshold keeps its smallest ``FLOOR`` hashes, that is, its
threshold is raised just as far as it takes; one with ``FLOOR`` shingles or fewer keeps all of them and is
compared exactly. Shingles are runs of ``WIDTH`` code points (a shorter text: the whole text; an empty one: none).

As text a sketch is its threshold and its hashes in ascending order, 16 hex digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, shuffle_width, without

WIDTH = 8
#: Fraction of the hash space that is kept, and hashes that are kept at least.
FRACTION, FLOOR = 1 / 32, 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LIMIT = np.uint64(int(FRACTION * 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(points: np.ndarray) -> np.ndarray:
    """Hash of every shingle of ``points`` (uint64 code points)."""
    n = len(points)
    if n == 0:
        return points
    w = min(WIDTH, n)
    h = np.zeros(n - w + 1, dtype=np.uint64)
    for i in range(w):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[i : n - w + 1 + i]
    return _mixed(h + np.uint64(w))


def _smallest(h: np.ndarray) -> np.ndarray:
    """The smallest ``FLOOR + 1`` distinct hashes, ascending."""
    if len(h) > 8 * FLOOR:
        few = np.unique(np.partition(h, 4 * FLOOR)[: 4 * FLOOR])
        if len(few) > FLOOR:
            return few[: FLOOR + 1]
    return np.unique(h)[: FLOOR + 1]


def sketch(text: str) -> tuple[np.uint64, np.ndarray]:
    """Threshold and ascending distinct hashes up to it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low, few, seen = [], np.empty(0, dtype=np.uint64), 0
    for lo in range(0, max(1, len(points) - WIDTH + 1), 1 << 18):  # shingles of a block of the text at a time
        h = _hashes(points[lo : lo + (1 << 18) + WIDTH - 1].astype(np.uint64))
        seen += len(h)
        kept = np.unique(h[h <= _LIMIT])
        low.append(kept)
        if len(kept) < FLOOR:
            few = np.unique(np.concatenate((few, _smallest(h))))[: FLOOR + 1]
    low = np.unique(np.concatenate(low))
    if len(low) >= FLOOR:
        return _LIMIT, low
    if len(few) <= FLOOR:
        return _FULL, few  # all there are
    return few[FLOOR - 1], few[:FLOOR]


def likeness(a: tuple[np.uint64, np.ndarray], b: tuple[np.uint64, np.ndarray]) -> float:
    """Estimate of shared shingles over all shingles of both; two empty sketches are alike."""
    limit = min(a[0], b[0])
    x, y = a[1][a[1] <= limit], b[1][b[1] <= limit]
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else float(len(a[1]) == len(b[1]))


def containment(a: tuple[np.uint64, np.ndarray], b: tuple[np.uint64, np.ndarray]) -> float:
    """Estimate of the share of the shingles of ``a`` that ``b`` has; an empty ``a`` is contained."""
    limit = min(a[0], b[0])
    x, y = a[1][a[1] <= limit], b[1][b[1] <= limit]
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 1.0


def merge(a: tuple[np.uint64, np.ndarray], b: tuple[np.uint64, np.ndarray]) -> tuple[np.uint64, np.ndarray]:
    """Sketch of both documents' shingles together."""
    limit = min(a[0], b[0])
    h = np.union1d(a[1], b[1])
    return limit, h[h <= limit]


def to_text(s: tuple[np.uint64, np.ndarray]) -> str:
    return np.concatenate(([s[0]], s[1])).astype(">u8").tobytes().hex()


def from_text(text: str) -> tuple[np.uint64, np.ndarray]:
    h = np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)
    return h[0], h[1:]


def sketches(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the sketch of ``text`` as text. Null counts as empty; equal texts have equal sketches."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([to_text(sketch(t or "")) for t in batch.to_pylist()])

    return without(df, out).withColumn(out, run(F.col(text)))


# --- every document, its edited text and its neighbour -------------------------------------------------------


def _splits(ids: DataFrame, parts: int) -> tuple[int | None, list[int]]:
    """Smallest id, and ids that cut the table into about ``parts`` slices (from a sample of some 200 ids a slice)."""
    first, n = ids.agg(F.min("doc_id"), F.count("doc_id")).first()
    if first is None or parts < 2:
        return first, []
    share = min(1.0, 200.0 * parts / n)
    picked = sorted({r[0] for r in ids.where("doc_id is not null").sample(share, 7).collect()} - {first})
    return first, sorted({picked[len(picked) * i // parts] for i in range(1, parts)}) if picked else []


def _slices(splits: list[int], first: int | None):
    """Give each row its slice; the row a slice begins with also goes to the slice before, as its end.

    The smallest id also ends the last slice (after the last document comes the first). Rows without an id come last.
    """
    cuts = np.array(splits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            lost = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.where(lost, len(cuts), np.searchsorted(cuts, value, side="right"))
            begins = ~lost & (at > 0) & (value == cuts[np.maximum(at, 1) - 1]) if len(cuts) else np.zeros(len(value), dtype=bool)
            opens = ~lost & (value == first) if first is not None else lost
            rows = np.concatenate((np.arange(len(value)), np.flatnonzero(begins), np.flatnonzero(opens)))
            slices = np.concatenate((at, at[begins] - 1, np.full(opens.sum(), len(cuts))))
            end = np.r_[np.zeros(len(value), dtype=np.int32), np.ones(len(rows) - len(value), dtype=np.int32)]
            for lo in range(0, len(rows), 2000):
                part = batch.take(pa.array(rows[lo : lo + 2000]))
                yield pa.record_batch(
                    [pa.array(slices[lo : lo + 2000], pa.int32()), pa.array(end[lo : lo + 2000], pa.int32()), part.column("doc_id"), part.column("text")],
                    names=["slice", "end", "doc_id", "text"],
                )

    return run


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the next of its slice; only the row before is held."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    nothing = (None, "", sketch(""))
    here, last = None, None  # the slice, and its row still without a next one: id, text, sketch
    for batch in batches:
        out: list[tuple] = []
        for at, end, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != here:
                if last:  # a slice always has an end, unless there is no document to follow
                    out.append(_row(last, nothing))
                here, last = at, None
            elif not last:
                continue  # further rows equal in id to the end of the slice
            if end and not last:
                continue
            now = (doc_id, text, sketch(text))
            if last:
                out.append(_row(last, now))
            last = None if end else now
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_schema())
    if last:
        yield pa.RecordBatch.from_pylist([dict(zip(names, _row(last, nothing)))], schema=_schema())


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _RESULT.split(", ")])


def _row(this: tuple, following: tuple) -> tuple:
    doc_id, text, own = this
    n = len(text)
    edited = text[: n - n // 4] + following[1][: n // 4]
    s = sketch(edited)
    return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(s), likeness(own, s), likeness(own, following[2]))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its edited text and its next document, in ascending id.

    The edited text has the last floor(n / 4) code points replaced by the first as many (or all) of the next
    document; after the last comes the first. Null texts are empty. Rows that share an id follow one another by
    their text; rows without an id come after all others. The texts are shuffled once, into slices of the id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    width = shuffle_width(spark)
    # several slices a partition even out what the hash of a slice deals unevenly
    first, splits = _splits(docs.select(F.col(doc_id).cast("long").alias("doc_id")), 4 * width)
    if first is None:  # no ids: order by text, and the smallest text follows the last
        rows = rows.withColumn("doc_id", F.lit(None).cast("long"))
    sliced = rows.mapInArrow(_slices(splits, first), "slice int, end int, doc_id long, text string")
    placed = sliced.repartition(width, "slice").sortWithinPartitions("slice", F.col("end"), F.col("doc_id").asc_nulls_last(), "text")
    return placed.mapInArrow(_pairs, _RESULT)
