"""Quality classifier by co-training on two views of a document.

One view sees the text (hashed byte trigrams), the other the page's metadata (language, source, lengths,
lines, shares of letters, capitals, digits and marks, repetition of words and lines). A logistic model is
fitted on each from labelled documents; in every round each model labels the documents it is most sure of
in a pool of unlabelled ones, and the other model learns from them. Scores are calibrated (Platt) on
labelled documents held out of the fit and the two log odds are added with weights fitted there too.

What is fitted is bounded by parameters: ``labelled`` labelled documents and ``pool`` unlabelled ones,
chosen by a hash of the id, so their features (a few MB) fit the driver. Scoring is one pass over all
documents without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, put, shielded

#: Slots of the hashed trigrams, of each hashed name in the metadata, and the other metadata values.
TRIGRAMS, NAMES, VALUES = 1024, 32, 14
#: Probability below which a document is rejected. Classes weigh the same in the fit; doubtful texts stay.
REJECT = 0.3


def accepted(score: Column) -> Column:
    """Not rejected; a document without a score stays."""
    return F.coalesce(score >= REJECT, F.lit(True))


def text_view(raw: bytes) -> np.ndarray:
    """Log counts of byte trigrams, of a length that grows with the text's up to 1: short texts tell little."""
    b = np.frombuffer(raw, dtype=np.uint8)
    out = np.zeros(TRIGRAMS, dtype=np.float32)
    if len(b) < 3:
        return out
    for lo in range(0, len(b) - 2, 1 << 20):
        part = b[lo : lo + (1 << 20) + 2].astype(np.uint32)
        h = (part[:-2] * 65536 + part[1:-1] * 256 + part[2:]) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(22), minlength=TRIGRAMS)
    out = np.log1p(out)
    return out * (min(1.0, len(b) / 400) / np.linalg.norm(out))


def _slot(name: str | None) -> int:
    return zlib.crc32((name or "").encode()) % NAMES


def meta_view(raw: bytes, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(VALUES + 2 * NAMES, dtype=np.float32)
    out[VALUES + _slot(lang)] = 1
    out[VALUES + NAMES + _slot(source)] = 0.2
    n = len(raw)
    if not n:
        return out
    b = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(b, minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w, k = max(len(words), 1), len(lines)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    comma_dot = counts[[44, 46]].sum()
    out[:VALUES] = (
        np.log1p(n) / 10, np.log1p(w) / 10, np.log1p(k) / 5, np.log1p(n / k) / 10, n / w / 10,
        letters / n, counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / n, (marks - comma_dot) / w,
        comma_dot / w, len(set(words)) / w, len(set(words)) / w**0.7, len(set(lines)) / k, 1,
    )
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Coefficients, the intercept last, by accelerated gradient steps (no randomness)."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    share = weight / weight.sum()
    rate = 1.0 / (0.25 * float(np.max(np.sum(x * x, axis=1))) + l2)
    coef = ahead = np.zeros(x.shape[1])
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        grad = x.T @ (share * (p - y)) + l2 * np.r_[ahead[:-1], 0]
        new = ahead - rate * grad
        ahead, coef = new + i / (i + 3) * (new - coef), new
    return coef


def _odds(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return x @ coef[:-1] + coef[-1]


@dataclass(frozen=True)
class Model:
    """Coefficients of both views, and the weights of their log odds with the intercept last."""

    text: np.ndarray
    meta: np.ndarray
    mix: np.ndarray

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both together."""
        a, b = _odds(text, self.text) * self.mix[0], _odds(meta, self.meta) * self.mix[1]
        return np.stack([a + self.mix[2] / 2, b + self.mix[2] / 2, a + b + self.mix[2]], axis=1)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, free_text: np.ndarray, free_meta: np.ndarray, rounds: int = 4, share: float = 0.05) -> Model:
    """Fit on labelled rows (``y`` 0 or 1) and unlabelled rows of both views.

    Every fourth labelled row is held out for calibration. In a round each view hands over the ``share`` of
    the pool it is most sure of, split between the classes as the labelled rows are.
    """
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    fit_rows, check = ~held, held if held.any() else ~held
    # a rare class weighs as much as the other
    def balance(v: np.ndarray) -> np.ndarray:
        return np.where(v == 1, 0.5 / max(v.mean(), 1e-9), 0.5 / max(1 - v.mean(), 1e-9))

    views, pools = (text, meta), (free_text, free_meta)
    given = [(np.empty(0, dtype=int), np.empty(0)) for _ in views]  # pool rows and labels handed to each view
    coefs: list[np.ndarray] = []
    for _ in range(rounds + 1):
        coefs = []
        for view, pool, (rows, labels) in zip(views, pools, given):
            x, z = np.vstack([view[fit_rows], pool[rows]]), np.r_[y[fit_rows], labels]
            trust = np.r_[np.ones(fit_rows.sum()), np.full(len(rows), 0.5)]
            coefs.append(fit_logistic(x, z, balance(z) * trust))
        if not len(free_text):
            break
        n = max(1, int(share * len(free_text)))
        for k in (0, 1):
            odds = _odds(pools[k], coefs[k])
            order = np.argsort(odds, kind="stable")
            low = [i for i in order[: max(1, round(n * (1 - y.mean())))] if odds[i] < 0]
            high = [i for i in order[::-1][: max(1, round(n * y.mean()))] if odds[i] > 0]
            rows = np.array(low + high, dtype=int)
            labels = np.r_[np.zeros(len(low)), np.ones(len(high))]
            seen = ~np.isin(rows, given[1 - k][0])
            given[1 - k] = (np.r_[given[1 - k][0], rows[seen]], np.r_[given[1 - k][1], labels[seen]])
    both = np.stack([_odds(text[check], coefs[0]), _odds(meta[check], coefs[1])], axis=1)
    scale = np.abs(both).mean(0) + 1e-9
    mix = fit_logistic(both / scale, y[check], balance(y[check]), l2=1e-2)
    return Model(coefs[0].astype(np.float32), coefs[1].astype(np.float32), np.r_[np.maximum(mix[:2], 0) / scale, mix[2]])


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
    text = np.stack([text_view(r) for r in raw]) if raw else np.zeros((0, TRIGRAMS), dtype=np.float32)
    names = zip(raw, batch.column("lang").to_pylist(), batch.column("source").to_pylist())
    meta = np.stack([meta_view(r, a, b) for r, a, b in names]) if raw else np.zeros((0, VALUES + 2 * NAMES), dtype=np.float32)
    return text, meta


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _gather(docs: DataFrame, wanted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and labels of the wanted documents (a bounded list), in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _views(batch)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("y"), pa.array([t.tobytes() for t in text], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())],
                names=["doc_id", "y", "t", "m"],
            )

    rows = (
        _inputs(docs).join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])  # both tables may repeat an id
        .mapInArrow(run, "doc_id long, y int, t binary, m binary").toArrow().sort_by("doc_id")
    )
    get = lambda name: np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=np.float32).reshape(rows.num_rows, -1)
    return get("t"), get("m"), np.array([-1 if v is None else v for v in rows.column("y").to_pylist()])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = 4000, pool: int = 2000, rounds: int = 4) -> Model | None:
    """Fit on at most ``labelled`` labelled and ``pool`` unlabelled documents, taken by the hash of their ids.

    Rows without id or label are left out; an id with several labels counts as the smallest. Fewer than two
    classes: no model.
    """
    bounded_batches(docs.sparkSession)
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    # each class gets half, so that a rare one is not missed
    known = marks.join(ids, "doc_id", "left_semi")
    some = [known.where(F.col("y") == v).orderBy(order, "doc_id").limit(labelled // 2) for v in (0, 1)]
    free = ids.join(marks, "doc_id", "left_anti").orderBy(order, "doc_id").limit(pool).select("doc_id", F.lit(None).cast("int").alias("y"))
    wanted = [r for part in (*some, free) for r in part.collect()]  # bounded by labelled + pool
    if not wanted:
        return None
    text, meta, y = _gather(docs, docs.sparkSession.createDataFrame(wanted, "doc_id long, y int"))
    have = y >= 0
    if len(np.unique(y[have])) < 2:
        return None
    return co_train(text[have], meta[have], y[have].astype(float), text[~have], meta[~have], rounds)


@shielded
def score(docs: DataFrame, model: Model | None, out: str = "quality_score", views: bool = False) -> DataFrame:
    """Add the probability of good quality; with ``views`` also ``text_score`` and ``meta_score``.

    Without a model every score is null. A null text is scored as an empty one.
    """
    names = [out, "text_score", "meta_score"] if views else [out]
    if model is None:
        return put(docs, **{n: F.lit(None).cast("double") for n in names})
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<text:double,meta:double,both:double>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, lang, source in batches:
            odds = model.odds(*_views(pa.record_batch([text, lang, source], names=["text", "lang", "source"])))
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.StructArray.from_arrays([pa.array(p[:, i].astype(float)) for i in range(3)], names=["text", "meta", "both"])

    scored = put(docs, __p=run(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string")))
    parts = {out: F.col("__p.both"), "text_score": F.col("__p.text"), "meta_score": F.col("__p.meta")}
    return put(scored, **{n: parts[n] for n in names}).drop("__p")
