"""Embedding near-dedup: spherical k-means cells and blocked cosines inside them.

Centres are fitted on a bounded sample; every vector is then assigned. A pair with cosine >= ``least`` lies
within a chord d of each other, so if two such vectors have different home cells, one of them is within d / 2
of the plane that halves the two centres. Each vector therefore also goes, as a guest, to every cell whose
plane is that near, and no pair is missed. A cell compares its home rows with its home and guest rows by
matrix products of bounded blocks, spread over tasks, so a cell with a third of all vectors is no single
group. A block gives the number of links of each of its vectors and the smallest vector it reaches over links
of the block (a spanning star of each component of the block), never the pairs; these are contracted to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, cut_lineage, shielded
from .graph import components

#: Vectors the centres are fitted on, and most centres.
SAMPLE, CENTRES = 20_000, 1024
#: Rows of a block on either side.
BLOCK = 2048


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """``k`` unit centres at most for unit rows ``x``; starts from rows at even steps, empty cells go."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    centres = np.unique(centres, axis=0)
    for _ in range(steps):
        home = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        sizes = np.linalg.norm(sums, axis=1)
        centres = sums[sizes > 1e-9] / sizes[sizes > 1e-9][:, None]
    return centres


def centres_for(n: int) -> int:
    """Centres for ``n`` vectors: half the square root, so that cells and the guests of a vector both grow slowly."""
    return min(CENTRES, max(1, round(math.sqrt(n) / 2)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-length lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, v, dim)`` for the vectors that can link: not null, not zero, all components finite."""
    v = F.col(embedding).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))
    return rows.where(F.exists("v", lambda x: x != 0))


def _assign(rows: DataFrame, centres: dict[int, np.ndarray], near: float) -> DataFrame:
    """``(dim, cell, vec_id, v, home, visits)``: a row at home and one in each cell visited; ``visits`` are those cells.

    A dimension without centres has one cell.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES per dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
                x = unit_rows(x / np.abs(x).max(axis=1, keepdims=True))
                c = sent.value.get(int(dim))
                if c is None:
                    homes, close = np.zeros(len(x), dtype=int), np.zeros((len(x), 1), dtype=bool)
                else:
                    dots = x @ c.T
                    homes = np.argmax(dots, axis=1)
                    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))[homes]
                    close = (dots[np.arange(len(x)), homes][:, None] - dots) <= near * gap + 1e-9
                    close[np.arange(len(x)), homes] = False
                who, where = np.nonzero(close)
                visits = [np.flatnonzero(r).tolist() for r in close]
                rows_ = np.concatenate((np.arange(len(x)), who))
                for lo in range(0, len(rows_), 4096):
                    r = rows_[lo : lo + 4096]
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(r), dim), pa.int32()), pa.array(np.concatenate((homes, where))[lo : lo + 4096], pa.int32()),
                            pa.array(ids[r], pa.int64()), pa.array([v.tobytes() for v in x[r]], pa.binary()),
                            pa.array(homes[r], pa.int32()), pa.array([visits[i] for i in r], pa.list_(pa.int32())),
                        ],
                        names=["dim", "cell", "vec_id", "v", "home", "visits"],
                    )

    return rows.mapInArrow(run, "dim int, cell int, vec_id long, v binary, home int, visits array<int>")


def lowest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0 to ``n`` - 1 reaches over the edges ``a``-``b``; all edges count."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))  # roots hang under smaller ones
        while not np.array_equal(up := root[root], root):
            root = up


def _compare(least: float):
    """Compare the home rows of a block with the rows they meet; counts of links and smallest vector reached in the block."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[1])
        own, met = part[part.side == 0], part[part.side == 1]
        out = {"vec_id": [], "n": [], "low": []}
        if len(own) and len(met):
            a = np.frombuffer(b"".join(own.v), dtype=np.float64).reshape(len(own), -1)
            b = np.frombuffer(b"".join(met.v), dtype=np.float64).reshape(len(met), -1)
            a_id, b_id, b_home = own.vec_id.to_numpy(), met.vec_id.to_numpy(), met.home.to_numpy()
            linked = a @ b.T >= least
            linked &= a_id[:, None] != b_id[None, :]
            x, y = np.nonzero(linked)
            if len(x):
                # a pair whose both members visit each other's cell counts in the lower cell only
                visits = [set(v) for v in own.visits.iloc[np.unique(x)]]
                at = np.searchsorted(np.unique(x), x)
                guest = b_home[y] != cell
                twice = np.zeros(len(x), dtype=bool)
                for i in np.flatnonzero(guest & (b_home[y] < cell)):
                    twice[i] = b_home[y[i]] in visits[at[i]]
                nodes, at = np.unique(np.concatenate((a_id, b_id)), return_inverse=True)
                at_a, at_b = at[: len(a_id)].astype(np.int32), at[len(a_id) :].astype(np.int32)
                reached = nodes[lowest_reached(len(nodes), at_a[x], at_b[y])]
                n_a = np.bincount(x[~twice], minlength=len(a_id))
                n_b = np.bincount(y[guest & ~twice], minlength=len(b_id))
                for ids, n, low, hit in ((a_id, n_a, reached[at_a], np.unique(x)), (b_id, n_b, reached[at_b], np.unique(y))):
                    out["vec_id"].append(ids[hit])
                    out["n"].append(n[hit])
                    out["low"].append(low[hit])
        return pd.DataFrame({k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in out.items()})

    return run


def links(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for the vectors with a link.

    ``n_links`` is the number of other vectors with cosine >= ``least``, ``component_id`` the smallest id reachable.
    Vectors of different lengths do not link. Rows that repeat an id with the same vector count once; an id with
    several vectors counts the links of all of them.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = cut_lineage(valid_vectors(df, vec_id, embedding).distinct())
    near = math.sqrt(max(2 - 2 * least, 0.0)) / 2
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(16).collect()}
    centres = {}
    for dim, n in counts.items():
        if centres_for(n) > 1:
            picked = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
            x = _matrix(picked.column("v").combine_chunks())
            centres[dim] = spherical_kmeans(unit_rows(x / np.abs(x).max(axis=1, keepdims=True)), centres_for(n))
    placed = cut_lineage(_assign(rows, centres, near))
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("cell") == F.col("home")).cast("long")).alias("own"))
    blocks = cut_lineage(sizes.select("dim", "cell", F.ceil(F.col("own") / BLOCK).cast("int").alias("a"), F.ceil(F.col("all") / BLOCK).cast("int").alias("b")))
    wide = placed.join(blocks, ["dim", "cell"])
    h = F.xxhash64("vec_id")
    home = wide.where("cell = home").select(
        "dim", "cell", F.pmod(h, F.col("a")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"),
        F.lit(0).alias("side"), "vec_id", "v", "home", "visits",
    )
    met = wide.where("a > 0").select(
        "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), F.pmod(F.shiftright(h, 20), F.col("b")).cast("int").alias("j"),
        F.lit(1).alias("side"), "vec_id", "v", "home", F.lit(None).cast("array<int>").alias("visits"),
    )
    found = cut_lineage(
        home.unionByName(met).groupBy("dim", "cell", "i", "j").applyInPandas(_compare(least), "vec_id long, n long, low long")
    )
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    per_vector = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return per_vector.join(groups, F.col("vec_id") == F.col("node")).select("vec_id", "n_links", F.col("component").alias("component_id"))


@shielded
def dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """``df`` with ``n_links``, ``component_id`` and ``kept`` (the smallest id of its component).

    Vectors that are null, zero or hold null or non-finite components, and rows without an id, link with
    nothing: they keep their own id as component and stay. Repeated rows get the same result.
    """
    found = links(df, vec_id, embedding, least).toDF("__id", "__n", "__c")
    rows = df.join(found, F.col(vec_id) == F.col("__id"), "left")
    rows = rows.select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_links", "component_id", "kept")],
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("__c", F.col(vec_id)).cast("long").alias("component_id"),
    )
    return rows.withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(True)))
