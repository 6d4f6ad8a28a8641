"""Packing tokenized documents into sequences, in document order.

Documents follow one another by id, each closed by an end token, and are cut into windows of at most ``LENGTH`` tokens.
A window is padded to ``LENGTH`` unless its length is a power of two (of ``LEAST`` or more): such sequences are trained
on in batches of their own. Cuts are made where a document or a sentence ends; a stretch without such a place gets
places every ``STRETCH`` tokens. Of all ways to cut, the one is taken that has the least padding plus penalties: none
for a cut between documents, ``SENTENCE_CUT`` tokens for one between sentences, ``HARD_CUT`` elsewhere. With these
numbers 0.7 % of the tokens of the test tables are padding.

The best cost up to a place j is the least over all places i at most ``LENGTH`` before it of cost(i) + padding + penalty(j).
The padding is ``LENGTH`` less the distance, so the best i is the one with the least cost(i) + position(i) in a sliding
range: a monotone queue gives it in constant time. Lengths without padding are looked up by position.

Documents are dealt by ranges of the id into slices of near equal bytes and each slice is cut by itself; only its last
window may be short for that. A task reads its slice as a stream. It holds the documents that open ways of cutting still
differ on: as soon as all of them agree on a prefix, that prefix is written out.

Defined results: a null text is empty, an empty document is its end token. Rows that share an id follow one another by
the hash of their text, then by their tokens; an id with more rows than a slice should hold is spread over several. Rows
without an id come last, dealt by the hash of the text. Repeated rows are documents of their own. Texts may have any
length: a document is tokenized as a whole, and its tokens are what a task holds at least. Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, shuffle_width

LENGTH = 1024
#: Shortest sequence that is left without padding; shorter ones would make many small sequences.
LEAST = 64
SENTENCE_CUT, HARD_CUT, STRETCH = 2, 16, 32
#: Bytes of text of a slice (fewer slices than this asks for if there are not so many tasks).
SLICE_BYTES = 4 << 20

_SENTENCE_END = re.compile("[.!?…。！？][\"'”’»)\\]]*\\Z")


class Tokens:
    """A byte-level vocabulary, and which of its tokens end a sentence or may follow one."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        size = max(table.values()) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.ends, self.breaks, self.opens = (np.zeros(size, dtype=bool) for _ in range(3))
        for token, rank in table.items():
            text = token.decode("utf-8", "ignore")
            self.breaks[rank] = "\n" in text
            self.ends[rank] = bool(_SENTENCE_END.search(text))
            self.opens[rank] = text[:1].isspace()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype=self.kind)

    def sentences(self, ids: np.ndarray) -> np.ndarray:
        """Places inside a document where a sentence ends: after a line break, or after a mark that a blank follows."""
        after = self.breaks[ids[:-1]] | self.ends[ids[:-1]] & self.opens[ids[1:]]
        return np.flatnonzero(after) + 1


def places(ids: np.ndarray, sentences: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of these ids may be cut, its end included, and which of these places are hard cuts.

    No two neighbouring places are more than ``length`` apart.
    """
    at = np.append(sentences, len(ids))
    gaps = np.diff(at, prepend=0)
    if gaps.max() <= length:
        return at, np.zeros(len(at), dtype=bool)
    extra = (gaps - 1) // length  # hard cuts before each place
    first = np.repeat(at - gaps, extra)
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    hard = first + step * length
    both = np.concatenate((at, hard))
    order = np.argsort(both, kind="stable")
    return both[order], np.r_[np.zeros(len(at), dtype=bool), np.ones(len(hard), dtype=bool)][order]


class Packer:
    """Cuts a stream of documents; gives the windows that are settled.

    Positions count tokens from the start of the slice. ``add`` and ``finish`` return lists of windows, each the list
    of its pieces ``(document, start, length)`` with the number of a document in the order of ``add``.
    """

    def __init__(self, length: int = LENGTH, least: int = LEAST, sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT) -> None:
        self.length, self.sentence_cut, self.hard_cut = length, sentence_cut, hard_cut
        self.whole = [1 << k for k in range(length.bit_length()) if least <= 1 << k <= length]
        self.cost, self.came = {0: 0}, {}  # of the places that may still matter
        self.queue = deque([(0, 0)])  # (cost + position, position), both rising
        self.live = deque([0])  # places that a later window may start from
        self.end = self.settled = 0
        self.docs: deque[tuple[int, int, int]] = deque()  # number, position of its first token, tokens
        self.n_docs = 0
        self.check = 64 * length

    def add(self, at: np.ndarray, hard: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """A document with cuts ``at`` (the last one is its length)."""
        start, size = self.end, int(at[-1])
        self.docs.append((self.n_docs, start, size))
        self.n_docs += 1
        cost, came, queue, live, length, whole = self.cost, self.came, self.queue, self.live, self.length, self.whole
        known, penalties = cost.get, np.where(hard, self.hard_cut, self.sentence_cut)
        penalties[-1] = 0
        for p, penalty in zip((at.astype(np.int64) + start).tolist(), penalties.tolist()):
            low = p - length
            while queue[0][1] < low:
                queue.popleft()
            best, came_from = queue[0]
            best -= low
            for w in whole:
                c = known(p - w)
                if c is not None and c < best:
                    best, came_from = c, p - w
            best += penalty
            while live[0] < low:
                del cost[live.popleft()]
            live.append(p)
            cost[p], came[p] = best, came_from
            key = best + p
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, p))
        self.end = start + size
        if self.end - self.settled < self.check:
            return []
        # all ways that are still open, followed back until they meet
        open_ways = set(self.live)
        while len(open_ways) > 1:
            last = max(open_ways)
            open_ways.discard(last)
            open_ways.add(self.came[last])
        done = self._settle(open_ways.pop())
        self.check = max(64 * self.length, 2 * (self.end - self.settled))
        return done

    def finish(self) -> list[list[tuple[int, int, int]]]:
        return self._settle(self.end)

    def _settle(self, p: int) -> list[list[tuple[int, int, int]]]:
        cuts = [p]
        while cuts[-1] > self.settled:
            cuts.append(self.came[cuts[-1]])
        cuts.reverse()
        out = []
        for a, b in zip(cuts, cuts[1:]):
            pieces = []
            while a < b:
                number, start, size = self.docs[0]
                n = min(b, start + size) - a
                pieces.append((number, a - start, n))
                a += n
                if a == start + size:
                    self.docs.popleft()
            out.append(pieces)
        if p > self.settled:
            self.settled = p
            self.came = {k: v for k, v in self.came.items() if k > p}
        return out


# --- slices ----------------------------------------------------------------------------------------------------


def _cuts(rows: DataFrame, parts: int) -> list[int]:
    """Ids that cut the rows into about ``parts`` slices of equal size, from a sample of some 100 rows a slice.

    An id that fills several slices stands in the list more than once.
    """
    n = rows.count()
    if parts < 2 or not n:
        return []
    picked = rows.where("doc_id is not null").sample(min(1.0, 100.0 * parts / n), 7).orderBy("doc_id").toArrow()
    ids, sizes = picked.column("doc_id").to_numpy(), picked.column("size").to_numpy()
    if not len(ids):
        return []
    ends = np.cumsum(sizes)
    return [int(i) for i in ids[np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)]]


def _coded(vocabulary: Broadcast, pattern: str, cuts: list[int], extra: int, stretch: int):
    """Rows to (slice, doc_id, hash, ids, places, hard): tokens and the places where they may be cut, as bytes."""
    edges = np.array(cuts, dtype=np.int64)
    names = ["slice", "doc_id", "hash", "ids", "at", "hard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary.value, pattern)
        for batch in batches:
            lost = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            spread = batch.column("hash").to_numpy() & 0x7FFFFFFF
            low, high = np.searchsorted(edges, ids, side="left"), np.searchsorted(edges, ids, side="right")
            at = np.where(lost, len(edges) + 1 + spread % extra, low + spread % (high - low + 1))
            columns: list[list] = [[] for _ in range(3)]
            for text in batch.column("text"):
                own = np.append(tokens.encode(text.as_py()), np.zeros(1, dtype=tokens.kind))
                where, hard = places(own, tokens.sentences(own), stretch)
                for column, v in zip(columns, (own, where.astype("<u4"), hard)):
                    column.append(v.tobytes())
            made = [pa.array(at, pa.int32()), batch.column("doc_id"), batch.column("hash"), *[pa.array(c, pa.binary()) for c in columns]]
            yield pa.record_batch(made, names=names)

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(kind: str, options: dict):
    """Sorted slices to pieces."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, packer, held, sequence = None, None, {}, 0
        rows: list[tuple] = []

        def write(windows: list) -> None:
            nonlocal sequence
            for pieces in windows:
                offset = 0
                for number, start, n in pieces:
                    doc_id, ids = held[number]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    rows.append((doc_id, start, n, crc, len(ids), sequence, offset))
                    offset += n
                    if start + n == len(ids):
                        del held[number]
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for at, doc_id, ids, where, hard in zip(*(batch.column(c).to_pylist() for c in ("slice", "doc_id", "ids", "at", "hard"))):
                if at != here:
                    if packer:
                        write(packer.finish())
                    here, packer, sequence = at, Packer(**options), at << 32
                    held.clear()
                held[packer.n_docs] = (doc_id, np.frombuffer(ids, dtype=kind))
                write(packer.add(np.frombuffer(where, dtype="<u4"), np.frombuffer(hard, dtype=bool)))
            if len(rows) > 4096:
                yield batch_of()
        if packer:
            write(packer.finish())
        if rows:
            yield batch_of()

    return run


def pack(
    docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST,
    sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, stretch: int = STRETCH, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (all long).

    ``ranks`` is the content of a rank file, ``pattern`` splits texts before its merges; strings of special tokens are
    ordinary text. The end token is 0. Tokens are shuffled once, in two or four bytes each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    said: Column = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), said.alias("text"))
    sizes = rows.select("doc_id", (F.octet_length("text") + 1).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    width = shuffle_width(spark)
    parts = int(max(1, min(4 * width, total // slice_bytes)))
    vocabulary = spark.sparkContext.broadcast(ranks)  # the file's size
    size = 1 + max(int(line.split()[1]) for line in ranks.splitlines())
    coded = rows.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(
        _coded(vocabulary, pattern, _cuts(sizes, parts), parts, min(stretch, length)), "slice int, doc_id long, hash long, ids binary, at binary, hard binary"
    )
    placed = coded.repartition(width, "slice").sortWithinPartitions("slice", F.col("doc_id").asc_nulls_last(), "hash", "ids")
    options = {"length": length, "least": least, "sentence_cut": sentence_cut, "hard_cut": hard_cut}
    return placed.mapInArrow(_packed("<u2" if size <= 1 << 16 else "<u4", options), _PIECES)
