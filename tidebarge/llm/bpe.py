"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a rank queue: a bucket per merge rank holds the places (in a linked
list of tokens) where a pair of that rank begins, and a bitmap of two levels marks the buckets in
use. Find-first-set on both levels gives the lowest rank in two steps, however long the pre-token
is; entries overtaken by another merge are skipped when they come up. A pre-token of n bytes costs
O(n) queue steps, where scanning for the best pair would cost O(n^2).

Texts are independent, so encoding is one pass without a shuffle; a worker remembers the ids of
pre-tokens it has met (a bounded number).

Null text: no ids. Empty text: no ids. Null ids decode to no bytes. Other columns pass through; a
column with the name of the result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, put, shielded

#: Pre-tokens of a generation that a worker remembers (two generations, about 160 bytes each).
REMEMBERED = 1 << 17
#: Pre-tokens that are held and merged at a time (a text's are never parted).
TOGETHER = 200_000
#: Bytes of a pre-token up to which it is merged together with others.
SHORT = 48


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from the text of a rank file (base64 token, blank, rank)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Merger:
    """Encodes single pre-tokens by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        # bits of a bitmap word such that two levels of words cover all ranks
        self.shift = max(1, -(-max(ranks.values()).bit_length() // 2))
        self.bits = [1 << i for i in range(1 << self.shift)]

    def encode(self, piece: bytes) -> list[int]:
        rank_of, shift, bits = self.ranks.get, self.shift, self.bits
        if (whole := rank_of(piece)) is not None:
            return [whole]
        n, mask, longest = len(piece), len(bits) - 1, self.longest
        after = list(range(1, n + 1))  # where the token after the one at i begins
        before = list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins at i; -1: none
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}  # lower level: ranks in use
        top = 0  # upper level: words in use
        for at, rank in enumerate(pair):
            if rank >= 0:
                if bucket := buckets.get(rank):
                    bucket.append(at)  # ascending, so a heap already
                else:
                    buckets[rank] = [at]
                    w = rank >> shift
                    words[w] = words.get(w, 0) | bits[rank & mask]
                    top |= bits[w]
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w << shift | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                words[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[at] != rank:
                continue  # overtaken
            gone = after[at]
            after[at] = end = after[gone]
            pair[gone] = pair[at] = -1
            # the merged token has a new pair on either side
            if end < n:
                before[end] = at
                if (stop := after[end]) - at <= longest and (rank := rank_of(piece[at:stop], -1)) >= 0:
                    pair[at] = rank
                    if bucket := buckets.get(rank):
                        heappush(bucket, at)
                    else:
                        buckets[rank] = [at]
                        w = rank >> shift
                        words[w] = words.get(w, 0) | bits[rank & mask]
                        top |= bits[w]
            if (left := before[at]) >= 0:
                rank = rank_of(piece[left:end], -1) if end - left <= longest else -1
                pair[left] = rank
                if rank >= 0:
                    if bucket := buckets.get(rank):
                        heappush(bucket, left)
                    else:
                        buckets[rank] = [left]
                        w = rank >> shift
                        words[w] = words.get(w, 0) | bits[rank & mask]
                        top |= bits[w]
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return out


class BatchMerger:
    """The same queue over many short pre-tokens at once.

    All pre-tokens lie in one array of places, each closed by a barrier. A pop takes the bucket of the
    lowest rank and merges one place of every pre-token in it, so each pre-token sees its merges in its
    own order; places left over go back to the bucket. Few pops serve many pre-tokens, which pays for
    short ones; a long one would be merged one place at a time, so those take :class:`Merger`.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = max(1, -(-max(ranks.values()).bit_length() // 2))
        self.wide = max(ranks.values()).bit_length() + 1
        pairs = [
            (ranks[token[:i]] << self.wide | ranks[token[i:]], rank)
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], dtype=np.int64)
        self.values = np.array([v for _, v in pairs] + [-1], dtype=np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; -1 where a side is a barrier or the pair is no token."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left.astype(np.int64) << self.wide | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none of them empty) as int32 bytes."""
        shift, mask = self.shift, (1 << self.shift) - 1
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)  # the barrier of a piece; place 0 is a barrier too
        starts = ends - lengths
        token = np.full(ends[-1] + 1, -1, dtype=np.int32)
        inside = np.ones(len(token), dtype=bool)
        inside[0] = inside[ends] = False
        token[inside] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.zeros(len(token), dtype=np.int32)
        owner[starts] = 1
        owner = np.cumsum(owner, dtype=np.int32)
        after = np.arange(1, len(token) + 1, dtype=np.int32)
        before = np.arange(-1, len(token) - 1, dtype=np.int32)
        pair = np.full(len(token), -1, dtype=np.int32)
        pair[:-1] = self.rank_of(token[:-1], token[1:])
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        cuts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        for rank, places in zip(pair[order[cuts]].tolist(), np.split(order, cuts[1:]) if len(cuts) else []):
            buckets[rank] = places.tolist()
            words[rank >> shift] = words.get(rank >> shift, 0) | 1 << (rank & mask)
            top |= 1 << (rank >> shift)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w << shift | (word & -word).bit_length() - 1
            at = np.array(buckets.pop(rank))
            at = at[pair[at] == rank]  # the others were overtaken
            if len(at) > 1:
                at.sort()
                owners = owner[at]
                again = owners[1:] == owners[:-1]
                if again.any():
                    buckets[rank] = at[1:][again].tolist()
                    at = np.concatenate((at[:1], at[1:][~again]))
            if rank not in buckets:
                words[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            after[at], before[end], token[at], pair[gone] = end, at, rank, -1
            left = before[at]
            places = np.concatenate((at, left))
            ranks = self.rank_of(token[places], token[np.concatenate((end, at))])
            pair[places] = ranks
            made = ranks >= 0
            ranks, places = ranks[made], places[made]
            if len(ranks) > 200:  # put places of one rank together
                order = np.argsort(ranks, kind="stable")
                ranks, places = ranks[order], places[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                bounds = [0, *cuts.tolist(), len(ranks)]
                places = places.tolist()
                pushed = [(r, places[lo:hi]) for r, lo, hi in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:])]
            else:
                pushed = [(r, [place]) for r, place in zip(ranks.tolist(), places.tolist())]
            for r, some in pushed:
                if r in buckets:
                    buckets[r] += some
                else:
                    buckets[r] = some
                    w = r >> shift
                    words[w] = words.get(w, 0) | 1 << (r & mask)
                    top |= 1 << w
        # places that still begin a token, piece by piece
        alive = np.zeros(len(token), dtype=bool)
        alive[inside] = True
        merged = np.flatnonzero(inside & (after - np.arange(len(token)) > 1))
        if len(merged):
            spans = after[merged] - merged - 1
            # ends of merged tokens: everything between a start and the next one is gone; dead places keep their
            # own, older spans, which lie inside the living ones
            covered = np.zeros(len(token) + 1, dtype=np.int64)
            np.add.at(covered, merged + 1, 1)
            np.add.at(covered, merged + 1 + spans, -1)
            alive &= np.cumsum(covered[:-1]) == 0
        counts = np.add.reduceat(alive[1:], starts - 1, dtype=np.int64)
        ids = token[alive].astype(np.int32)
        out, lo = [], 0
        for hi in np.cumsum(counts).tolist():
            out.append(ids[lo:hi].tobytes())
            lo = hi
        return out


class _Remembered:
    """Ids of pre-tokens as int32 bytes. Two generations: what is met again outlives what is met once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.one, self.many = ranks, Merger(ranks), BatchMerger(ranks)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """``texts``: the pre-tokens of each text."""
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set().union(*texts).difference(young)
        found = {p: ids for p in new if (ids := old.get(p)) is not None}
        young.update(found)
        short, raw = [], []
        for piece in new.difference(found):
            b = piece.encode()
            if (whole := self.ranks.get(b)) is not None:
                young[piece] = whole.to_bytes(4, "little")
            elif len(b) <= SHORT:
                short.append(piece)
                raw.append(b)
            else:
                young[piece] = np.array(self.one.encode(b), dtype=np.int32).tobytes()
        if short:
            young.update(zip(short, self.many.encode(raw)))
        out = [b"".join(map(young.__getitem__, t)) for t in texts]
        if any(len(p) > SHORT for p in new):
            self.young = {p: ids for p, ids in young.items() if len(p) <= SHORT}
        return out


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str):
    return regex.compile(pattern), _Remembered(read_ranks(raw))


@lru_cache(maxsize=2)
def _tokens(raw: bytes) -> pa.Array:
    """Token bytes by id; null where the vocabulary has no such id."""
    by_id = {rank: token for token, rank in read_ranks(raw).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], type=pa.large_binary())


def decode_ids(ids: pa.ListArray, raw: bytes) -> pa.Array:
    """Bytes of each list of ids."""
    flat = ids.flatten()  # null lists have no items
    tokens = _tokens(raw).take(flat)
    if tokens.null_count:
        raise ValueError("an id is not in the vocabulary")
    counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(counts)))
    _, offsets, data = tokens.buffers()
    # the bytes of a list lie side by side: only its outer offsets are kept
    at = np.frombuffer(offsets, dtype=np.int64, count=len(flat) + 1)[ends] if offsets else np.zeros(len(ids) + 1, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.tobytes()), data or pa.py_buffer(b"")]).cast(pa.binary())


def encode_texts(texts: list[str | None], raw: bytes, pattern: str) -> list[bytes]:
    """Ids of each text as int32 bytes."""
    split, remembered = _encoder(raw, pattern)
    out, some, size = [], [], 0
    for t in texts:
        some.append(split.findall(t) if t else [])
        size += len(some[-1])
        if size >= TOGETHER:
            out += remembered.encode(some)
            some, size = [], 0
    return out + (remembered.encode(some) if some else [])


def _listed(parts: list[bytes]) -> pa.ListArray:
    """Lists of ids from int32 bytes."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids (array of int) of ``text``.

    ``ranks`` is the content of a rank file (a bounded vocabulary, sent to the workers once);
    ``pattern`` splits a text into pre-tokens.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _listed(encode_texts(batch.to_pylist(), sent.value, pattern))

    return put(df, **{ids: run(F.col(text))})


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary); an id outside the vocabulary is an error."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield decode_ids(batch, sent.value)

    return put(df, **{out: run(F.col(ids))})


@shielded
def encode_and_decode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: the ids do not travel to a second worker."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            coded = _listed(encode_texts(batch.to_pylist(), sent.value, pattern))
            yield pa.StructArray.from_arrays([coded, decode_ids(coded, sent.value)], names=["ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return put(put(df, __coded=run(F.col(text))), **{ids: F.col("__coded.ids"), out: F.col("__coded.decoded")}).drop("__coded")
