import base64
import hashlib
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import docs, no_docs  # noqa: F401

from tidebarge.llm import bpe
from tidebarge.llm.queries import QUERIES, rank_file

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(P.path("byte_bpe_multi_50k.tiktoken")).open("rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ONE, MANY = bpe.Merger(RANKS), bpe.BatchMerger(RANKS)


def ids_of(texts):
    return [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in bpe.encode_texts(texts, rank_file(), P.PATTERN)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_are_those_of_the_reference_encoder(texts):
    assert ids_of(texts) == [TRUE.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=20))
def test_both_queues_agree(pieces):
    got = [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in MANY.encode(pieces)]
    want = [ONE.encode(p) for p in pieces]
    assert [g for g, p in zip(got, pieces) if p not in RANKS] == [w for w, p in zip(want, pieces) if p not in RANKS]


@pytest.mark.parametrize("piece", ["a" * 50_000, "ab" * 20_000, "é" * 9_001, "ha" * 25 + "h", "=" * 4097])
def test_very_long_pre_tokens(piece):
    assert ids_of([piece]) == [TRUE.encode_ordinary(piece)]


def test_any_ranks_not_only_trained_ones():
    # a vocabulary whose ranks do not follow the order in which tokens can be built
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 400, b"ba": 300, b"aba": 350, b"abab": 5, b"bab": 301, b"aa": 2, b"aaa": 1}
    enc = tiktoken.Encoding("t", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    for text in ("abab", "ababa", "aaaaa", "baab", "abbaabab", "aabaaab"):
        assert bpe.Merger(ranks).encode(text.encode()) == enc.encode_ordinary(text)
        got = bpe.BatchMerger(ranks).encode([text.encode(), b"zab"])[0]
        if text.encode() not in ranks:
            assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == enc.encode_ordinary(text)


def test_round_trip_of_a_table(docs, no_docs):
    ranks = rank_file()
    coded = bpe.decode(bpe.encode(docs, ranks, P.PATTERN, ids="FP"), ranks, ids="FP")  # the clashing column is replaced
    assert [c for c in coded.columns if c.lower() == "fp"] == ["FP"]
    rows = coded.select("text", "FP", "decoded").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.FP) == TRUE.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_and_decode(no_docs, ranks, P.PATTERN).count() == 0


def test_decode_takes_null_and_refuses_unknown_ids(spark):
    df = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, rank_file()).collect()] == [b"", b"", TRUE.decode_bytes([0, 1])]
    bad = spark.createDataFrame([([10**6],)], "ids array<int>")
    with pytest.raises(Exception):
        bpe.decode(bad, rank_file()).collect()


def test_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = TRUE.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
