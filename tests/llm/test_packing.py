import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samples import docs, no_docs, prose  # noqa: F401
from tidebarge.llm import packing, queries

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def ranks():
    return queries.rank_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    return lambda text: [*coder.encode(text or "", add_special_tokens=False).ids, 0]


def padding(size, length, least):
    return 0 if size == length or size >= least and size & (size - 1) == 0 else length - size


def least_cost(documents, length, least, sentence_cut, hard_cut):
    """Cost of the best cuts, every pair of places tried."""
    places, start = [(0, 0)], 0
    for at, hard in documents:
        places += [(start + p, hard_cut if h else sentence_cut) for p, h in zip(at[:-1].tolist(), hard[:-1].tolist())]
        start += int(at[-1])
        places.append((start, 0))
    best = [0]
    for j in range(1, len(places)):
        p, penalty = places[j]
        best.append(penalty + min(best[i] + padding(p - places[i][0], length, least) for i in range(j) if p - places[i][0] <= length))
    return best[-1]


documents = st.lists(
    st.tuples(st.integers(1, 120), st.sets(st.integers(1, 119), max_size=12)).map(lambda d: (d[0], sorted(x for x in d[1] if x < d[0]))), max_size=25
)


@settings(max_examples=150, deadline=None)
@given(documents, st.sampled_from([8, 16, 32]), st.sampled_from([0, 3, 9]), st.booleans())
def test_cuts_are_the_best(lengths, length, sentence_cut, often):
    hard_cut, least = 2 * sentence_cut + 5, 4
    given_docs = [packing.places(np.zeros(n, dtype="<u2"), np.array(s, dtype=np.int64), length) for n, s in lengths]
    packer, windows = packing.Packer(length, least, sentence_cut, hard_cut), []
    for at, hard in given_docs:
        if often:
            packer.check = 0
        windows += packer.add(at, hard)
    windows += packer.finish()
    seen, cost = defaultdict(int), 0
    for pieces in windows:
        size = sum(n for *_, n in pieces)
        assert 0 < size <= length
        cost += padding(size, length, least)
        for number, start, n in pieces:
            assert start == seen[number] and n > 0
            seen[number] += n
            at, hard = given_docs[number]
            if seen[number] < at[-1]:
                place = at.tolist().index(seen[number])
                cost += hard_cut if hard[place] else sentence_cut
    assert [seen[i] for i in range(len(lengths))] == [n for n, _ in lengths]
    assert cost == least_cost(given_docs, length, least, sentence_cut, hard_cut)


def test_settled_early():
    """What a task holds does not grow with the stream."""
    r = np.random.default_rng(3)
    packer, most = packing.Packer(), 0
    for _ in range(3000):
        n = int(r.integers(1, 900))
        packer.add(*packing.places(np.zeros(n, dtype="<u2"), np.unique(r.integers(1, n, n // 20)) if n > 1 else np.array([], dtype=int)))
        most = max(most, packer.end - packer.settled)
    assert most < 300 * 1024


def check(rows, texts, ids_of, length=1024):
    """Every id in one piece, every sequence gapless, in document order; returns padding and tokens."""
    want = {k: ids_of(t) for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id))
    for k, ids in want.items():
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at
            at += n
        assert at == len(ids)
    padded, order = 0, []
    for _, parts in sorted(sequences.items()):
        at = 0
        for offset, n, doc_id in sorted(parts):
            assert offset == at
            at += n
            order.append(doc_id)
        assert at <= length
        padded += padding(at, length, packing.LEAST)
    assert [d for d in order if d is not None] == sorted(d for d in order if d is not None)
    return padded, sum(map(len, want.values()))


def test_documents(spark, ranks, ids_of):
    texts = {i: prose(i, 5 + i * 7).replace(" a", ". A") for i in range(120)}
    texts |= {200: None, 201: "", 202: "x" * 40_000, 203: "Größe 日本語。 <|endoftext|> text — ok!\n\nnaïve", 204: "word " * 300_000, None: "no id. At all."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    for slice_bytes in (packing.SLICE_BYTES, 20_000):
        rows = packing.pack(df, ranks, public_tokenizers.PATTERN, slice_bytes=slice_bytes).collect()
        padded, total = check(rows, texts, ids_of)
        assert len({r.sequence_id >> 32 for r in rows}) > 1 and padded < 0.02 * total


def test_query_tokenizes_as_the_library(spark, ids_of):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_pack"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    padded, total = check(rows, texts, ids_of)
    assert padded < 0.02 * total


def test_one_id_for_many_rows(spark, ranks):
    """An id, or none, with most of the rows is dealt over several slices; no row is lost."""
    rows = [(5, prose(i, 40)) for i in range(400)] + [(None, prose(i, 40)) for i in range(200)] + [(i, "few words") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, ranks, public_tokenizers.PATTERN, slice_bytes=5_000).collect()
    for doc_id in (5, None):
        slices = {r.sequence_id >> 32 for r in got if r.doc_id == doc_id}
        assert len(slices) > 3
    assert sum(r.start == 0 for r in got) == len(rows)
    assert {r.sequence_id >> 32 for r in got if r.doc_id is None}.isdisjoint({r.sequence_id >> 32 for r in got if r.doc_id is not None})


def test_nulls_names_and_empty(spark, docs, no_docs, ranks):
    df = docs.withColumns({"slice": docs.doc_id, "hash": docs.text, "ids": docs.text, "Start": docs.text})
    got = packing.pack(df, ranks, public_tokenizers.PATTERN).collect()
    assert sum(r.start == 0 for r in got) == docs.count()
    assert packing.pack(no_docs, ranks, public_tokenizers.PATTERN).collect() == []
