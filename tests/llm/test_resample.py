import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import docs, no_docs, prose  # noqa: F401
from tidebarge.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def plain(rows, target, share, longest=1, buckets=10_000, least=20, seed=2024):
    """Rows of (doc_id, text) to (doc_id, n_features, weight, score, drawn), one after the other."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in runs(x, longest)[0]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        found, n = runs(text, longest)
        weight = sum(gain(place(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, n, i])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {r[5]: k for k, r in enumerate(able[: len(able) * share[0] // share[1]], 1)}
    return sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], rank.get(r[5], 0)) for r in out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score, r["rank"] or 0) for r in df.collect())


@pytest.mark.parametrize("longest, share", [(1, (10, 100)), (3, (1, 2)), (1, (1, 1)), (2, (0, 1))])
def test_against_plain(spark, docs, longest, share):
    target = [prose(3, 300), prose(50, 40), None, ""]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, prose(100 + i, 15 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scored = resample.scored(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert got(resample.draw(scored, share)) == plain(rows, target, share, longest)


def test_ties_and_repeated_rows(spark):
    """One text and id many times over: every row has a rank of its own up to the share."""
    rows = [(5, prose(1, 30))] * 50 + [(None, prose(1, 30))] * 20 + [(6, "short")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([(prose(1, 30),)], "text string")
    ranked = resample.draw(resample.scored(df, target), (30, 100))
    assert got(ranked) == plain(rows, [prose(1, 30)], (30, 100))
    assert sorted(r["rank"] for r in ranked.collect() if r["rank"]) == list(range(1, 22))


def test_cutoff_is_exact(spark):
    values = [v for v in (-(2**62), -5, -5, -5, 0, 3, 3, 9, 2**62) for _ in range(3)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for need in (1, 3, 11, 21, 27):
        want = sorted(values, reverse=True)[need - 1]
        assert resample._cutoff(df, "v", need) == (want, sum(v > want for v in values))
    assert resample._cutoff(df, "v", len(values) + 1) == (None, len(values))


def test_long_texts_in_chunks(spark, monkeypatch):
    text = "Ab" + "é" * 700 + " " + prose(8, 3000) + "x" * 5000 + " end"
    whole = resample.features(text.encode(), 3, 997)
    monkeypatch.setattr(resample, "CHUNK", 100)
    parts = resample.features(text.encode(), 3, 997)
    assert np.array_equal(*(np.bincount(f[0], f[1], 997) for f in (whole, parts))) and whole[2] == parts[2] == len(runs(text, 1)[0])
    big = spark.createDataFrame([(1, "word " * 300_000), (2, "w" * 1_500_000)], "doc_id long, text string")
    assert [r.n_features for r in resample.scored(big, big).orderBy("doc_id").collect()] == [300_000, 1]


def test_empty_tables(spark, no_docs, docs):
    assert resample.draw(resample.scored(no_docs, no_docs), (1, 2)).collect() == []
    some = resample.scored(docs, no_docs)
    assert some.count() == docs.count() and some.where(F.col("n_features") == 0).agg(F.max(F.abs("weight"))).first()[0] == 0


def test_clashing_names(spark):
    """Work names give way to the input's columns; result names replace them."""
    df = spark.createDataFrame([(i, prose(i, 30), i, "w", "k") for i in range(9)], "doc_id long, text string, __at long, __W string, __slice string")
    out = resample.draw(resample.scored(df.withColumn("Weight", F.lit("x")), df), (1, 3))
    assert sorted(out.columns) == sorted(["doc_id", "text", "__at", "__W", "__slice", "n_features", "n_words", "weight", "score", "rank"])
    assert {(r.doc_id, r["__at"], r["__W"], r["__slice"]) for r in out.collect()} == {(i, i, "w", "k") for i in range(9)}
    assert out.where("rank is not null").count() == 3
