"""Columns with clashing names go through every operator that keeps its input's columns, and every stage of the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from samples import docs, prose  # noqa: F401
from tidebarge.llm import bpe, embeddings, jaccard, lines, mixing, packing, privacy, quality, queries, resample, secrets, shards, simhash, sketch

NAMES = ["__key", "__k", "__n", "__i", "__id", "__c", "__site", "__kept", "__drop", "__host", "__p", "__made_fp", "__coded", "__pii_found",
         "__pii_new", "__tx", "__rh", "__rank", "__slice", "__pos", "__quality", "__at", "slice", "hash", "group", "node", "h", "Copies"]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, prose(i % 25, 40 + i) + ". mail me@example.com", "en", "ab"[i % 2], 9) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def check(out, rows):
    """All extra columns are there and belong to their rows."""
    got = out.collect()
    assert len(got) >= rows
    for r in got:
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES), r


RANKS = "byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("operator", [
    lambda d: bpe.encode_and_decode(d, queries.rank_file(RANKS), public_tokenizers.PATTERN),
    lambda d: lines.drop_boilerplate(d, F.col("source")),
    lambda d: privacy.pseudonymise(d, "key", replaced="n"),
    lambda d: simhash.fingerprints(d),
    lambda d: sketch.sketches(d),
    lambda d: resample.draw(resample.scored(d, d), (1, 2)),
    lambda d: quality.score(d, None),
    lambda d: mixing.mix(d).distinct(),
], ids=["bpe", "lines", "privacy", "simhash", "sketch", "resample", "quality", "mixing"])
def test_operators_keep_columns(wide, operator):
    check(operator(wide), 20)


def test_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(9)], "doc_id long, embedding array<float>")
    df = df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    check(embeddings.dedup(df, "doc_id"), 9)


def test_columns_named_by_an_argument(spark):
    df = spark.createDataFrame([(1, "me@example.com"), (2, "nothing")], "__id long, __k string")
    got = privacy.pseudonymise(df, "key", text="__k", replaced="n").orderBy("__id").collect()
    assert [(r["__id"], r.n) for r in got] == [(1, 1), (2, 0)] and got[0]["__k"] != "me@example.com" and got[1]["__k"] == "nothing"


def test_operators_with_rows_of_their_own(wide):
    assert shards.shard_documents(wide).count() == 30 and sketch.edited_pairs(wide).count() == 30
    assert simhash.link_documents(wide).count() == 30 and mixing.copies(wide).count() == 30
    assert packing.pack(wide, queries.rank_file(RANKS), public_tokenizers.PATTERN).where("start = 0").count() == 30
    assert secrets.scan(wide).count() >= 0


def test_stages_keep_columns(spark, wide, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n in NAMES if n != "Copies"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide.select("doc_id", "text", "lang", "source", "n_chars", *names), str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names), name
    kept = {r.doc_id for r in jaccard.keep_one(wide).collect()}
    assert kept and kept <= set(range(30))
