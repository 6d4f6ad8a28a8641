"""Line dedup, quality, mixing, shards, pseudonyms, secrets and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from samples import DOCS, docs, no_docs, prose  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tidebarge.llm import lines, mixing, privacy, quality, secrets, shards
from tidebarge.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


# --- lines ---------------------------------------------------------------------------------------------------


def plain_line_dedup(rows, ratio, least):
    total, pages = Counter(), Counter()
    for host, text in rows:
        total[host] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host, line] += 1
    bad = {k for k, n in pages.items() if n >= least and n > total[k[0]] * ratio}
    return Counter((h, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or (h, x.strip(" ")) not in bad)) for h, t in rows)


@pytest.mark.parametrize("most", [10**6, 0])
def test_lines_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    rows = [("a", f"Menu\n{prose(i, 9)}\n\n  Menu \nfoot {i % 3}") for i in range(30)] + [(None, "Menu\nx")] * 6 + [("b", None), ("b", ""), ("b", "Menu")]
    df = spark.createDataFrame([(h, t, 1) for h, t in rows], "HOST string, text string, __n int")
    out = lines.drop_boilerplate(df, F.col("HOST"), ratio=0.3, least=5, dropped="dropped")
    assert out.columns == ["HOST", "text", "__n", "dropped"]
    assert Counter((r.HOST, r.text) for r in out.collect()) == plain_line_dedup(rows, 0.3, 5)


def test_lines_of_pages_and_empty_table(spark, no_docs):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("text", F.regexp_replace("html", "(</p>|</li>|</nav>|</style>|</title>|</head>)", "$1\n"))
    rows = [(r.host, r.text) for r in pages.select(lines.host_of(F.col("url")).alias("host"), "text").collect()]
    out = lines.drop_boilerplate(pages, lines.host_of(F.col("url")), ratio=0.5, least=3)
    assert Counter((r.host, r.text) for r in out.select(lines.host_of(F.col("url")).alias("host"), "text").collect()) == plain_line_dedup(rows, 0.5, 3)
    assert lines.drop_boilerplate(no_docs, F.col("source")).count() == 0


def test_host_of(spark):
    urls = {"http://A.example.com/x": "a.example.com", "https://u@b.example:80/?q": "b.example", "no url": None, None: None, "ftp://c.d#top": "c.d"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", lines.host_of(F.col("u")).alias("h")).collect()} == urls


# --- quality -------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality.train(docs, labels.where(part))
    scored = quality.score(docs, model, views=True).join(labels.where(~part), "doc_id").toPandas()
    kept = scored.quality_score >= quality.REJECT
    assert kept[scored.quality == 1].mean() > 0.98 and kept[scored.quality == 0].mean() < 0.2
    for view in ("text_score", "meta_score"):  # each view is worth something by itself
        assert scored[view][scored.quality == 1].mean() > scored[view][scored.quality == 0].mean() + 0.2


def test_co_training_uses_what_the_other_view_is_sure_of():
    r = np.random.default_rng(5)
    n, y = 2000, r.integers(0, 2, 2000)
    a, b = (np.c_[2.0 * y - 1 + r.normal(size=n), r.normal(size=(n, 30))].astype(np.float32) for _ in range(2))
    few = np.flatnonzero(np.arange(n) < 40)
    rest = np.arange(40, n)
    def right(rounds):
        m = quality.co_train(a[few], b[few], y[few].astype(float), a[rest], b[rest], rounds=rounds)
        return ((m.odds(a[rest], b[rest])[:, 2] > 0) == y[rest]).mean()
    assert right(6) > right(0) and right(6) > 0.85


def test_quality_oddities(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None and quality.train(no_docs, none) is None
    assert quality.score(docs, None).where("quality_score is not null").count() == 0
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (6, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.train(docs, marks), "FP")
    assert scored.count() == docs.count() and scored.where("FP is null").count() == 0 and scored.columns[-1] == "FP"


# --- mixing --------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mixing.copies(docs).collect()
    word = re.compile(mixing.WORD)
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert len(rows) == len(texts) and all(r["size"] == len(word.findall(texts[r.doc_id][0] or "")) for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["copies"] * r["size"]
        assert 0 <= r.copies <= 2
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert max(abs(taken[s] - want[s]) / want[s] for s in want) < 0.05
    again = mixing.copies(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)


def test_rounding_keeps_expectations(spark):
    """Over many seeds each item is taken as often as its probability says, and sums stay near in each."""
    items = [("s", i, float(1 + (i * 37) % 400), 0.3) for i in range(150)] + [("t", 1000, 5.0, 0.7)]
    df = spark.createDataFrame(items, "source string, id long, size double, p double")
    total, runs = sum(i[2] for i in items[:150]), 4
    ones = Counter()
    for seed in range(runs):
        got = {r.id: r.one for r in mixing.round_copies(df, seed).collect()}
        assert got.keys() == {i[1] for i in items} and set(got.values()) <= {0, 1}
        assert abs(sum(i[2] * got[i[1]] for i in items[:150]) - 0.3 * total) <= 400
        ones.update(k for k, v in got.items() if v)
    assert abs(sum(ones[i[1]] for i in items[:150]) / (150 * runs) - 0.3) < 0.1


def test_mix_oddities(spark, docs, no_docs):
    rows = mixing.copies(docs).collect()
    assert len(rows) == docs.count() and len({(r.doc_id, r.copies) for r in rows if r.doc_id == 6}) == 1
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.copies(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "a", 0)], DOCS)
    assert [(r["size"], r.target, r.copies) for r in mixing.copies(blank).collect()] == [(0, 0.0, 0)] * 2


# --- shards --------------------------------------------------------------------------------------------------


def test_shards_of_a_table(spark):
    rows = QUERIES["op6_shards"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    load, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[raw].add(r.shard)
    assert set(load) == set(range(8)) and all(len(v) == 1 for v in of.values())
    assert max(load.values()) / min(load.values()) < 1.05
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_oddities(spark, docs, no_docs):
    rows = shards.shard_documents(docs, 3).collect()
    assert len(rows) == docs.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert shards.shard_documents(no_docs).count() == 0
    same = spark.createDataFrame([(i, "copy", "en", "a", 4) for i in range(50)], DOCS)
    assert sorted(r.slot for r in shards.shard_documents(same).collect()) == list(range(50))
    equal = spark.createDataFrame([(i, f"{i:04}", "en", "a", 4) for i in range(700)], DOCS)  # ties in all metadata but the id
    load = Counter(r.shard for r in shards.shard_documents(equal, 7).collect())
    assert sorted(load.values()) == [100] * 7


# --- pseudonyms ----------------------------------------------------------------------------------------------

KINDS = {
    "card": ["4111111111111111", "5500 0055 5555 5559", "3782-822463-10005"], "phone": ["+1 (017) 555-7713", "+49 30 1234567", "555-123-4567"],
    "ip": ["10.0.0.1", "255.255.255.255"], "date": ["1999-12-31", "2024/02/29", "31.01.1980", "01/02/2003"], "mail": ["und.34@mail7.example.com", "A_B+1@X.ORG", "éa.1@b.example"],
}


def luhn(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_format_links_and_neighbours(spark):
    values = [v for k in KINDS.values() for v in k]
    df = spark.createDataFrame([(i, f"To {v}, {v}; and##{v}%% end {v}") for i, v in enumerate(values)], "id long, text string")
    out = {r.id: r for r in privacy.pseudonymise(df, "k", replaced="n").collect()}
    for i, v in enumerate(values):
        m = re.fullmatch(r"To (.*), \1; and##\1%% end \1", out[i].text)
        new = m[1]
        assert new != v and out[i].n == 4
        shape = lambda s: re.sub(r"[0-9]", "9", s)
        if v in KINDS["card"] + KINDS["phone"] + KINDS["date"]:
            assert shape(new) == shape(v)
        if v in KINDS["card"]:
            assert luhn(new)
        if v in KINDS["mail"]:
            assert new.split("@")[1] == v.split("@")[1]
        if v in KINDS["ip"]:
            assert all(0 <= int(x) <= 255 for x in new.split("."))
    other = {r.id: r.text for r in privacy.pseudonymise(df, F.lit("another"), replaced="n").collect()}
    assert all(other[i] != out[i].text for i in out)


def test_pseudonyms_are_undone_by_the_key(spark):
    values = [v for k in KINDS.values() for v in k if not v.startswith("é")]
    df = spark.createDataFrame([(i, f"<{v}>") for i, v in enumerate(values)], "id long, text string")
    back = privacy.pseudonymise(privacy.pseudonymise(df, "k"), "k", undo=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_pseudonyms_are_permutations(spark):
    days = spark.range(0, 17 * 4297, 50).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    new = privacy.pseudonymise(days, "k")
    assert new.distinct().count() == days.count() and new.where("not text rlike '^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$' or cast(text as date) is null").count() == 0
    for n in (2, 3):
        digits = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        assert digits.select(privacy.permute_digits(privacy.Key(F.lit("k")), F.lit("t"), F.col("d")).alias("e")).distinct().count() == 10**n


def test_what_fails_its_check_stays(spark, docs, no_docs):
    left = ["4111111111111112", "version 2.0", "256.1.1.1", "2023-02-30", "12345", "1.2.3.4.5", "2024-13-01", "a@b", "doi 10.1234/5678", "0" * 30]
    df = spark.createDataFrame([(x, 5) for x in left] + [(None, 5), ("", 5)], "text string, __new int")
    out = privacy.pseudonymise(df, "k")
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert privacy.pseudonymise(docs, "k").exceptAll(docs).count() == 0 and privacy.pseudonymise(no_docs, "k").count() == 0


# --- secrets -------------------------------------------------------------------------------------------------


def test_secrets_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.scan(docs).select("doc_id", "candidate", "word", "is_secret").collect()
    planted = Counter((r.doc_id, x) for r in docs.collect() for x in re.findall(r"[0-9a-fA-F]{40}", r.text or ""))
    assert Counter((r.doc_id, r.candidate) for r in found if r.is_secret) == planted
    assert len(found) > sum(planted.values())  # others were looked at and removed


def test_every_run_of_a_word_is_a_candidate(spark):
    a, b, c = "aB3dE5gH7jK9mN1pQ2rS", "Zx9Yw8Vu7Ts6Rq5Po4Nm", "k3J5h7G9f1D2s4A6q8W0"
    rows = [(1, f'{{"a":"{a}","b":"{b}"}}'), (2, f"https://example.com/some-long-documentation-path?token={c}"), (3, f"{a},{b},{c}")]
    got = secrets.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.candidate) for r in got) == Counter([(1, a), (1, b), (2, c), (3, a), (3, b), (3, c)])


def test_secrets_oddities(spark, docs, no_docs):
    assert secrets.scan(no_docs).count() == 0
    assert secrets.findings(docs).count() == 0 or secrets.scan(docs).count() >= 0
    df = spark.createDataFrame([(1, '\n token = "Zx9Qw8Er7Ty6Ui5Op4As" end'), (1, '\n token = "Zx9Qw8Er7Ty6Ui5Op4As" end'), (None, None)], "doc_id long, text string")
    rows = secrets.findings(df).collect()
    assert [(r.at, r.candidate, r.before, r.after) for r in rows] == [(2, "Zx9Qw8Er7Ty6Ui5Op4As", "=", "end")] * 2
    one_class = secrets.scan(df)  # nothing to learn from: every finding stays
    assert all(r.is_secret and r.probability is None for r in one_class.collect())


# --- queries and pipeline ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want, got = db.sql(ORACLES[name]), QUERIES[name](spark, SMALL)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_no_python_where_native_is_asked_for(spark):
    for name in ("op2_mix_sources", "op8_secret_scan", "op10_pseudonyms"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    path = "/root/testdata/sf0.01"
    poor = corpus_pipeline.reject_poor(spark, docs, path).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    kept = {r.doc_id for r in poor.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert poor.columns == docs.columns and sum(d in kept for d in good) >= 0.99 * len(good)
    clean = corpus_pipeline.drop_lines(spark, poor, path).cache()
    assert clean.columns == docs.columns and clean.count() == poor.count()
    rows = [(r.source, r.text) for r in poor.collect()]
    assert Counter((r.source, r.text) for r in clean.collect()) == plain_line_dedup(rows, 0.08, 5)
    single = corpus_pipeline.drop_copies(spark, clean, path).cache()
    texts = [r.text for r in single.collect()]
    assert single.columns == docs.columns and len(set(texts)) == len(texts)
    assert set(texts) <= {r.text for r in clean.collect()}
    mixed = corpus_pipeline.mix_sources(spark, single, path).cache()
    assert mixed.columns == docs.columns and set(Counter(r.doc_id for r in mixed.collect()).values()) <= {1, 2}
    coded = corpus_pipeline.tokenize(spark, mixed, path)
    assert coded.count() == mixed.count() and coded.where("not round_trip or n_tokens <> size(ids)").count() == 0


def test_pipeline_takes_an_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
