"""Near-dedup of texts and vectors, sketches, components."""

import math
import random

import numpy as np
import pytest
import xxhash
from samples import docs, no_docs, prose  # noqa: F401

from tidebarge.llm import embeddings, graph, jaccard, simhash, sketch
from tidebarge.llm.queries import QUERIES


def reach(nodes, linked):
    """Smallest node reachable, by brute force."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        if a == b:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == reach({x for a, b in edges if a != b for x in (a, b)}, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_small_graph_takes_few_tasks(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)], "a long, b long"))
        assert got.count() == 60 and got.where("node <> component").rdd.getNumPartitions() <= 64 + graph.LEAST_SLICES
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_by_the_letter():
    for text in ("", " \n", "One", "one two three", prose(5, 40), "A b C d E f A b C d", "Ünï Cödé Wörds hërë Ä"):
        assert simhash.fingerprint_bytes(text.encode(), 4, 42)[0] % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_links_of_fingerprints_are_all_found(spark, bits):
    r = random.Random(bits)
    fps = set()
    for _ in range(12):
        seed = r.getrandbits(64)
        for _ in range(12):
            x = seed
            for _ in range(r.randrange(bits + 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x - 2**64 if x >> 63 else x)
    fps = sorted(fps | {0, -1})
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= bits]
    got = {x.fp: x.group for x in simhash.link_groups(spark.createDataFrame([(f,) for f in fps + fps[:5]], "fp long"), simhash.exact_cut(bits)).collect()}
    assert got == reach(fps, links)


def test_documents_with_every_oddity(docs, no_docs):
    rows = simhash.link_documents(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(plain_fingerprint(r.text), []).append(r.doc_id)
    low = {f: min([i for i in ids if i is not None], default=None) for f, ids in by_text.items()}
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == sorted((str(r.doc_id), low[plain_fingerprint(r.text)]) for r in docs.collect())
    assert simhash.link_documents(no_docs).count() == 0


def test_one_of_each_group_stays(spark, docs, no_docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 6, 7, 9, None]))
    assert simhash.keep_one(no_docs).count() == 0


def test_wide_fingerprints_catch_near_copies_and_leave_others(spark):
    base = [prose(s, 150) for s in range(20, 40)]
    near = [t.replace(t.split()[70], "changed", 1) for t in base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + near)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df, shingle=5, cut=simhash.wide_cut()).collect()}
    assert kept >= set(range(20)) and len(kept) <= 22


def edited_texts():
    """Groups of texts with a few words changed, so that similarities lie on both sides of 0.8."""
    r = random.Random(11)
    texts = []
    for group in range(12):
        words = prose(100 + group, r.choice((12, 40, 150))).split()
        for _ in range(8):
            some = list(words)
            for _ in range(r.randrange(1 + len(words) // 30 + 1)):
                some[r.randrange(len(some))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(some))
    return texts + [t + " " + prose(5, 60) for t in (prose(s, 20) for s in range(300, 320))]  # a common passage


def near_pairs(texts, least=0.8, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.lower().split() for t in texts)]
    return [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]


def family(n=60):
    """Edits of one text that are near copies of some of each other only, and outsiders that share a part of it."""
    r = random.Random(5)
    words = prose(77, 70).split()
    out = []
    for i in range(n):
        some = list(words)
        for _ in range(r.choice((1, 1, 2, 6))):
            some[r.randrange(len(some))] = f"edit{i}x{r.randrange(10**6)}"
        out.append(" ".join(some))
    return out + [" ".join(words[:50]) + " " + prose(900 + i, 15) for i in range(20)]


@pytest.mark.parametrize("common, few, open_pairs, block, cast", [(2, 64, 8, 1 << 19, 10**6), (10**6, 2, 0, 900, 1), (2, 2, 0, 1 << 19, 1), (2, 2, 10**9, 300, 10**6)])
def test_jaccard_copies_against_brute_force(spark, monkeypatch, common, few, open_pairs, block, cast):
    """Every way of meeting: common hashes or none, turns over random members or none, one block or many, tables broadcast or not."""
    for name, value in (("COMMON_DOCS", common), ("FEW", few), ("OPEN_PAIRS", open_pairs), ("BLOCK_HASHES", block), ("BROADCAST_ROWS", cast)):
        monkeypatch.setattr(jaccard, name, value)
    texts = edited_texts() + family()
    pairs = near_pairs(texts)
    comp = reach(range(len(texts)), pairs)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in jaccard.keep_one(df, shingle=5, least=0.8).collect()}
    assert len(pairs) > 50 and kept == {i for i in comp if comp[i] == i}


def test_pipeline_copies_are_those_of_simhash(spark, docs):
    """The stage keeps one text of each component of fingerprints within four bits, and no row for its id alone."""
    import corpus_pipeline

    texts = edited_texts() + family()
    fps = [plain_fingerprint(t, 5) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (fps[a] ^ fps[b]).bit_count() <= 4]
    comp = reach(range(len(texts)), links)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()}
    assert len(links) > 5 and kept == {i for i in comp if comp[i] == i}
    rows = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 3, 4, 6, 7, 7, 9, None]))


def test_rows_with_one_id_and_different_texts_stay(spark, docs, no_docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id == 7) == [("7", "one"), ("7", "two words")]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 6, 7, 7, 9, None]))
    assert jaccard.keep_one(no_docs).count() == 0


def vectors(seed=3, n=400, dim=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[50:90] = x[10] + 0.12 * r.normal(size=(40, dim))  # a dense group
    x[90:120] = x[11]  # copies
    x[120:150] = x[120] * r.uniform(0.5, 3, size=(30, 1))
    return x


@pytest.mark.parametrize("centres", [1, 12])
def test_vectors_against_brute_force(spark, monkeypatch, centres):
    monkeypatch.setattr(embeddings, "centres_for", lambda n: centres)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    x = vectors()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), "kept") for i, v in enumerate(x)]
    odd = [(1000, None, "x"), (1001, [0.0] * 24, "x"), (1002, [math.nan] + [1.0] * 23, "x"), (1003, [None] + [1.0] * 23, "x"), (1004, [], "x"), (None, x[10].tolist(), "x"), (1005, [1.0, 2.0], "x"), (1006, [2.0, 4.0], "x")]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>, kept string")
    out = embeddings.dedup(df)
    assert out.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    comp = reach(range(400), list(zip(*np.nonzero(near))))
    assert all(got[i] == (int(near[i].sum()), comp[i], comp[i] == i) for i in range(400))
    assert all(got[i] == (0, i, True) for i in range(1000, 1005)) and got[None] == (0, None, True)
    assert got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)
    assert out.count() == len(rows) + len(odd) + 3


@pytest.mark.parametrize("centres", [1, 12])
def test_components_of_chains_and_sparse_groups(spark, monkeypatch, centres):
    monkeypatch.setattr(embeddings, "centres_for", lambda n: centres)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    r = np.random.default_rng(5)
    turns = np.radians(np.arange(60) * 4.0 + (np.arange(60) // 15) * 26)  # four chains on a circle
    chains = np.zeros((60, 8))
    chains[:, 0], chains[:, 1] = np.cos(turns), np.sin(turns)
    middles = r.normal(size=(5, 8))
    groups = (middles / np.linalg.norm(middles, axis=1)[:, None])[r.integers(0, 5, 240)] + 0.1 * r.normal(size=(240, 8))
    x = np.concatenate((chains, groups))
    ids = r.permutation(300).tolist()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = reach(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    out = embeddings.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"))
    assert {v.vec_id: (v.n_links, v.component_id, v.kept) for v in out.collect()} == {
        i: (int(near[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids)
    }


def test_chain_of_four_vectors(spark):
    rows = [(i, [math.cos(math.radians(t)), math.sin(math.radians(t))]) for i, t in ((1, 0), (4, 15), (3, 30), (2, 45))]
    out = embeddings.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: (r.component_id, r.kept) for r in out.collect()} == {1: (1, True), 2: (1, False), 3: (1, False), 4: (1, False)}


def test_no_vectors(spark):
    assert embeddings.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sketch_estimates():
    a, b = prose(1, 3000), prose(1, 3000)[:9000] + prose(2, 1500)
    shingles = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    x, y = shingles(a), shingles(b)
    sa, sb = sketch.sketch(a), sketch.sketch(b)
    assert abs(sketch.likeness(sa, sb) - len(x & y) / len(x | y)) < 0.08
    assert abs(sketch.containment(sketch.sketch(a[:3000]), sa) - 1) < 1e-9  # very unequal lengths
    joined = sketch.merge(sa, sb)
    assert sketch.likeness(joined, sketch.sketch(a)) > sketch.likeness(sa, sb)
    for t in ("", "x", "short one", a):
        s = sketch.from_text(sketch.to_text(sketch.sketch(t)))
        assert s[0] == sketch.sketch(t)[0] and (s[1] == sketch.sketch(t)[1]).all()
    assert sketch.likeness(sketch.sketch(""), sketch.sketch("")) == 1 and sketch.likeness(sketch.sketch(""), sketch.sketch("a")) == 0
    assert sketch.likeness(sketch.sketch("tiny text"), sketch.sketch("tiny texts")) == 2 / 3  # few shingles are compared exactly


def test_sketch_does_not_depend_on_blocks():
    t = prose(9, 60_000)
    points = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = np.unique(sketch._hashes(points))
    assert (sketch.sketch(t)[1] == h[h <= sketch._LIMIT]).all()


def test_edited_pairs(spark, docs, no_docs):
    import hashlib

    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_chars, r.edited_sha256) for r in sketch.edited_pairs(docs).collect())
    rows = sorted(((r.doc_id if r.doc_id is not None else 99, r.text or "") for r in docs.collect()))
    want = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)
    assert sketch.edited_pairs(no_docs).count() == 0
    assert sketch.edited_pairs(docs.where("doc_id is null")).count() == 2
    one = sketch.edited_pairs(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.doc_id == 1


def test_queries_at_small_scale(spark):
    rows = QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in rows} == reach(ids, links)
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    for r in QUERIES["op1_embedding_dedup"](spark, "/root/testdata/sf0.001").collect():
        v = x[r.vec_id] / np.linalg.norm(x[r.vec_id])
        assert r.n_links == sum(1 for k, w in x.items() if k != r.vec_id and v @ w / np.linalg.norm(w) >= 0.95)
    near = QUERIES["op5_sketch"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(near) == len(texts) and near.near_edited.mean() > 0.5 > 0.1 > near.near_next.median()
