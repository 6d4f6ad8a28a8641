"""The operators of this subpackage bound to the given tables, and SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, lines, mixing, packing, privacy, quality, resample, secrets, shards, simhash, sketch, trie
from .base import prepare, table
from .checks import CRC_TABLE, crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    """Content of a rank file of the installed tokenizers; read on the driver and sent to the workers."""
    return Path(public_tokenizers.path(name)).read_bytes()


@query("op1_embedding_dedup")
def op1(spark, folder):
    """Links at cosine 0.95 and component of every vector."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return embeddings.dedup(rows).select("vec_id", "n_links", "component_id", "kept")


@query("op2_mix_sources")
def op2(spark, folder):
    """Words taken of every document."""
    taken = mixing.copies(table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op3_byte_bpe")
def op3(spark, folder):
    """Token count, digest of the ids and digest of the decoded bytes of every document."""
    ranks = rank_file()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids", "decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op4_line_dedup",
    """
    with d as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
    totals as (select source, count(*) as total from d group by source),
    seen as (
        select distinct doc_id, source, text, trim(unnest(ls)) as line from d
    ),
    counts as (select source, line, count(*) as pages from seen where line <> '' group by source, line),
    drops as (
        select c.source, c.line from counts c join totals t on c.source is not distinct from t.source
        where pages >= 5 and pages > total * 0.08::double
    ),
    lists as (select source, list(line) as bad from drops group by source)
    select d.doc_id, coalesce(len(ls), 0)::bigint as n_lines,
           coalesce(len(list_filter(ls, lambda x: list_contains(bad, trim(x)))), 0)::bigint as n_dropped,
           case when bad is null then text
                else array_to_string(list_filter(ls, lambda x: not list_contains(bad, trim(x))), chr(10)) end as text
    from d left join lists on d.source is not distinct from lists.source
    """,
)
def op4(spark, folder):
    """Documents without the lines that over 8 % of their source's documents hold (and 5 documents at least)."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    clean = lines.drop_boilerplate(docs, F.col("source"), lines="n_lines", dropped="n_dropped")
    return clean.select("doc_id", "n_lines", "n_dropped", "text")


@query("op5_sketch")
def op5(spark, folder):
    """Fingerprints of every document and of its edited text, and how alike it is to that and to the next document."""
    return sketch.edited_pairs(table(spark, folder, "documents"))


@query("op6_shards")
def op6(spark, folder):
    """Eight shards of near equal bytes; copies of a text share a shard."""
    placed = shards.shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_quality")
def op7(spark, folder):
    """Scores of both views and of their combination for every document, and whether it is kept."""
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model, views=True)
    return scored.select("doc_id", "text_score", "meta_score", "quality_score", quality.accepted(F.col("quality_score")).alias("keep"))


@query("op8_secret_scan")
def op8(spark, folder):
    """Every finding of the documents, by digest, with its probability of being a secret."""
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "at", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.col("length").cast("long").alias("length"),
        "dictionary", "entropy", "probability", "is_secret",
    )


@query("op9_simhash")
def op9(spark, folder):
    """Fingerprint and component of every document."""
    linked = simhash.link_documents(table(spark, folder, "documents"))
    return linked.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op10_pseudonyms")
def op10(spark, folder):
    """Every text with its personal values replaced, and how many there were."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return privacy.pseudonymise(docs, "example key, kept in a secret store elsewhere", replaced="n_replaced").select("doc_id", "n_replaced", "text")


@query(
    "op11_resample",
    f"""
    with {CRC_TABLE},
    d as (select row_number() over () as r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
    q as (select regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
    dw as (select r, unnest(ws) as w from d),
    qw as (select unnest(ws) as w from q),
    known as (select w, {crc32('w')} % 10000 as b from (select w from dw union select w from qw), crc_table),
    dn as (select b, count(*) as s from dw join known using (w) group by b),
    qn as (select b, count(*) as t from qw join known using (w) group by b),
    sums as (select (select count(*) from dw) as s_all, (select count(*) from qw) as t_all),
    gain as (
        select b, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::double
               / ((coalesce(s, 0) + 1) * (t_all + 10000))::double))::bigint as g
        from (select distinct b from known) left join dn using (b) left join qn using (b), sums
    ),
    sized as (select r, count(*)::bigint as n, sum(g) as total from dw join known using (w) join gain using (b) group by r),
    scored as (
        select d.r, doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(total / n), 0)::bigint as weight,
               floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
               / 4294967296::double)))::bigint as g
        from d left join sized using (r)
    ),
    able as (
        select r, row_number() over (order by weight + g desc, doc_id nulls last, n_features, weight, r) as rank
        from scored where n_features >= 20
    )
    select doc_id, n_features, weight, weight + g as score,
           case when rank <= 10 * (select count(*) from able) // 100 then rank end as rank
    from scored left join able using (r)
    """,
)
def op11(spark, folder):
    """Feature count, weight, score and rank of every document, drawn towards the benchmark's words."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = resample.scored(docs, table(spark, folder, "benchmark"))
    return resample.draw(scored, (10, 100)).select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_prefix_trie",
    f"""
    with {CRC_TABLE},
    said as (
        select conv_id, coalesce(text, '') as text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d,
               row_number() over (partition by conv_id order by turn nulls first, d) as pos
        from conversations where conv_id is not null
    ),
    ids as (
        select conv_id, conv_id - conv_id % 5 as base, ({crc32('conv_id::varchar')} % 9)::bigint as h
        from (select distinct conv_id from said), crc_table
    ),
    sizes as (select conv_id as base, count(*) as n from said group by conv_id),
    rebuilt as (
        select i.conv_id, pos, d, text from ids i join said s on s.conv_id = i.base and pos <= h
        union all
        select i.conv_id, pos - h + least(h, coalesce(n, 0)), d, text
        from ids i join said s on s.conv_id = i.conv_id and pos > h left join sizes z on z.base = i.base
    ),
    paths as (
        select conv_id, pos as depth, text, list(d) over (partition by conv_id order by pos) as path from rebuilt
        union all select conv_id, 0, '', []::varchar[] from ids
    ),
    nodes as (
        select path, depth, min(conv_id) as conv_id, count(*) as n_convs, strlen(any_value(text)) as bytes from paths group by path, depth
    ),
    kids as (select path[:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
    known as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (path)),
    sums as (
        select path[:d] as path, sum((n_convs - 1) * bytes) as saved_tokens, count(*) filter (n_children = 0) as n_leaves
        from (select *, unnest(range(depth + 1)) as d from known) group by 1
    ),
    ends as (
        select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
        from (select conv_id, max_by(path, depth) as path from paths group by conv_id) group by path
    )
    select k.conv_id, k.depth::bigint as depth, p.conv_id as parent_conv_id, k.n_convs::bigint as n_convs, k.n_children::bigint as n_children,
           n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
    from known k join sums using (path) left join ends using (path) left join known p on k.depth > 0 and p.path = k.path[:k.depth - 1]
    """,
)
def op12(spark, folder):
    """Every node of the prefix trie of the conversations, rebuilt with shared heads."""
    return trie.conversation_trie(table(spark, folder, "conversations"), heads=9, spread=5)


@query("op13_pack")
def op13(spark, folder):
    """Every piece of every document in sequences of 1024 tokens."""
    # the rank file holds the vocabulary of byte_bpe_50k.json; the tests compare their ids
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), rank_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
