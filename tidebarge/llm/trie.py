"""Prefix trie of conversations.

A node is a distinct sequence of first turns, its members are the conversations that begin with it. What the
conversations share can be stored (or computed) once: the turns of a node are spent ``members - 1`` times too often.

*Fixed-length block hashing.* A prefix is named by 128 bits that combine the turns' digests with their positions.
Conversations are cut into blocks of ``block`` turns and grouped by the block's end and the prefix before it: one row
per conversation and block is shuffled, and equal blocks are one row before they are. Only where a prefix is followed
by several different blocks do siblings diverge; only there the distinct blocks are taken apart into turns and grouped
again. Elsewhere the turns of a block are nodes as they stand.

*Chains instead of levels.* A node is named by its smallest member and its depth. The members of a node only get
fewer further down, so the nodes of one smallest member are one piece of its conversation, from some depth to its end.
Subtree sums therefore need no pass per level: every piece adds its sum once to each piece it hangs below (at most one
entry per turn that it shares), and a running sum along each piece does the rest.

Defined results: conversations without an id are left out, roles and texts that are null are empty. Turns of one
conversation go by ``turn`` (null first), then by the digest of role and text; repeated rows are turns of their own.
An empty table has no node, a conversation without turns is a member of the root only. Very long conversations are
summed up in segments of ``SEGMENT`` turns, so no window holds more. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import with_group_position
from .base import cut_lineage, shuffle_width

BLOCK = 4
#: Turns that one window sums up; a multiple of every block length in use.
SEGMENT = 1024
#: Ids that are joined into one piece of text for a node's digest.
IDS = 16_384


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, digest, bytes)``: the turns of each conversation by their 1-based place, without their texts."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    named = F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")
    digest = F.unhex(F.substring(F.sha2(named, 256), 1, 32))
    narrow = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
        F.octet_length(said).cast("long").alias("bytes"),
    ).where("conv_id is not null")
    placed = with_group_position(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "pos")
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "bytes")


def with_shared_heads(turns: DataFrame, ids: DataFrame, heads: int = 9, spread: int = 5) -> DataFrame:
    """Conversations whose first turns are those of another one, as if they had branched off it.

    Conversation c takes the first h turns of conversation ``c - c % spread`` (all if fewer, none if absent) and goes on
    with its own turns after its first h; h is the crc32 of the decimal id modulo ``heads``.
    """
    most = heads - 1
    base = turns.where((F.col("conv_id") % spread == 0) & (F.col("pos") <= most))
    lent = base.groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("pos", "digest", "bytes")).alias("lent"))  # ``most`` at most
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % spread).alias("base")).join(lent, "base", "left")
    convs = convs.select("conv_id", "h", F.filter("lent", lambda t: t["pos"] <= F.col("h")).alias("lent"))
    first = convs.select("conv_id", F.inline("lent"))
    moved = convs.select(F.col("conv_id").alias("c"), "h", F.coalesce(F.greatest(F.size("lent"), F.lit(0)), F.lit(0)).alias("n"))
    own = turns.join(moved, F.col("conv_id") == F.col("c")).where("pos > h")
    return first.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "digest", "bytes"))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """A row per conversation and block: prefix before it (p1, p2), prefix after each of its turns, and bytes of that turn."""
    rows = turns.select(
        "conv_id", "pos", "bytes", F.xxhash64("pos", "digest").alias("l1"), F.xxhash64(F.lit("second lane"), "digest", "pos").alias("l2"),
        F.floor((F.col("pos") - 1) / SEGMENT).alias("seg"),
    )
    along = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x1", F.bit_xor("l1").over(along)).withColumn("x2", F.bit_xor("l2").over(along))
    turn = F.struct("pos", "x1", "x2", "bytes")
    made = rows.groupBy("conv_id", "seg", F.floor((F.col("pos") - 1) / block).alias("j")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),  # ``block`` turns at most
        F.min_by(F.col("x1").bitwiseXOR(F.col("l1")), "pos").alias("p1"), F.min_by(F.col("x2").bitwiseXOR(F.col("l2")), "pos").alias("p2"),
    )
    made = cut_lineage(made.withColumn("end", F.element_at("turns", -1)))
    # a segment starts from the prefixes of those before it
    full = made.where(F.col("end.pos") % SEGMENT == 0).select("conv_id", "seg", "end.x1", "end.x2")
    if full.isEmpty():
        return made.select("conv_id", "j", "p1", "p2", "end.x1", "end.x2", "turns")
    until = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    before = full.select(
        F.col("conv_id").alias("c"), (F.col("seg") + 1).alias("s"), F.bit_xor("x1").over(until).alias("y1"), F.bit_xor("x2").over(until).alias("y2")
    )
    both = made.join(before, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s")), "left")
    y1, y2 = F.coalesce("y1", F.lit(0).cast("long")), F.coalesce("y2", F.lit(0).cast("long"))
    shifted = F.transform("turns", lambda t: F.struct(
        t["pos"].alias("pos"), t["x1"].bitwiseXOR(F.col("y1")).alias("x1"), t["x2"].bitwiseXOR(F.col("y2")).alias("x2"), t["bytes"].alias("bytes")
    ))
    out = both.withColumn("y1", y1).withColumn("y2", y2).select(
        "conv_id", "j", F.col("p1").bitwiseXOR(F.col("y1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("y2")).alias("p2"),
        F.col("end.x1").bitwiseXOR(F.col("y1")).alias("x1"), F.col("end.x2").bitwiseXOR(F.col("y2")).alias("x2"), shifted.alias("turns"),
    )
    return cut_lineage(out)


def _nodes(blocks: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(x1, x2, depth, owner, n, bytes)`` of every node but the root; ``owner`` is its smallest member."""
    split = distinct.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count(F.lit(1)).alias("siblings")).where("siblings > 1")
    marked = distinct.join(split, (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2")), "left")
    turns = cut_lineage(marked.select("owner", "n", F.col("siblings").isNotNull().alias("split"), F.inline("turns")))
    alone = turns.where("not split").select("x1", "x2", F.col("pos").alias("depth"), "owner", "n", "bytes")
    refined = turns.where("split").groupBy("x1", "x2").agg(
        F.min("pos").alias("depth"), F.min("owner").alias("owner"), F.sum("n").alias("n"), F.min("bytes").alias("bytes")
    )
    return alone.unionByName(refined)


def _runs(blocks: DataFrame, distinct: DataFrame, nodes: DataFrame, chains: DataFrame, first: int, block: int) -> DataFrame:
    """``(conv, a, o, e)``: on the way to the piece of ``conv``, which starts at depth ``a``, depth ``e`` is the last of the piece of ``o``."""
    top = F.floor((F.col("a") - 1) / block)
    way = blocks.join(chains.where("a > 0").select(F.col("owner").alias("c"), "a"), F.col("conv_id") == F.col("c")).where(F.col("j") <= top)
    ends = distinct.select(F.col("x1").alias("d1"), F.col("x2").alias("d2"), F.col("owner").alias("ended"))
    inner = way.where(F.col("j") < top).join(ends, (F.col("x1") == F.col("d1")) & (F.col("x2") == F.col("d2"))).drop("d1", "d2")
    way = inner.unionByName(way.where(F.col("j") == top).withColumn("ended", F.col("conv_id")))
    along = Window.partitionBy("conv_id").orderBy("j")
    way = cut_lineage(way.select("conv_id", "a", "j", "ended", F.lag("ended", 1, first).over(along).alias("began"), "turns"))
    same = way.where("began = ended").select("conv_id", "a", F.col("ended").alias("o"), ((F.col("j") + 1) * block).alias("e"))
    names = nodes.select(F.col("x1").alias("n1"), F.col("x2").alias("n2"), F.col("owner").alias("o"))
    parts = way.where("began <> ended").select("conv_id", "a", F.inline("turns")).where("pos < a")
    changed = parts.join(names, (F.col("x1") == F.col("n1")) & (F.col("x2") == F.col("n2"))).select("conv_id", "a", "o", F.col("pos").alias("e"))
    root = chains.where("a > 0").select(F.col("owner").alias("conv_id"), "a", F.lit(first).cast("long").alias("o"), F.lit(0).cast("long").alias("e"))
    every = same.unionByName(changed).unionByName(root).where("o <> conv_id")
    return every.groupBy(F.col("conv_id").alias("conv"), "a", "o").agg(F.max("e").alias("e"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x1, x2, conv_id) to pieces of comma-joined ids; a piece never spans two nodes."""
    here, ids = None, []
    schema = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("joined", pa.string())])
    for batch in batches:
        out = []
        for x1, x2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (x1, x2) != here or len(ids) == IDS:
                if ids:
                    out.append((*here, ids[0], ",".join(map(str, ids))))
                here, ids = (x1, x2), []
            ids.append(conv)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if ids:
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*here, ids[0], ",".join(map(str, ids))), schema)], schema=schema)


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to a digest per node; the digest is a running one, no list of ids is held."""
    here, running = None, None
    schema = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for x1, x2, _, joined in zip(*(c.to_pylist() for c in batch.columns)):
            if (x1, x2) == here:
                running.update(b",")
            else:
                if here:
                    out.append((*here, running.hexdigest()))
                here, running = (x1, x2), hashlib.sha256()
            running.update(joined.encode())
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if here:
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*here, running.hexdigest()), schema)], schema=schema)


def _ends(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Digest of the ids that end at each node, by the node's ``(x1, x2)``.

    The ids of a node are joined in pieces, in all tasks; the digest, sequential by its nature, reads a row per piece.
    """
    width = shuffle_width(blocks.sparkSession)
    last = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.max_by(F.struct("x1", "x2"), "j").alias("x"))
    zero = F.lit(0).cast("long")
    ends = ids.join(last, F.col("conv_id") == F.col("c"), "left").select(
        F.coalesce("x.x1", zero).alias("x1"), F.coalesce("x.x2", zero).alias("x2"), "conv_id"
    )
    ends = cut_lineage(ends).repartitionByRange(width, "x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
    pieces = ends.mapInArrow(_joined_ids, "x1 long, x2 long, first long, joined string")
    pieces = pieces.repartition(width, "x1", "x2").sortWithinPartitions("x1", "x2", "first")
    return pieces.mapInArrow(_hashed_ids, "x1 long, x2 long, ends_sha256 string")


def _summed_below(nodes: DataFrame, *values: str) -> DataFrame:
    """Replace values by their sums from the node to the end of its piece (``owner``), whatever its length."""
    rows = nodes.withColumn("seg", F.floor(F.col("depth") / SEGMENT))
    below = Window.partitionBy("owner", "seg").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut_lineage(rows.withColumns({v: F.sum(v).over(below) for v in values}))
    whole = rows.where((F.col("depth") % SEGMENT == 0) & (F.col("depth") > 0))
    if whole.isEmpty():
        return rows.drop("seg")
    down = Window.partitionBy("owner").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = whole.select(F.col("owner").alias("w"), (F.col("seg") - 1).alias("s"), *[F.sum(v).over(down).alias(f"after_{v}") for v in values])
    both = rows.join(after, (F.col("owner") == F.col("w")) & (F.col("seg") == F.col("s")), "left")
    total = {v: F.col(v) + F.coalesce(F.col(f"after_{v}"), F.lit(0).cast("long")) for v in values}
    return both.withColumns(total).drop("seg", "w", "s", *[f"after_{v}" for v in values])


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie over ``turns`` (see :func:`turn_rows`) of the conversations ``ids`` (``conv_id``, distinct).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of
    the last text, once per member but one, over the subtree) and ends_sha256.
    """
    if SEGMENT % block:
        raise ValueError(f"blocks of {block} turns do not fill segments of {SEGMENT}")
    ids = cut_lineage(ids.select(F.col("conv_id").cast("long").alias("conv_id")))
    first, members = ids.agg(F.min("conv_id"), F.count("conv_id")).first()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if first is None:
        return ids.sparkSession.createDataFrame([], out)
    blocks = _blocks(turns, block)
    distinct = cut_lineage(blocks.groupBy("p1", "p2", "x1", "x2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), F.any_value("turns").alias("turns")
    ))
    zero = F.lit(0).cast("long")
    root = ids.sparkSession.range(1).select(
        zero.alias("x1"), zero.alias("x2"), zero.alias("depth"), F.lit(first).cast("long").alias("owner"),
        F.lit(members).cast("long").alias("n"), zero.alias("bytes"),
    )
    nodes = cut_lineage(_nodes(blocks, distinct).unionByName(root))
    spent = (F.col("n") - 1) * F.col("bytes")
    chains = cut_lineage(nodes.groupBy("owner").agg(F.min("depth").alias("a"), F.max("depth").alias("z"), F.sum(spent).alias("spent")))
    runs = cut_lineage(_runs(blocks, distinct, nodes, chains, first, block))

    direct = runs.where("e = a - 1")
    kids = direct.groupBy(F.col("o").alias("k_o"), F.col("e").alias("k_e")).agg(F.count(F.lit(1)).alias("kids"))
    shape = chains.select(F.col("owner").alias("c_o"), "a", "z", "spent").join(
        direct.select(F.col("conv").alias("c_o"), F.col("o").alias("above")), "c_o", "left"
    )
    same: Column = (F.col("owner") == F.col("k_o")) & (F.col("depth") == F.col("k_e"))
    rows = nodes.join(shape, F.col("owner") == F.col("c_o")).join(kids, same, "left")
    children = F.coalesce("kids", zero) + F.when(F.col("depth") < F.col("z"), 1).otherwise(0)
    parent = F.when(F.col("depth") > F.col("a"), F.col("owner")).otherwise(F.col("above"))
    rows = cut_lineage(rows.select(
        "x1", "x2", "owner", "depth", "n", "z", "spent", parent.alias("parent"), children.cast("long").alias("children"), spent.alias("own")
    ))
    # every piece adds what it holds to all pieces that it hangs below
    pieces = rows.where("depth = z").select(F.col("owner").alias("q"), "spent", (F.col("children") == 0).cast("long").alias("leaf"))
    given = runs.join(pieces, F.col("conv") == F.col("q")).groupBy(F.col("o").alias("g_o"), F.col("e").alias("g_e")).agg(
        F.sum("spent").alias("g_spent"), F.sum("leaf").alias("g_leaf")
    )
    rows = rows.join(given, (F.col("owner") == F.col("g_o")) & (F.col("depth") == F.col("g_e")), "left").select(
        "x1", "x2", "owner", "depth", "n", "parent", "children", (F.col("own") + F.coalesce("g_spent", zero)).alias("saved"),
        ((F.col("children") == 0).cast("long") + F.coalesce("g_leaf", zero)).alias("leaves"),
    )
    rows = _summed_below(rows, "saved", "leaves")
    digests = _ends(blocks, ids).select(F.col("x1").alias("e1"), F.col("x2").alias("e2"), "ends_sha256")
    rows = rows.join(digests, (F.col("x1") == F.col("e1")) & (F.col("x2") == F.col("e2")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK, heads: int = 0, spread: int = 5, **names: str) -> DataFrame:
    """The trie of a table of turns; with ``heads``, of the conversations rebuilt by :func:`with_shared_heads`."""
    turns = turn_rows(conversations, **names)
    conv = F.col(f"`{names.get('conv_id', 'conv_id')}`").cast("long")
    ids = conversations.select(conv.alias("conv_id")).where("conv_id is not null").distinct()
    if heads:
        ids = cut_lineage(ids)
        turns = with_shared_heads(turns, ids, heads, spread)
    return prefix_trie(turns, ids, block)
