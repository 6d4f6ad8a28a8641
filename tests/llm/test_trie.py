import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidebarge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    """Turns of each conversation, as (role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0), d, (role, text)))
    return {c: [t[2] for t in sorted(ts)] for c, ts in turns.items()}


def rebuilt(convs, heads, spread):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % spread if c >= 0 else -(-c % spread))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below, children = defaultdict(list), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    rows = []
    for path, ids in members.items():
        ends = sorted(c for c in ids if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below[path])
        rows.append((
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path],
            sum(children[p] == 0 for p in below[path]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def talk(seed, convs=60, longest=13, words=2):
    """Conversations that share beginnings: few different turns, some repeated as a whole, some far longer."""
    r = random.Random(seed)
    rows = []
    for c in range(-9, convs):
        n = 45 if c % 17 == 0 else r.randrange(1, longest)
        same = random.Random(c % 7 if c % 3 else c)
        for t in range(n):
            rows.append((c, None if t == 0 and c % 4 == 0 else t, "user" if t % 2 else None, f"say é {same.randrange(words)}" if same.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("block, segment, ids", [(4, 1024, 10_000), (1, 4, 2), (3, 6, 1), (8, 8, 5)])
def test_against_plain(spark, monkeypatch, block, segment, ids):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "IDS", ids)
    rows = talk(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(trie.conversation_trie(df, block)) == plain(in_order(rows))


def test_shared_heads(spark):
    """Turnless conversations, absent bases and short bases among them."""
    rows = [r for r in talk(5, 40, 6) if r[0] % 10 != 5]
    want = rebuilt(in_order(rows), 9, 5)
    assert any(not t for t in want.values())
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), heads=9)) == plain(want)


def test_ties_repeats_nulls_and_names(spark):
    rows = [(1, 1, "a", "x"), (1, 1, "a", "x"), (1, 1, "b", "y"), (2, None, None, None), (2, None, "", ""), (None, 1, "a", "x"), (3, 1, "a", "x" * 1_500_000)]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], SCHEMA + ", pos int, __slice int, DIGEST int")
    assert got(trie.conversation_trie(df)) == plain(in_order(rows))
    other = df.toDF("c", "t", "r", "s", "conv_id", "turn", "text")
    assert got(trie.conversation_trie(other, conv_id="c", turn="t", role="r", text="s")) == plain(in_order(rows))


def test_one_conversation_many_times(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(700) for t in range(3)]
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(in_order(rows))


def test_empty(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA), heads=9).collect() == []
    with pytest.raises(ValueError):
        trie.conversation_trie(spark.createDataFrame([], SCHEMA), block=7)
