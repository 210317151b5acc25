import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import prefix_trie, store

KIND = "conv_id long, turn long, role string, text string, level int, k1 string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def rebuilt(of):
    out = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = of.get(base, [])[:h] + own[h:]
    return out


def brute(of):
    """The trie node by node."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(of):
        for d in range(len(of[c]) + 1):
            members[tuple(of[c][:d])].append(c)
        ends[tuple(of[c])].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def rows_of_nodes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*NAMES).collect())


def wild(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), 100, 105, 199, 203, -250, -200, -3]:
        for t in range(rng.choice([1, 2, 4, 9])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "é🙂", "b", "long " * 300]), 1, "x"))
    rows += [(7, 3, "user", "b", 1, "x")] * 3 + [(None, 1, "user", "b", 1, "x")]
    return rows


@pytest.mark.parametrize("block", [4096, 2])
def test_nodes_of_wild_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = wild(block)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert rows_of_nodes(prefix_trie.prefixes(spark, df)) == brute(sequences(rows))
    assert rows_of_nodes(prefix_trie.rebuilt(spark, df)) == brute(rebuilt(sequences(rows)))


def test_copies_a_long_conversation_and_a_comb(spark, monkeypatch):
    """One conversation of a third of all rows, a third of conversations alike, and light paths below light paths."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rows = [(c, t, "user", "same", 1, "x") for c in range(100) for t in range(4)] + [(500, t, "user", f"turn {t % 3}", 1, "x") for t in range(400)]
    rows += [(1000 + c, t, "user", "a" if (c >> t) & 1 else "b", 1, "x") for c in range(32) for t in range(5)]
    df = prefix_trie.prefixes(spark, spark.createDataFrame(rows, KIND).repartition(4))
    assert rows_of_nodes(df) == brute(sequences(rows))
    assert df.agg(F.max("level")).first()[0] <= 8


def test_no_conversations_no_nodes(spark):
    assert prefix_trie.prefixes(spark, spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie.rebuilt(spark, spark.createDataFrame([(None, 1, "a", "b", 1, "x")], KIND)).collect() == []


def test_running_values_do_not_depend_on_blocks(spark, monkeypatch):
    df = spark.range(50).selectExpr("id % 2 as g", "id div 2 as at", "id * 7 % 5 as v")
    want = {"s": (F.sum, "v", lambda a, b: a + b), "m": (F.max, "v", F.greatest)}
    got = {}
    for block in (4, 4096):
        monkeypatch.setattr(prefix_trie, "BLOCK", block)
        got[block] = [sorted(map(tuple, prefix_trie.running(df, ["g"], "at", want, down).collect())) for down in (False, True)]
    assert got[4] == got[4096] and store
