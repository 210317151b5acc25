"""Trie of the prefixes of conversations, with sums over subtrees by heavy paths.

A prefix has a number of 128 bits: the exclusive or of numbers of (position, turn), so that prefixes are
running values which can be made in blocks and a conversation of any length is split. Nodes are the
distinct numbers. A node's largest child (by members) continues its path, other children begin
paths of their own, light ones; a light child has at most half its parent's members, so no node has
more than log2(conversations) light steps above it. A conversation passes the nodes of its
prefixes in order: the head of a node's path is the last light node on the way to it and its
level the number of light nodes, both running values too. Sums over subtrees are suffix sums
along each path, level after level from the deepest; the totals of the paths of a level are added
to the parents of their heads before the level above is summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.numbering import crc32_sql, numbered, width

BLOCK = 4096
#: Ids in a piece of the text that ends_sha256 is made of.
PIECE = 2048
NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]


def running(df: DataFrame, group: list[str], at: str, want: dict, down: bool = False) -> DataFrame:
    """df with running values (name=(aggregate, column, merge)) along at (upwards, or down) in each group.

    at counts without gaps. Rows are taken in blocks of BLOCK positions; full blocks pass their value
    on, so a long group is many tasks' work.
    """
    rows = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    w = Window.partitionBy(*group, "_block").orderBy(F.col(at).desc() if down else F.col(at).asc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({name: how(c).over(w) for name, (how, c, _) in want.items()})
    ends = rows.where(F.col(at) % BLOCK == (0 if down else BLOCK - 1))
    ends = ends.select(*(F.col(g).alias(f"_{g}") for g in group), (F.col("_block") + (-1 if down else 1)).alias("_next"), *(F.col(name).alias(f"_{name}") for name in want))
    order = F.col("_next").desc() if down else F.col("_next").asc()
    over = Window.partitionBy(*(f"_{g}" for g in group)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.withColumns({f"_{name}": how(f"_{name}").over(over) for name, (how, _, _) in want.items()})
    on = [F.col(g) == F.col(f"_{g}") for g in group] + [F.col("_block") == F.col("_next")]
    rows = rows.join(carry, on, "left")
    rows = rows.withColumns({name: F.when(F.col(f"_{name}").isNull(), F.col(name)).when(F.col(name).isNull(), F.col(f"_{name}")).otherwise(merge(F.col(name), F.col(f"_{name}"))) for name, (_, _, merge) in want.items()})
    return rows.select(*df.columns, *want)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def turns(scratch: store.Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, pos (from 0), dig (of role and text), chars of every turn; conv_id, n of every conversation.

    Rows are taken by turn (null first; ties by role, then text); a null role or text becomes empty;
    rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    dig = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("_g"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), dig.alias("dig"), F.length(text).cast("long").alias("chars"))
    rows = numbered(scratch, "turns", rows.where("_g is not null"), ["turn", "role", "text"], [F.col("turn"), F.substring("role", 1, 16), F.substring("text", 1, 32)], ["dig", "chars"])
    rows = rows.select(F.col("_g").alias("conv_id"), F.col("_pos").alias("pos"), "dig", "chars")
    return rows, scratch.put(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")


def trie(scratch: store.Scratch, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of sequences: rows (conv_id, pos, n, dig, chars), n being the sequence's length, and ids (conv_id, n) of all, also of empty ones.

    For each node conv_id (its smallest member, whose first depth turns it is), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and level: the light nodes above and at it.
    """
    own = lambda seed: F.xxhash64(F.lit(seed), "pos", "dig")
    r = running(rows.withColumn("_o1", own(1)).withColumn("_o2", own(2)), ["conv_id"], "pos", {"k1": (F.bit_xor, "_o1", _xor), "k2": (F.bit_xor, "_o2", _xor)})
    r = r.select("conv_id", "pos", "k1", "k2", _xor(F.col("k1"), F.col("_o1")).alias("u1"), _xor(F.col("k2"), F.col("_o2")).alias("u2"), "chars", (F.col("pos") + 1 == F.col("n")).alias("ends"))
    r = scratch.put(r, "prefixes")
    nodes = r.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), (F.max("pos") + 1).alias("depth"), F.max("u1").alias("u1"), F.max("u2").alias("u2"), F.max("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"), zero.alias("chars"))
    nodes = scratch.put(nodes.unionByName(top), "nodes")

    kids = nodes.where("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "k1", "k2")).alias("h"))
    nodes = scratch.put(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "families")
    above = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), F.col("h.k1").alias("h1"), F.col("h.k2").alias("h2"))
    light = ~((F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    nodes = nodes.drop("h").join(above, ["u1", "u2"], "left").withColumn("light", F.coalesce(light, F.lit(False))).drop("h1", "h2")
    nodes = scratch.put(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "linked")

    passed = r.select("conv_id", "pos", *KEY).join(nodes.where("depth > 0").select(*KEY, F.col("conv_id").alias("_rep"), "light"), KEY)
    passed = passed.withColumn("_l", F.col("light").cast("long")).withColumn("_h", F.when(F.col("light"), F.struct("pos", *KEY)))
    passed = running(passed, ["conv_id"], "pos", {"level": (F.sum, "_l", _plus), "head": (F.max, "_h", F.greatest)}).where("conv_id = _rep")
    placed = passed.select(*KEY, "level", F.coalesce("head.k1", zero).alias("p1"), F.coalesce("head.k2", zero).alias("p2"))
    placed = nodes.join(placed, KEY, "left").select(*KEY, "u1", "u2", "depth", F.coalesce("level", zero).alias("level"), F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    placed = scratch.put(placed, "paths", by="level")

    sums, come = [], None
    for level in range(placed.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = placed.where(F.col("level") == level)
        if come is not None:
            here = here.join(come, KEY, "left").withColumn("leaf", F.col("leaf") + F.coalesce("_leaf", zero)).withColumn("saved", F.col("saved") + F.coalesce("_saved", zero))
        along = running(here, ["p1", "p2"], "depth", {"n_leaves": (F.sum, "leaf", _plus), "saved_tokens": (F.sum, "saved", _plus)}, down=True)
        along = scratch.put(along.select(*KEY, "u1", "u2", "level", "n_leaves", "saved_tokens", ((F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))).alias("_first")), f"sums-{level}")
        sums.append(along)
        come = along.where("_first").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("n_leaves").alias("_leaf"), F.sum("saved_tokens").alias("_saved"))
    total = sums[0]
    for s in sums[1:]:
        total = total.unionByName(s)
    told = digests(scratch, r.where("ends").select(*KEY, "conv_id").unionByName(ids.where("n = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")))
    out = nodes.join(total.select(*KEY, "level", "n_leaves", "saved_tokens"), KEY).join(told, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"), "level")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (k1, k2, conv_id): pieces of the comma-joined ids of each key, at most PIECE ids long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, c = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        edges = np.unique(np.concatenate([[0, len(c)], cut, np.arange(0, len(c), PIECE)]))
        told = list(map(str, c.tolist()))
        texts = [",".join(told[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        at = edges[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(c[at]), pa.array(texts)], ["k1", "k2", "conv_id", "piece"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, h = None, None
    for batch in batches:
        out = []
        for *k, piece in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "piece")), strict=True):
            if k != key:
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield _digests(out)
    if key:
        yield _digests([(*key, h.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "sha"])


def digests(scratch: store.Scratch, ends: DataFrame) -> DataFrame:
    """k1, k2, sha: SHA-256 of the ascending, comma-joined ids of ends (k1, k2, conv_id).

    Ids are sorted by range partitions and joined in pieces there, also those of a hot node; one task
    only hashes a node's pieces one after the other, as SHA-256 asks for, and holds one batch.
    """
    store.ship(scratch.spark)
    n = width(scratch.spark)
    rows = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, "k1 long, k2 long, conv_id long, piece string")
    return rows.repartition(n, *KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(_hash, "k1 long, k2 long, sha string")


def prefixes(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; columns as in trie().

    Defined cases: rows are taken by turn (null first), equal ones by role, then text; a null role or
    text becomes empty; repeated rows are turns of their own; rows without conv_id are ignored; a very
    long text counts by its digest; an empty table gives no node, else there is a root; other
    columns, also of clashing names, are ignored.
    """
    scratch = store.Scratch(spark, "trie")
    rows, sizes = turns(scratch, conversations.select("conv_id", "turn", "role", "text"))
    return trie(scratch, rows.join(sizes, "conv_id"), sizes)


SHARED, HEADS = 100, 6


def rebuilt(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: conv_id c begins with the first h turns of c - c % 100 (h: crc32 of c, modulo 6), then has its own turns after its first h.

    Cases as for prefixes(); a conversation may end up without turns and is a member of the root only.
    """
    scratch = store.Scratch(spark, "trie")
    rows, sizes = turns(scratch, conversations.select("conv_id", "turn", "role", "text"))
    ids = sizes.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")).withColumn("_base", F.col("conv_id") - F.col("conv_id") % SHARED)
    heads = rows.where((F.col("conv_id") % SHARED == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("pos", "dig", "chars"))).alias("got"))
    ids = ids.join(heads, "_base", "left").withColumn("got", F.coalesce(F.expr("slice(got, 1, h)"), F.array().cast("array<struct<pos:bigint,dig:string,chars:bigint>>")))
    ids = ids.withColumn("shift", F.size("got").cast("long"))
    ids = scratch.put(ids.select("conv_id", "h", "got", "shift", (F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "ids")
    own = rows.join(ids.select("conv_id", "h", "shift", "n"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "n", "dig", "chars")
    lent = ids.select("conv_id", "n", F.inline("got")).select("conv_id", "pos", "n", "dig", "chars")
    return trie(scratch, own.unionByName(lent), ids.select("conv_id", "n"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(spark, store.table(spark, sf_dir, "conversations")).drop("level")


OP11_SQL = f"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM c),
r AS (
  SELECT i.conv_id, 0 AS part, b.pos, b.role, b.text FROM i JOIN c b ON b.conv_id = i.base AND b.pos < i.h
  UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM i JOIN c o ON o.conv_id = i.conv_id AND o.pos >= i.h),
n AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, md5(length(role) || ':' || role || text) AS d FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (
  SELECT conv_id, depth, chars, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, depth = count(*) OVER (PARTITION BY conv_id) AS last FROM n
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM n) FROM i),
v AS (
  SELECT k, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) * (count(*) - 1) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY k),
e AS (SELECT v.*, u.conv_id AS parent_conv_id, u.k AS above, (SELECT count(*) FROM v x WHERE x.depth = v.depth + 1 AND left(x.k, 32 * v.depth::INT) = v.k) AS n_children FROM v LEFT JOIN v u ON v.depth > 0 AND u.k = left(v.k, 32 * (v.depth - 1)::INT)),
f AS (SELECT left(k, 32 * unnest(range(depth + 1))::INT) AS k, saved, n_children FROM e),
s AS (SELECT k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM f GROUP BY k),
l AS (SELECT e.k, arg_max(x.k, (x.n_convs, x.k)) AS heavy FROM e JOIN e x ON x.above = e.k GROUP BY e.k)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM e JOIN s USING (k)
"""
