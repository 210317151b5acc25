"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Links are given by hubs (documents of one hub are linked), so a group of copies costs a row a document
and no pairs. A round counts the labels of each hub, lets each document vote for the label that
most of its neighbours have (of those with room left, or its own; of equals one with room) and admits movers by hash
thresholds: movers are summed by target and hash bucket and the buckets that fit into a target's
quota go, so nothing is sorted but those sums. Small hubs hash as a whole and move together; a hub too
large for that is split by document. Documents without links are ballast: the shards' sizes are evened at
the end, by moving them first, then parts of large hubs, then small hubs as a whole.
DataFrame functions only; the driver sees sums by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.numbering import width

SHARDS = 8
ROUNDS, EVENINGS = 5, 6
#: Hash buckets a shard; labels of a hub that are candidates at once; share of a shard above which a hub is split.
BUCKETS, LABELS, LARGE = 4096, 8, 1 / 16
#: Evening ends when no shard is off the mean by more; a shard that
#: has refused movers and lacks less than ROOM of it isn't asked again.
NEAR, ROOM = 0.001, 0.02


def _of(values: list, shard: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(shard) + 1)


def _sums(df: DataFrame, by: str, shards: int) -> list[float]:
    got = {r[0]: r[1] for r in df.groupBy(by).agg(F.sum("size")).collect()}
    return [float(got.get(k, 0)) for k in range(shards)]


def _bucket(salt: int, c: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), c), F.lit(BUCKETS))


def propagate(scratch: store.Scratch, linked: DataFrame, links: DataFrame, mean: float, shards: int) -> DataFrame:
    """linked (node, size, seed, hub, large, shard) after at most ROUNDS rounds, written; links: (node, hub)."""
    refused = [False] * shards
    for turn in range(ROUNDS):
        load = _sums(linked, "shard", shards)
        room = [not refused[k] or mean - load[k] > mean * ROOM for k in range(shards)]
        labels = links.join(linked.select("node", "shard"), "node").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        entry = F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")
        most = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, LABELS)  # noqa: E731  as many entries as shards at most
        labels = labels.groupBy("hub").agg(F.array_union(most(entry), most(F.when(_of(room, "shard"), entry))).alias("labels"))
        labels = scratch.put(labels, f"labels-{turn}")  # so that Spark can split a hot hub's side of the join
        votes = links.join(labels, "hub").select("node", F.inline("labels")).groupBy("node", "shard").agg(F.sum("n").alias("n"))
        votes = votes.withColumnRenamed("shard", "to").join(linked, "node").where((F.col("to") == F.col("shard")) | _of(room, "to"))
        best = F.max(F.struct("n", _of(room, "to").alias("room"), F.xxhash64("hub", "to").alias("tie"), "to")).alias("best")
        same = [F.max(c).alias(c) for c in ("size", "seed", "hub", "large", "shard")]
        movers = votes.groupBy("node").agg(best, *same).withColumn("to", F.col("best.to")).where("to != shard")
        movers = movers.select("node", "size", "shard", "to", _bucket(turn, F.when(F.col("large"), F.col("seed")).otherwise(F.col("hub"))).alias("_b"))
        movers = scratch.put(movers, f"movers-{turn}")
        out = _sums(movers, "shard", shards)
        quota = [max(0.0, mean - load[k] + out[k]) for k in range(shards)]
        sums = movers.groupBy("to", "_b").agg(F.sum("size").alias("s"))
        sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("to").orderBy("_b")))
        full = {r[0]: r[1] for r in sums.where(F.col("upto") > _of(quota, "to")).groupBy("to").agg(F.min("_b")).collect()}
        refused = [refused[k] or k in full for k in range(shards)]
        go = movers.where(F.col("_b") < _of([full.get(k, BUCKETS) for k in range(shards)], "to")).select("node", "to")
        if go.isEmpty() and not any(k in full for k in range(shards)):
            break
        linked = scratch.put(linked.join(go, "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), f"linked-{turn}")
    return linked


def even(scratch: store.Scratch, state: DataFrame, mean: float, shards: int) -> DataFrame:
    """state (node, size, seed, hub, large, shard) with near equal sums of size by shard; hub is null for documents without links."""
    for turn in range(EVENINGS):
        load = _sums(state, "shard", shards)
        if max(abs(x - mean) for x in load) <= mean * NEAR:
            break
        spare, lack, at, start = [max(0.0, x - mean) for x in load], [], 0.0, []
        for x in spare:
            start.append(at)
            at += x
        at, takers = 0.0, [k for k in range(shards) if load[k] < mean]
        for k in takers:
            at += mean - load[k]
            lack.append(at)
        kind = F.when(F.col("hub").isNull(), 0).when(F.col("large"), 1).otherwise(2)
        step = kind * BUCKETS + _bucket(ROUNDS + turn, F.when(F.col("hub").isNull() | F.col("large"), F.col("seed")).otherwise(F.col("hub")))
        state = state.withColumn("_step", step)
        sums = state.where(_of([x > 0 for x in spare], "shard")).groupBy("shard", "_step").agg(F.sum("size").alias("s"))
        sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("shard").orderBy("_step"))).where(F.col("upto") <= _of(spare, "shard"))
        middle = _of(start, "shard") + F.col("upto") - F.col("s") / 2
        past = F.size(F.filter(F.array(*map(F.lit, lack)), lambda x: x <= middle))
        to = F.element_at(F.array(*map(F.lit, takers)), F.least(past, F.lit(len(takers) - 1)) + 1)
        go = sums.select(F.col("shard").alias("_from"), F.col("_step").alias("_s"), to.alias("_to"))
        state = state.join(go, (F.col("shard") == F.col("_from")) & (F.col("_step") == F.col("_s")), "left")
        state = scratch.put(state.withColumn("shard", F.coalesce("_to", "shard")).drop("_step", "_from", "_s", "_to"), f"even-{turn}")
    return state


def balance(scratch: store.Scratch, items: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Of items (node, size, seed) and links (node, hub): node and shard (0 to shards - 1) of every item.

    node is unique and not null, size not negative; seed is a number that reruns give alike. Every
    item begins in the shard of its seed; hubs of one document link nothing.
    """
    total = items.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    hubs = links.join(items.select("node", "size"), "node").groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1").drop("n")
    links = scratch.put(links.join(scratch.put(hubs, "hubs"), "hub"), "links")
    known = links.groupBy("node").agg(F.min("hub").alias("hub"), (F.max("bytes") > mean * LARGE).alias("large"))
    state = items.join(known, "node", "left").withColumn("shard", F.pmod(F.col("seed"), F.lit(shards)).cast("int"))
    state = scratch.put(state.withColumn("large", F.coalesce("large", F.lit(False))), "state")
    linked = propagate(scratch, state.where("hub is not null"), links.select("node", "hub"), mean, shards)
    return even(scratch, state.where("hub is null").unionByName(linked), mean, shards).select("node", "shard")


def cut_edges(placed: DataFrame) -> DataFrame:
    """Of placed (hub, shard): pairs, the links between documents of one hub, and cut, those between shards."""
    by = placed.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    by = by.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return by.agg(F.coalesce(F.sum(F.expr("(n * n - n) / 2")), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.expr("(n * n - inside) / 2")), F.lit(0)).cast("long").alias("cut"))


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For each row of docs: doc_id, size (bytes of its text and one), text_crc32, hub (number of its text), shard and slot.

    Documents of equal texts are linked. slot counts a shard's rows from 0 by doc_id (null first; ties by
    crc32, then size).

    Defined cases: a null text counts as an empty one (size 1, crc32 0); rows of a null or of one doc_id
    are told apart and placed by their texts; repeated rows are rows of their own, linked as their
    texts are equal; a text larger than a shard's share makes its shard as large as it is; an
    empty table gives no rows; other columns of docs, also of clashing names, are ignored.
    """
    scratch = store.Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hub"))
    rows = rows.withColumn("node", F.monotonically_increasing_id()).withColumn("seed", F.xxhash64(F.lit(7), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "hub"))
    rows = scratch.put(rows, "rows")
    placed = balance(scratch, rows.select("node", "size", "seed"), rows.select("node", "hub"), shards)
    return slots(scratch, rows.join(placed, "node").select("doc_id", "size", "text_crc32", "hub", "shard"))


def slots(scratch: store.Scratch, rows: DataFrame) -> DataFrame:
    """rows with slot: sorted range partitions number their rows; the shift of each (partition, shard) is one of partitions + shards rows."""
    d = rows.repartitionByRange(width(scratch.spark), "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32", "size")
    d = scratch.put(d.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    shift = d.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = shift.select(F.col("shard").alias("_sh"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    d = d.join(F.broadcast(shift), (F.col("shard") == F.col("_sh")) & (F.col("_part") == F.col("_p")))
    return d.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("slot"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(spark, store.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
