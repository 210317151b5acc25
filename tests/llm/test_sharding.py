import collections
import zlib

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import sharding, store
from parcelflow.llm.queries import queries
from tests.llm.test_operators import KIND, wild

DATA = "/root/testdata/sf0.01"


def held(rows, want, shards=8):
    """rows: (doc_id, size, crc, shard, slot); want: (doc_id, text). Every law of the result but where documents lie."""
    told = lambda t: len((t or "").encode()) + 1
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=str) == sorted(((i, told(t), zlib.crc32((t or "").encode())) for i, t in want), key=str)
    by = collections.defaultdict(list)
    for i, _, _, s, slot in rows:
        assert 0 <= s < shards
        by[s].append((slot, i is not None, i or 0))
    for x in by.values():
        assert [r[0] for r in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda r: r[1:] + r[:1])


def loads(rows, shards=8):
    out = [0] * shards
    for r in rows:
        out[r[3]] += r[1]
    return out


def test_the_query_keeps_groups_together_and_sizes_even(spark):
    rows = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in queries()["op13_shards"](spark, DATA).collect()]
    docs = [tuple(r) for r in store.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    held(rows, docs)
    x = loads(rows)
    assert max(x) <= 1.02 * sum(x) / 8 and min(x) >= 0.98 * sum(x) / 8
    shard = {r[0]: r[3] for r in rows}
    groups = collections.defaultdict(set)
    for i, t in docs:
        groups[t].add(shard[i])
    assert all(len(g) == 1 for g in groups.values())


def test_wild_rows(spark):
    rows = wild()
    got = sharding.shard(spark, spark.createDataFrame(rows, KIND).repartition(3)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    held([tuple(r) for r in got], [(r[0], r[1]) for r in rows])
    assert sharding.shard(spark, spark.createDataFrame([], KIND)).collect() == []


def test_a_group_of_a_third_of_all_rows_is_split_and_reruns_agree(spark):
    rows = [(k, "copy " * 20) for k in range(1200)] + [(2000 + k, f"text number {k} " * 8) for k in range(1800)] + [(5000 + k, f"pair {k // 2} " * 9) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in sharding.shard(spark, df.repartition(5)).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
    held(got, rows)
    x = loads(got)
    assert max(x) - min(x) <= 0.02 * sum(x) / 8
    copies = collections.Counter(r[3] for r in got if r[0] < 1200)
    assert len(copies) <= 4 and sum(n for _, n in copies.most_common(2)) >= 700
    pairs = collections.defaultdict(set)
    for i, _, _, s, _ in got:
        if i >= 5000:
            pairs[(i - 5000) // 2].add(s)
    assert sum(len(p) > 1 for p in pairs.values()) <= 15
    assert got == sorted(tuple(r) for r in sharding.shard(spark, df.repartition(2)).select("doc_id", "size", "text_crc32", "shard", "slot").collect())


@pytest.mark.parametrize("shards", [1, 3, 20])
def test_documents_of_several_hubs_move_to_their_neighbours(spark, shards):
    """A ring of cliques: each document has a hub of its clique, some also one shared with the next clique."""
    items = spark.range(600).selectExpr("id as node", "10L as size", "xxhash64(id) as seed")
    links = spark.range(600).selectExpr("id as node", "id div 10 as hub").union(spark.range(60).selectExpr("id * 10 as node", "1000 + id div 2 as hub"))
    got = sharding.balance(store.Scratch(spark, "ring"), items, links, shards)
    assert got.count() == 600 and got.select("node").distinct().count() == 600
    n = [r[1] for r in got.groupBy("shard").count().collect()]
    assert len(n) == shards and max(n) - min(n) <= 10
    before = items.withColumn("shard", F.pmod("seed", F.lit(shards)))
    cut = lambda p: sharding.cut_edges(p.join(links, "node")).first()
    assert cut(got).cut <= 0.45 * cut(before).cut and cut(got).pairs == cut(before).pairs


def test_no_python_in_the_plan(spark):
    plan = queries()["op13_shards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
