import random

import pytest

from parcelflow.operators.greedy import first_independent, first_matching
from parcelflow.plans import catalog, proposals
from parcelflow.sources.scratch import Scratch
from tests.same import rows_of, rows_of_sql

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert rows_of(df) == rows_of_sql(catalog.SQL[name], DATA, df.columns)


def _proposals(spark, rows):
    names = "pair_id long, proposal_id long, left long, top long, width long, height long, confidence_e3 long, change_type string, before_text string, after_text string"
    return spark.createDataFrame(rows, names)


def test_overlapping_boxes_merge_and_adjacent_stay(spark):
    rows = [(1, 1, 100, 100, 80, 60, 900, "shed built", "", ""), (1, 2, 104, 102, 80, 60, 700, "shed built", "", ""), (1, 3, 190, 100, 80, 60, 800, "shed built", "", ""), (2, 1, 100, 100, 80, 60, 900, "shed built", "", "")]
    got = {(r.pair_id, r.proposal_id): r.retained_id for r in proposals.retained(_proposals(spark, rows)).collect()}
    assert got == {(1, 1): 1, (1, 3): 3, (1, 2): 1, (2, 1): 1}


def test_dedup_partitions_its_input(spark):
    got = catalog.QUERIES["proposal_dedup"](spark, DATA).toPandas()
    kept = got[got.proposal_id == got.retained_id]
    assert set(got.retained_id) == set(kept.proposal_id) and got.proposal_id.notna().all()


def test_greedy_choices_are_those_of_a_pass_in_order(spark):
    rng = random.Random(2)
    edges, wishes = set(), []
    for key in range(12):
        n = rng.choice([1, 3, 20, 60])
        edges |= {(key, *sorted(rng.sample(range(n), 2))) for _ in range(3 * n) if n > 1}
        edges |= {(99, k, k + 1) for k in range(40)}
        for left in range(n):
            for rank, right in enumerate(rng.sample(range(n), rng.randrange(1, min(n, 6) + 1))):
                wishes.append((key, left, right, rank))
    nodes = {(k, r) for k, a, b in edges for r in (a, b)} | {(7, 1000)}
    want = {}
    for k, r in sorted(nodes):
        want[k, r] = min((a for key, a, b in edges if (key, b) == (k, r) and want[k, a] == a), default=r)
    df = first_independent(Scratch(spark, "t"), spark.createDataFrame(list(nodes), "k long, r long"), spark.createDataFrame(list(edges), "k long, lo long, hi long"), ["k"])
    assert {(r.k, r.r): r.into for r in df.collect()} == want
    taken, hit = set(), {}
    for key, left, right, _ in sorted(wishes, key=lambda w: (w[0], w[1], w[3])):
        if hit.setdefault((key, left), None) is None and (key, right) not in taken:
            hit[key, left] = right
            taken.add((key, right))
    df = first_matching(Scratch(spark, "t"), spark.createDataFrame(wishes, "k long, left long, right long, rank long"), ["k"])
    assert {(r.k, r.left): r.right for r in df.collect()} == hit
    none = spark.createDataFrame([], "k long, left long, right long, rank long")
    assert first_matching(Scratch(spark, "t"), none, ["k"]).collect() == []


def test_boxes_meet_in_rows_and_rounds_skip_boxes_without_duplicates(spark, monkeypatch):
    from parcelflow.functions import boxes

    rng = random.Random(4)
    rows = [(k, i, rng.randrange(600), rng.randrange(600), rng.randrange(40, 300), rng.randrange(40, 300), rng.randrange(90), rng.choice(["shed", "road"]), "", "") for k, n in ((1, 4), (2, 40), (3, 1)) for i in range(n)]
    put, wrote = Scratch.put, []
    monkeypatch.setattr(Scratch, "put", lambda self, d, name="table": wrote.append((name, d)) or put(self, d, name))

    def told():
        return sorted(tuple(r) for r in proposals.retained(_proposals(spark, rows)).collect())

    one = told()
    names = [n for n, _ in wrote]
    assert len(one) == len(rows) and "groups" in names and "large" not in names and any(a != b for _, a, b in one)
    ends = {(r.pair_id, r.r) for n, d in wrote if n == "kept" for r in d.collect()}
    assert len(ends) < sum(a == b for _, a, b in one)  # kept boxes without duplicates take no part
    monkeypatch.setattr(boxes, "CHUNK", 8)
    assert told() == one and "large" in [n for n, _ in wrote]


@pytest.mark.parametrize(("name", "most"), [("verification_run", 1), ("decision_audit", 1), ("proposal_funnel", 1), ("polygon_runs", 1), ("cell_overlap_join", 3)])
def test_rows_are_sent_no_more_often_than_needed(spark, name, most):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Exchange hashpartitioning") <= most


def test_confusion_golden(spark):
    from pyspark.sql import functions as F

    from parcelflow.plans.evaluation import confusion

    r = spark.range(1).select(*(c.alias(n) for n, c in confusion(F.lit(2), F.lit(1), F.lit(0)).items())).first()
    assert tuple(r) == (0.667, 1.0, 0.8, 0.667)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_responses_are_counted_without_a_join(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(6)
    rows = [(k, rng.randrange(1, 40), rng.randrange(1, 30), rng.randrange(1, 3), rng.choice([0.0, 0.05, 0.99]), "A") for k in range(60) for _ in range(rng.randrange(1, 6))]
    rows += [(None, 3, 4, 1, 0.1, "R"), (None, 5, 4, 1, 0.1, "R"), (70, None, 4, 1, 0.1, "N"), (70, 2, 4, 1, 0.1, "N"), (71, 2, 4, 1, None, "N"), (72, 0, 0, -1, 0.1, "N"), (72, 0, 0, 46, 0.1, "N"), (73, 3, 4, 1, 0.1, None)]
    names = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_linenumber": pa.int64(), "l_discount": pa.float64(), "l_returnflag": pa.string()}
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names.items())}), tmp_path / "lineitem.parquet")
    df = catalog.QUERIES["semantic_responses"](spark, str(tmp_path))
    assert rows_of(df) == rows_of_sql(catalog.SQL["semantic_responses"], str(tmp_path), df.columns)
    assert {r.accepted for r in df.collect()} == {True, False}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.QUERIES["semantic_responses"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Exchange") == 1 and "Join" not in plan
