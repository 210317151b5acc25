import collections
import hashlib
import zlib

from pyspark.sql import functions as F

from parcelflow.llm import merkle, numbering, store
from tests.llm.test_operators import KIND, wild


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def path_in(levels, k):
    out = []
    for level in levels[:-1]:
        a = k // 16 * 16
        out.append(("".join(level[a:k]), "".join(level[k + 1 : a + 16])))
        k //= 16
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars); doc_id, leaf, subroot, root, proof, folded root."""
    by = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda t, i=i, lang=lang, source=source, n=n: sha("".join(map(field, (i, source, lang, n, t))))
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        used = leaf(low) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf(text)
        by[source].append((i is not None, i or 0, leaf(text), used, i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[2] for r in sorted(by[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, _, leaf, used, i) in enumerate(sorted(by[s])):
            path = path_in(trees[s], j) + path_in(top, k)
            for left, right in path:
                used = sha(left + used + right)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), used))
    return sorted(out, key=str)


def folded(df):
    d = df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), merkle.fold(F.coalesce("changed", "leaf"), F.col("path")).alias("f"))
    return sorted((tuple(r) for r in d.collect()), key=str)


def test_manifest_of_wild_rows(spark):
    rows = wild()
    got = folded(merkle.manifest(spark, spark.createDataFrame(rows, KIND).repartition(3)))
    assert got == brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows])
    assert merkle.manifest(spark, spark.createDataFrame([], KIND)).collect() == []


def test_sources_of_any_length_and_a_hot_one(spark):
    rows = [(k, f"Text {k}", "en", f"n{n}", n) for n in (1, 2, 15, 16, 17, 256, 257, 273) for k in range(n)]
    rows += [(k, "A" * (k % 7), "en", "hot", k) for k in range(4097)]
    assert folded(merkle.manifest(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))) == brute(rows)


def test_a_lone_row_is_its_own_root(spark):
    rows = [(7, "Text", "en", "only", 4)]
    got = folded(merkle.manifest(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_a_task_emits_few_loose_nodes():
    made = []
    r = merkle._Range("g", lambda *x: made.append(x))
    for k in range(5, 5 + 5000):
        r.push(0, k, sha(str(k)))
    r.close()
    loose = [x for x in made if x[3] >= 0]
    assert len(loose) <= 30 * 4 and sum(len(x[4]) for x in made if x[1] == 0) == 5000
    full = levels_of([sha(str(k)) if k >= 5 else "" for k in range(5005)])
    assert all(x[4] == full[x[1]][x[2] * 16 : x[2] * 16 + 16] for x in made if x[3] < 0)


def test_positions_in_groups_that_span_tasks(spark):
    rows = [("hot", k) for k in range(700)] + [(f"g{k % 9}", k) for k in range(300)] + [("hot", 5)] * 3
    df = spark.createDataFrame(rows, "_g string, v long").repartition(5)
    got = numbering.numbered(store.Scratch(spark, "numbers"), "n", df, ["v"], [F.col("v")], ["v"]).collect()
    by = collections.defaultdict(list)
    for g, v in sorted(rows):
        by[g].append(v)
    assert sorted(map(tuple, got)) == sorted((g, v, p) for g, x in by.items() for p, v in enumerate(x))


def test_crc32_in_sql():
    import duckdb

    for x in ("0", "12345", "-7"):
        assert duckdb.sql(f"SELECT {numbering.crc32_sql(repr(x))}").fetchall()[0][0] == zlib.crc32(x.encode())
