"""Merkle manifest of a dataset: one hash tree of fan-out 16 for each source and one over the sources.

Rows become leaves, are ordered and numbered within their source (numbering.py) and lie in range
partitions. Each task runs a mountain-range stack over the leaves it holds: a level's open run
takes nodes until their number is a multiple of 16, then the run is emitted and its hash carried
one level up. Nodes of runs that other tasks hold a part of, at both edges, are emitted as loose;
they are merged level by level in shuffles, where a source's last run may be short and isn't
padded. A task's loose nodes are at most 30 a level, so merging costs tasks times levels and not rows.

Proofs come top down: a run joins the path of its own parent, so paths are joined for runs and only
the last join, by runs of 16, has a row for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import store
from parcelflow.llm.numbering import crc32_sql, numbered

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RECORDS = "_g string, level int, run long, place int, digests array<string>"
PATH = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    """"-" for null, else the count of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _join(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class _Range:
    """The mountain range over consecutive leaves of one source: for each level its open run."""

    def __init__(self, group: str, emit):
        self.group, self.emit, self.open = group, emit, []

    def push(self, level: int, at: int, value: str) -> None:
        while True:
            if level == len(self.open):
                self.open.append([])
            run = self.open[level]
            run.append((at, value))
            if at % FAN != FAN - 1:
                return
            self.open[level] = []
            if len(run) < FAN:
                self._loose(level, run)
                return
            digests = [v for _, v in run]
            self.emit(self.group, level, at // FAN, -1, digests)
            level, at, value = level + 1, at // FAN, _join(digests)

    def _loose(self, level: int, run: list) -> None:
        for at, v in run:
            self.emit(self.group, level, at // FAN, at % FAN, [v])

    def close(self) -> None:
        for level, run in enumerate(self.open):
            self._loose(level, run)


def _mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (_g, _pos, leaf) in order: whole runs (place -1) and loose nodes."""
    rows: list[tuple] = []
    emit = lambda *r: rows.append(r)
    at, now = None, None
    for batch in batches:
        for g, p, leaf in zip(*(batch.column(k).to_pylist() for k in ("_g", "_pos", "leaf")), strict=True):
            if at != (g, p):
                if now:
                    now.close()
                now = _Range(g, emit)
            now.push(0, p, leaf)
            at = (g, p + 1)
        yield _records(rows)
        rows.clear()
    if now:
        now.close()
    yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("_g", pa.string()), ("level", pa.int32()), ("run", pa.int64()), ("place", pa.int32()), ("digests", pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def tree(scratch: store.Scratch, name: str, leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of leaves (_g, _pos, leaf), sorted within tasks: runs (_g, level, run, digests), tops (_g, n, height, top) and the most levels.

    runs: each run's children, level 0 for runs of leaves.
    """
    store.ship(scratch.spark)
    made = scratch.put(leaves.select("_g", "_pos", "leaf").mapInArrow(_mountains, RECORDS), f"{name}-nodes")
    whole, loose = made.where("place < 0").drop("place"), made.where("place >= 0")
    counts = leaves.groupBy("_g").agg((F.max("_pos") + 1).alias("n"), F.min(F.when(F.col("_pos") == 0, F.col("leaf"))).alias("_only"))
    counts = scratch.put(counts, f"{name}-counts")
    levels = height(counts.agg(F.max("n")).first()[0] or 0)
    parts, up = [whole], None
    for level in range(levels):
        here = loose.where(F.col("level") == level).select("_g", "run", "place", F.col("digests")[0].alias("d"))
        if up is not None:
            here = here.unionByName(up.where(F.col("level") == level).select("_g", (F.floor(F.col("run") / FAN)).alias("run"), (F.col("run") % FAN).cast("int").alias("place"), "d"))
        runs = here.groupBy("_g", "run").agg(F.sort_array(F.collect_list(F.struct("place", "d"))).alias("c"))  # 16 at most
        runs = scratch.put(runs.select("_g", F.lit(level).alias("level"), "run", F.col("c.d").alias("digests")), f"{name}-merged-{level}")
        parts.append(runs)
        up = runs.join(counts.select("_g", "n"), "_g").where(F.col("n") > F.lit(FAN**level)).select("_g", (F.col("level") + 1).alias("level"), "run", digest(F.array_join("digests", "")).alias("d"))
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.unionByName(p)
    h = F.lit(0)
    for k in range(levels):
        h = h + (F.col("n") > F.lit(FAN**k)).cast("int")
    counts = counts.withColumn("height", h)
    last = runs.where("run = 0").select("_g", (F.col("level") + 1).alias("height"), digest(F.array_join("digests", "")).alias("top"))
    tops = counts.join(last, ["_g", "height"], "left").select("_g", "n", "height", F.when(F.col("height") == 0, F.col("_only")).otherwise(F.col("top")).alias("top"))
    return runs, scratch.put(tops, f"{name}-tops"), levels


def _beside(digests: Column, place: Column) -> Column:
    """A run's children left and right of one of them, as one step of a path."""
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), place), "").alias("l"), F.array_join(F.slice(digests, place + 2, F.lit(FAN)), "").alias("r")
    )


def paths(runs: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """From tops (_g, height, path above the top): for each run of leaves _g, run, digests and path, the steps above the run."""
    known = None
    for level in range(levels - 1, -1, -1):
        up = tops.where(F.col("height") == level + 1).select("_g", F.lit(0).cast("long").alias("run"), "path")
        up = up if known is None else up.unionByName(known)
        here = runs.where(F.col("level") == level).select("_g", "run", "digests").join(up, ["_g", "run"])
        if level == 0:
            return here
        child = here.select("_g", "run", "digests", "path", F.posexplode("digests").alias("_j", "_d"))
        known = child.select("_g", (F.col("run") * FAN + F.col("_j")).alias("run"), F.concat(F.array(_beside(F.col("digests"), F.col("_j"))), F.col("path")).alias("path"))
    return tops.where("false").select("_g", F.lit(0).cast("long").alias("run"), F.array().cast("array<string>").alias("digests"), "path")


def proofs(leaves: DataFrame, runs: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """leaves with path: all steps from the leaf to the root; tops: as for paths(), and whatever else goes to each leaf."""
    below = paths(runs, tops, levels).select(F.col("_g").alias("_rg"), F.col("run").alias("_run"), F.col("digests").alias("_ds"), F.col("path").alias("_up"))
    more = [c for c in tops.columns if c not in ("_g", "height", "path", "n")]
    head = tops.select(F.col("_g").alias("_hg"), F.col("path").alias("_direct"), *more)
    out = leaves.join(below, (F.col("_g") == F.col("_rg")) & (F.floor(F.col("_pos") / FAN) == F.col("_run")), "left").join(head, F.col("_g") == F.col("_hg"))
    step = F.array(_beside(F.col("_ds"), (F.col("_pos") % FAN).cast("int")))
    return out.withColumn("path", F.when(F.col("_run").isNull(), F.col("_direct")).otherwise(F.concat(step, F.col("_up")))).drop("_rg", "_run", "_ds", "_up", "_hg", "_direct")


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level and from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["l"], d, s["r"]))


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, source, leaf, changed, subroot, root and path (siblings left and right, leaf to root).

    leaf: the row's hash; changed: the hash of the row with A-Z of its text in lower case.

    Defined cases: a null field is hashed as "-", so null and an empty text differ; a null source is
    a source of its own and the first one; rows of a source ascend by doc_id (null first), equal
    ones by their leaf; repeated rows are leaves of their own; a very long text is hashed as any
    other and goes no further than its hash; an empty table gives no rows; other columns of docs,
    also of clashing names, are ignored.
    """
    scratch = store.Scratch(spark, "merkle")
    store.ship(spark)
    d = docs.select(*(F.col(f"`{c}`") for c in FIELDS))
    hashed = lambda text: digest(*(field(F.col(c)) for c in FIELDS[:-1]), field(text))
    rows = d.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_g"), "doc_id", hashed(F.col("text")).alias("leaf"),
        F.when(tampered(F.col("doc_id")), hashed(F.translate("text", UPPER, UPPER.lower()))).alias("changed"),
    )
    rows = scratch.put(rows, "hashed")  # range partitions are cut in a pass of their own: texts are read once
    leaves = numbered(scratch, "leaves", rows, ["doc_id", "leaf"], [F.col("doc_id"), F.col("leaf")], ["doc_id", "leaf", "changed"])
    runs, tops, levels = tree(scratch, "rows", leaves)
    subroots = tops.select(F.lit("").alias("_g"), F.col("_g").alias("name"), F.col("top").alias("leaf"))
    subroots = numbered(scratch, "subroots", subroots, ["name"], [F.col("name")], ["name", "leaf"])
    above, root, heads = tree(scratch, "sources", subroots)
    told = root.select("_g", "height", F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
    told = proofs(subroots, above, told, heads).select(F.col("name").alias("_name"), "root", "path")
    tops = tops.join(told, F.col("_g") == F.col("_name")).select("_g", "height", F.col("top").alias("subroot"), "root", "path")
    tops = scratch.put(tops, "told")
    return proofs(leaves, runs, tops, levels).select("doc_id", F.when(F.col("_g") != "", F.substring("_g", 2, 1 << 30)).alias("source"), "leaf", "changed", "subroot", "root", "path")


def tampered(doc_id: Column) -> Column:
    """The rows that the query tampers with: 5 divides the crc32 of the decimal id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, store.table(spark, sf_dir, "documents"))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, FIELDS[:-1]))} || {field(text)})"
    grow = "SELECT {g}lvl + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER ({p}) AS n FROM {t}) WHERE n > 1 GROUP BY {g}lvl, idx // 16"
    side = lambda how: f"coalesce(string_agg(t.d, '' ORDER BY t.idx) FILTER (t.idx {how} k.pos), '')"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, leaf, changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
    SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS changed FROM documents)),
t(g, lvl, idx, d) AS (SELECT g, 0, pos, leaf FROM leaves UNION ALL {grow.format(g="g, ", p="PARTITION BY g", t="t")}),
s AS (SELECT g, arg_max(d, lvl) AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM t GROUP BY g),
u(lvl, idx, d) AS (SELECT 0, pos, subroot FROM s UNION ALL {grow.format(g="", p="", t="u")}),
r AS (SELECT arg_max(d, lvl) AS root FROM u),
k AS (
  SELECT l.g, l.pos AS leaf_at, l.doc_id, l.leaf, x.lvl, l.pos // (16::BIGINT ** x.lvl)::BIGINT AS pos FROM leaves l JOIN (SELECT g, lvl FROM t GROUP BY g, lvl HAVING count(*) > 1) x USING (g)),
p AS (SELECT k.g, k.leaf_at, k.lvl, {side("<")} AS l, {side(">")} AS r FROM k JOIN t ON t.g = k.g AND t.lvl = k.lvl AND t.idx // 16 = k.pos // 16 GROUP BY ALL),
q AS (SELECT k.g, k.lvl, {side("<")} AS l, {side(">")} AS r FROM (SELECT s.g, x.lvl, s.pos // (16::BIGINT ** x.lvl)::BIGINT AS pos FROM s CROSS JOIN (SELECT lvl FROM u GROUP BY lvl HAVING count(*) > 1) x) k JOIN u t ON t.lvl = k.lvl AND t.idx // 16 = k.pos // 16 GROUP BY ALL),
w AS (
  SELECT g, leaf_at, list(l || r ORDER BY tree, lvl) AS flat, list(l || '|' || r ORDER BY tree, lvl) AS steps FROM (
    SELECT g, leaf_at, 0 AS tree, lvl, l, r FROM p UNION ALL SELECT l.g, l.pos, 1, q.lvl, q.l, q.r FROM leaves l JOIN q USING (g)) GROUP BY ALL),
f AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(flat, ''), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(steps, [])), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root
  FROM leaves l LEFT JOIN w ON w.g = l.g AND w.leaf_at = l.pos JOIN s ON s.g = l.g CROSS JOIN r)
SELECT *, folded_root = root AS verified FROM f
"""


OP12_SQL = _sql()
